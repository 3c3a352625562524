"""Exact top-k inner products by best-first search of M-trees.

Vectors are dealt out to trees of bounded size by their nearest pivot.  A tree has paged nodes;
an entry keeps its routing object, covering radius, distance to the parent's routing object and
largest norm.  For a query ``q`` and an entry with object ``o``, radius ``r``:

*   ``<q,x> <= <q,o> + |q| r`` for every ``x`` below it;
*   before ``<q,o>`` is computed, the triangle inequality on stored distances already bounds it:
    ``d(q,x) >= |d(q,parent) - d(parent,o)| - r`` and ``2<q,x> = |q|^2 + |x|^2 - d(q,x)^2``.

Pages are opened by falling bound until it is under the k-th score.  A query first searches the
tree that holds it, then only the trees whose bound reaches the score found there.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stored

#: Entries of a page, most vectors of a tree, pivots, rows that pivots are picked from (smallest hashes of the ids).
PAGE, TREE, PIVOTS, SAMPLE = 256, 8192, 256, 4096
#: Trees in a chunk of the directory that meets each block of queries.
CHUNK = 256


def _farthest(points: np.ndarray, n: int) -> np.ndarray:
    """Indices of up to ``n`` spread-out points, the first row first."""
    picked, near = [0], ((points - points[0]) ** 2).sum(1)
    while len(picked) < min(n, len(points)):
        i = int(near.argmax())
        if near[i] == 0:
            break
        picked.append(i)
        near = np.minimum(near, ((points - points[i]) ** 2).sum(1))
    return np.array(picked)


def _nearest(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (pivots**2).sum(1)[None, :] - 2 * points @ pivots.T
    return d.argmin(1)


class MTree:
    """Bulk-loaded tree over integer vectors held as exact float64."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.pages: list[dict] = []
        self.center = vectors.mean(0).round() if len(vectors) else np.zeros(0)
        self.root = self._load(ids, vectors, self.center)
        self.radius = float(np.sqrt(((vectors - self.center) ** 2).sum(1).max())) if len(vectors) else 0.0
        self.norm = float(np.sqrt((vectors**2).sum(1).max())) if len(vectors) else 0.0

    def _load(self, ids: np.ndarray, vectors: np.ndarray, parent: np.ndarray) -> int:
        if len(ids) <= PAGE:
            page = {"leaf": True, "ids": ids, "objects": vectors, "radius": np.zeros(len(ids)), "norm": np.sqrt((vectors**2).sum(1))}
        else:
            picks = vectors[_farthest(vectors, min(PAGE, -(-len(ids) // (PAGE // 2))))]
            home = _nearest(vectors, picks)
            if len(picks) == 1:  # equal vectors: any split will do
                home, picks = np.arange(len(ids)) // PAGE, np.repeat(picks, -(-len(ids) // PAGE), 0)
            objects, radius, norm, child = [], [], [], []
            for i in range(len(picks)):
                inside = home == i
                if inside.any():
                    below = vectors[inside]
                    objects.append(picks[i])
                    radius.append(np.sqrt(((below - picks[i]) ** 2).sum(1).max()))
                    norm.append(np.sqrt((below**2).sum(1).max()))
                    child.append(self._load(ids[inside], below, picks[i]))
            page = {"leaf": False, "child": child, "objects": np.array(objects), "radius": np.array(radius), "norm": np.array(norm)}
        page["parent"] = np.sqrt(((page["objects"] - parent) ** 2).sum(1))
        self.pages.append(page)
        return len(self.pages) - 1

    def search(self, query: np.ndarray, own: int, k: int, least: float = -np.inf) -> list[tuple[int, int]]:
        """The k best ``(score, id)`` with scores of at least ``least``; ties to the smaller id; ``own`` takes no part."""
        size = float(np.sqrt(query @ query))
        slack = 1e-9 * (1 + size * self.norm)
        best: list[tuple[float, int]] = []  # a heap of (score, -id)
        start = float(np.sqrt(((query - self.center) ** 2).sum()))
        queue = [(-np.inf, 0, self.root, start)]
        order = 0
        while queue:
            bound, _, at, to_parent = heapq.heappop(queue)
            if -bound + slack < least:
                break
            page = self.pages[at]
            gap = np.maximum(np.abs(to_parent - page["parent"]) - page["radius"], 0)
            open_ = (size * size + page["norm"] ** 2 - gap**2) / 2 + slack >= least
            if not open_.any():
                continue
            which = np.flatnonzero(open_)
            dots = page["objects"][which] @ query
            if page["leaf"]:
                for i in np.flatnonzero(dots >= least).tolist():
                    score, vec = float(dots[i]), int(page["ids"][which[i]])
                    if vec == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -vec))
                    elif (score, -vec) > best[0]:
                        heapq.heapreplace(best, (score, -vec))
                if len(best) == k:
                    least = max(least, best[0][0])
            else:
                bounds = np.minimum(dots + size * page["radius"][which], size * page["norm"][which])
                for i in np.flatnonzero(bounds + slack >= least).tolist():
                    order += 1
                    o = page["objects"][which[i]]
                    d = np.sqrt(max(size * size + o @ o - 2 * dots[i], 0))
                    heapq.heappush(queue, (-float(bounds[i]), order, page["child"][which[i]], float(d)))
        return sorted(((int(s), -v) for s, v in best), key=lambda x: (-x[0], x[1]))


def _matrix(lists: list, dim: int | None = None) -> np.ndarray:
    """Shorter vectors count as filled up with zeros."""
    dim = max([dim or 0, *map(len, lists)])
    out = np.zeros((len(lists), dim))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "query_id long, vec_id long, score long"


def exact_top_k(vectors: DataFrame, k: int, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row under ``is_query`` the k largest integer inner products.

    Vectors become ``floor(scale * x)`` of each component.  Null vectors and ones with a null or
    non-finite component take no part, nor do rows with a null id; shorter vectors count as filled
    up with zeros; rows with a query's own id are not its candidates; every other row is one,
    repeated ids and vectors too; a query id of several rows has the k best of all of them; other columns are not read; an empty table gives no rows.  Scores are exact while
    inner products stay under 2^53.
    """
    spark = vectors.sparkSession
    folder = scratch(spark)
    x = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ints = vectors.filter(F.coalesce(sound, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(scale * v.cast("double"))).alias("v"), is_query.alias("q")
    )
    ints = stored(ints, folder, "ints")
    n = ints.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = _matrix([r.v for r in ints.select("v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()])
    pivots = sample[_farthest(sample, min(PIVOTS, -(-n // (TREE // 2))))]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("v").to_pylist(), pivots.shape[1])
            home = _nearest(m[:, : pivots.shape[1]], pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32())], names=["id", "v", "q", "pivot"])

    dealt = stored(ints.mapInArrow(assign, "id long, v array<long>, q boolean, pivot int"), folder, "dealt")
    # At most PIVOTS counts reach the driver.
    parts = {r.pivot: -(-r["count"] // (TREE // 2)) for r in dealt.groupBy("pivot").count().collect()}
    n_parts = F.element_at(F.create_map(*[F.lit(y) for kv in parts.items() for y in kv]), F.col("pivot"))
    dealt = dealt.withColumn("tree", F.col("pivot").cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("id"), n_parts))

    def build(group: pa.Table) -> pa.Table:
        raw = _matrix(group.column("v").to_pylist())
        ids = np.array(group.column("id").to_pylist(), np.int64)
        at = np.argsort(ids, kind="stable")
        ids, m = ids[at], raw[at]
        tree = MTree(ids, m)
        asks = np.flatnonzero(np.array([bool(v) for v in group.column("q").to_pylist()])[at])
        found, least = [], []
        for i in asks:
            best = tree.search(m[i], int(ids[i]), k)
            found.append(best)
            least.append(best[-1][0] if len(best) == k else -np.inf)
        head = (tree.center, tree.radius, tree.norm)
        row = [group.column("tree")[0].as_py(), pickle.dumps(head), pickle.dumps(tree), pickle.dumps((ids[asks], m[asks], np.array(least, float), found)) if len(asks) else None]
        return pa.table([[y] for y in row], schema=pa.schema([("tree", pa.int64()), ("head", pa.binary()), ("pages", pa.binary()), ("asks", pa.binary())]))

    trees = stored(dealt.groupBy("tree").applyInArrow(build, "tree long, head binary, pages binary, asks binary"), folder, "trees")
    n_chunks = max(1, -(-sum(parts.values()) // CHUNK))
    chunk = F.pmod(F.xxhash64("tree"), F.lit(n_chunks)).alias("chunk")
    heads = trees.select(chunk, F.struct("tree", "head").alias("h")).groupBy("chunk").agg(F.collect_list("h").alias("heads"))
    blocks = trees.filter("asks is not null").select("asks", F.col("tree").alias("home"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_chunks - 1).cast("long"))).alias("chunk"))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, m, least, _ = pickle.loads(row["asks"])
                size, out = np.sqrt((m**2).sum(1)), []
                for h in row["heads"]:
                    if h["tree"] == row["home"]:
                        continue
                    center, radius, norm = pickle.loads(h["head"])
                    d = min(len(center), m.shape[1])
                    bound = np.minimum(m[:, :d] @ center[:d] + size * radius, size * norm)
                    live = bound + 1e-9 * (1 + size * norm) >= least
                    if live.any():
                        out.append((h["tree"], pickle.dumps((ids[live], m[live], least[live]))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["tree", "block"])

    pairs = blocks.join(heads, "chunk").select("asks", "home", "heads").mapInArrow(prune, "tree long, block binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree = pickle.loads(batch.column("pages")[i].as_py())
                ids, m, least = pickle.loads(batch.column("block")[i].as_py())
                dim, out = len(tree.center), []
                for q, v, t in zip(ids.tolist(), m, least):
                    q_v = np.zeros(dim)
                    q_v[: min(dim, len(v))] = v[:dim]
                    out += [(q, vec, s) for s, vec in tree.search(q_v, q, k, t)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=FOUND)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("asks").to_pylist():
                ids, _, _, found = pickle.loads(blob)
                out = [(q, vec, s) for q, best in zip(ids.tolist(), found) for s, vec in best]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=FOUND)

    others = pairs.join(trees.select("tree", "pages"), "tree").select("pages", "block").mapInArrow(search, FOUND_DDL)
    found = others.unionByName(trees.filter("asks is not null").select("asks").mapInArrow(own, FOUND_DDL))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
