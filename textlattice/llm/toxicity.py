"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fitting: from a bounded sample of labelled rows, terms whose document shares differ between the
labels (by a two-proportion z) make the vocabulary; their document frequencies are counted over the
whole corpus, and a term's weight is its TF-IDF times its |z|, so that the many terms that say
little about the label count for little.  The labelled examples go into an inverted index whose
documents lie in blocks; for each term and block the largest weight is kept.  A text opens blocks by
falling upper bound until the bound is under its k-th cosine, which makes the neighbours exact.
Their votes, weighted by cosine distance, pass through an isotonic fit of leave-one-out votes to
give a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows, scratch, stored, tasks

#: Bounds of the fitted model: labelled rows, documents of a block, neighbours.
LABELLED, BLOCK, NEAREST = 12_000, 64, 15
#: Least |z| of a term (the usual 5 % level), and least labelled documents that have it.
LEAST_Z, LEAST_DOCS = 2.0, 4
WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Examples:
    """The inverted index; a document's weights have unit length."""

    def __init__(self, ids: list[int], vectors: list[dict[int, float]], labels: list[int]):
        # Documents with like terms share blocks, so that bounds differ between blocks.
        order = sorted((i for i in range(len(ids)) if vectors[i]), key=lambda i: (sorted(vectors[i].items(), key=lambda x: (-x[1], x[0])), ids[i]))
        self.ids = [ids[i] for i in order]
        self.labels = np.array([labels[i] for i in order], float)
        self.n_terms = max((t for v in vectors for t in v), default=-1) + 1
        # By document: where its entries start, their terms and weights.
        self.at = np.concatenate([[0], np.cumsum([len(vectors[i]) for i in order])]).astype(np.int64)
        self.term = np.array([t for i in order for t in vectors[i]], np.int64)
        self.weight = np.array([w for i in order for w in vectors[i].values()], float)
        # By term: documents with weights, and the largest weight of each block.
        row = np.repeat(np.arange(len(order)), np.diff(self.at))
        by = np.argsort(self.term, kind="stable")
        self.docs, self.said = row[by], self.weight[by]
        self.edge = np.searchsorted(self.term[by], np.arange(self.n_terms + 1))
        self.tops = np.zeros((self.n_terms, -(-len(order) // BLOCK)))
        np.maximum.at(self.tops, (self.term, row // BLOCK), self.weight)
        self.most = self.tops.max(1, initial=0)

    def cosines(self, dense: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Of documents ``rows`` with a query as an array over the terms; each sums in the order of its own terms."""
        sizes = self.at[rows + 1] - self.at[rows]
        at = np.arange(int(sizes.sum())) + np.repeat(self.at[rows] - (np.cumsum(sizes) - sizes), sizes)
        return np.round(np.bincount(np.repeat(np.arange(len(rows)), sizes), dense[self.term[at]] * self.weight[at], len(rows)), 12)

    def nearest(self, vector: dict[int, float], k: int, skip: int | None = None) -> list[tuple[float, int]]:
        """The k largest positive cosines as ``(cosine, position)``; ties to the earlier position.

        The blocks of the largest bounds give a first k-th cosine.  Terms that together can't reach
        it open no document: the others' postings in blocks that can reach it name the candidates,
        whose partial sums leave few to be scored in full.
        """
        query = [(t, w) for t, w in vector.items() if t < self.n_terms]
        if not query:
            return []
        terms, weights = (np.array(x) for x in zip(*query))
        dense = np.zeros(self.n_terms)
        dense[terms] = weights
        bound = weights @ self.tops[terms]
        first = np.argsort(-bound, kind="stable")[: 1 + k // BLOCK + 1]
        rows = (first[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        rows = rows[rows < len(self.ids)]
        scores = self.cosines(dense, rows)
        if skip is not None:
            scores[rows == skip] = 0
        least = float(np.sort(scores)[-k]) if len(scores) >= k else 0.0
        reach = weights * self.most[terms]
        order = np.argsort(-reach, kind="stable")
        # What the terms from here on can add at most.
        rest = np.append(np.cumsum(reach[order][::-1])[::-1], 0.0)
        part, n = np.zeros(len(self.ids)), 0
        while n < len(order) and rest[n] >= least - 1e-9:
            # Twice as many terms each time; a partial sum is a lower bound of a cosine.
            now = order[n : 2 * n + 4]
            lists = [slice(self.edge[t], self.edge[t + 1]) for t in terms[now].tolist()]
            part += np.bincount(np.concatenate([self.docs[x] for x in lists]), np.concatenate([self.said[x] * w for x, w in zip(lists, weights[now].tolist())]), len(part))
            n += len(now)
            if skip is not None:
                part[skip] = 0
            if len(part) >= k:
                least = max(least, float(np.partition(part, -k)[-k]))
        rows = np.flatnonzero((part > 0) & (part + rest[n] >= least - 1e-9))
        rows = rows[bound[rows // BLOCK] >= least - 1e-9]
        scores = self.cosines(dense, rows)
        best = np.lexsort((rows, -scores))[:k]
        return [(float(scores[i]), int(rows[i])) for i in best.tolist() if scores[i] > 0]


class Model:
    def __init__(self, index: Examples, weight: list[float], prior: float, base: float):
        self.index, self.weight, self.prior, self.base = index, weight, prior, base
        self.steps = np.array([0.0]), np.array([base])
        self.cache: dict = {}

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        raw = {t: (1 + math.log(n)) * self.weight[t] for t, n in counts.items()}
        size = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / size for t, w in raw.items()} if size else {}

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of label 1, weighted by 1 / (distance + 0.1) and drawn to the prior by one far neighbour."""
        pull = 1 / 1.1
        weights = [1 / (1 - c + 0.1) for c, _ in near]
        hits = sum(w for w, (_, i) in zip(weights, near) if self.index.labels[i] == 1)
        return (hits + pull * self.prior) / (sum(weights) + pull)

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Isotonic regression by pooling adjacent violators."""
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []
        for v, y in zip(votes[order].tolist(), labels[order].tolist()):
            pools.append([v, y, 1.0])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                _, y2, n2 = pools.pop()
                pools[-1][1] += y2
                pools[-1][2] += n2
        if pools:
            self.steps = np.array([p[0] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])

    def score(self, counts: dict[int, int]) -> tuple[float, list[int], list[float]]:
        key = tuple(sorted(counts.items()))
        if key not in self.cache:
            if len(self.cache) > 100_000:
                self.cache.clear()
            near = self.index.nearest(self.vector(counts), NEAREST)
            if near:
                at = np.searchsorted(self.steps[0], self.vote(near), "right") - 1
                p = float(self.steps[1][max(at, 0)])
            else:
                p = self.base
            self.cache[key] = (p, [self.index.ids[i] for _, i in near], [c for c, _ in near])
        return self.cache[key]


def _vocabulary(sample: DataFrame) -> dict[str, float]:
    """Terms by falling |z| of their document shares under the two labels, with it; ``sample`` is bounded."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for label, text in rows(batches, "label", "text"):
            count.update((t, label) for t in set(words(text)))
            count[None, label] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in count], pa.string()), pa.array([y for _, y in count], pa.int32()), pa.array(list(count.values()), pa.int64())], names=["term", "label", "n"]
        )

    by = sample.mapInArrow(terms, "term string, label int, n long").groupBy("term").agg(
        F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("n"))), F.lit(0)).alias("one"), F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("n"))), F.lit(0)).alias("zero")
    )
    total = by.filter("term is null").collect()
    if not total or not total[0].one or not total[0].zero:
        return {}
    n1, n0 = total[0].one, total[0].zero
    both = (F.col("one") + F.col("zero")) / (n1 + n0)
    z = (F.col("one") / n1 - F.col("zero") / n0) / F.sqrt(both * (1 - both) * (1 / n1 + 1 / n0))
    picked = by.filter("term is not null").filter(F.col("one") + F.col("zero") >= LEAST_DOCS).withColumn("z", F.abs(z)).filter(F.col("z") >= LEAST_Z)
    return {r.term: r.z for r in picked.orderBy(F.desc("z"), "term").collect()}


def toxicity(docs: DataFrame, labels: DataFrame, usable_label, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(id, score, evidence_ids, evidence_cosines)`` of every row; ``usable_label`` says of a labels row whether it may be learned.

    A score depends on the text alone.  A null or empty text, and any other without a term of the
    vocabulary, has the share of label 1 among such examples.  Labels that are null or not 0/1 are
    not learned, nor are documents that carry both labels; with no labels every score is the
    smoothed prior.  Of examples that tie at the last neighbour, those of the larger weights, then of
    the smaller ids, count.  Repeated rows score alike; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = scratch(spark)
    known = labels.filter(usable_label & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("most")
    ).filter("label = most")
    # A fixed number of rows, spread by hash; ids and labels of at most LABELLED rows reach the driver.
    picked = {r.id: r.label for r in known.orderBy(F.xxhash64("id"), "id").limit(LABELLED).collect()}
    small = F.broadcast(spark.createDataFrame(list(picked.items()), "id long, label int"))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    terms = _vocabulary(narrow.join(small, "id").select("label", "text"))
    vocabulary = {t: i for i, t in enumerate(terms)}
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for (text,) in rows([batch], "text"):
                found = Counter([vocabulary[w] for w in words(text) if w in vocabulary])
                out.append(sorted(found.items()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([[t for t, _ in x] for x in out], pa.list_(pa.int32())), pa.array([[n for _, n in x] for x in out], pa.list_(pa.int32()))], names=["id", "terms", "counts"]
            )

    counted = stored(narrow.mapInArrow(count, f"id {kind}, terms array<int>, counts array<int>"), folder, "counted")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=len(terms))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["t", "n"])

    n = counted.count()
    # A row for each term of the vocabulary and task at most.
    df = {r.t: r.n for r in counted.select("terms").mapInArrow(frequencies, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()} if terms else {}
    weight = [terms[t] * (math.log((n + 1) / (df.get(i, 0) + 1)) + 1) for t, i in vocabulary.items()]
    # An id of several rows gives one example, so no more than LABELLED come.
    shown = counted.join(small, "id").groupBy("id", "label").agg(F.min(F.struct("terms", "counts")).alias("v"))
    examples = sorted((r.id, r.label, tuple(r.v.terms), tuple(r.v.counts)) for r in shown.collect())
    prior = (sum(y for _, y, _, _ in examples) + 0.5) / (len(examples) + 1)
    bare = [y for _, y, t, _ in examples if not t]
    model = Model(Examples([], [], []), weight, prior, (sum(bare) + prior) / (len(bare) + 1))
    model.index = Examples([e[0] for e in examples], [model.vector(dict(zip(e[2], e[3]))) for e in examples], [e[1] for e in examples])
    unfit = spark.sparkContext.broadcast(model)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = unfit.value
        x = m.index
        for batch in batches:
            out = []
            for i in batch.column(0).to_pylist():
                own = slice(x.at[i], x.at[i + 1])
                near = x.nearest(dict(zip(x.term[own].tolist(), x.weight[own].tolist())), NEAREST, i)
                if near:
                    out.append((m.vote(near), float(x.labels[i])))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in (zip(*out) if out else ([], []))], names=["vote", "label"])

    # At most LABELLED votes reach the driver.
    fitted = spark.range(len(model.index.ids), numPartitions=tasks(spark)).mapInArrow(left_out, "vote double, label double").collect()
    unfit.destroy()
    fitted = sorted((r.vote, r.label) for r in fitted)
    model.calibrate(np.array([v for v, _ in fitted]), np.array([y for _, y in fitted]))
    held = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            out = [m.score(dict(zip(t, c))) for t, c in rows([batch], "terms", "counts")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.float64()))],
                names=["id", "score", "evidence_ids", "evidence_cosines"],
            )

    # The counts are a small table of few files; scoring takes all tasks.
    dealt = counted.repartition(tasks(spark))
    return dealt.mapInArrow(score, f"id {kind}, score double, evidence_ids array<long>, evidence_cosines array<double>").withColumnRenamed("id", id_col)
