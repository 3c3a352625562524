"""Shared helpers: the scratch folder, written tables, Arrow batches of bounded size, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlattice.plans.session import written

#: Bytes of text after which an Arrow result batch is sent on.
FLUSH_BYTES = 8 << 20
#: Rows of a few numbers (up to 64 bytes) up to which a counted table is broadcast.
FEW = 300_000
#: Edges that a task of ``components`` joins together (16 MB or less).
LOCAL = 1 << 18


def scratch(spark: SparkSession) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests) a local folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="textlattice-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tl-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet below ``folder`` and reads it again; what was shuffled for it goes."""
    path = f"{folder}/{name}"
    written(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, folder: str, name: str) -> None:
    """Deletes a table of ``stored`` that no later step reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches, converted a few hundred at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(n).to_pylist() for n in names))


def few(df: DataFrame) -> DataFrame:
    """Rows of a few numbers, marked for broadcast if they have been counted to be small."""
    return F.broadcast(df) if df.count() <= FEW else df


def id_key(docs: DataFrame, id_col: str) -> Column:
    """The id as a long: whole numbers as they are, other kinds by their hash, null as the least long."""
    whole = isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    key = F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    return F.coalesce(key, F.lit(-(1 << 63)))


def own_names(docs: DataFrame, *names: str) -> list[str]:
    """Column names that ``docs`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of ``n`` nodes over edges ``(u[i], v[i])``: the larger root of an edge hooks to the smaller."""
    root = np.arange(n)
    while True:
        x, y = root[u], root[v]
        open_ = x != y
        if not open_.any():
            return root
        u, v, x, y = u[open_], v[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of LOCAL edges of a task at a time, ``(a, b)`` for each node: itself and the smallest node reachable over them."""
    held, size = [], 0

    def given() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ends = [pa.concat_arrays(table.column(c).chunks) for c in ("a", "b")]
        if pa.types.is_struct(ends[0].type):
            flat = [e.flatten() for e in ends]
            node = np.rec.fromarrays([np.concatenate([x.to_numpy(), y.to_numpy()]) for x, y in zip(*flat)])
            order = np.lexsort([node[c] for c in reversed(node.dtype.names)])
        else:
            node = np.concatenate([e.to_numpy() for e in ends])
            order = np.argsort(node, kind="stable")
        fresh = np.append(True, node[order][1:] != node[order][:-1])
        place = np.empty(len(node), np.int64)
        place[order] = np.cumsum(fresh) - 1
        names = order[fresh]
        root = forest(place[: table.num_rows], place[table.num_rows :], len(names))
        every = pa.concat_arrays(ends)
        return pa.RecordBatch.from_arrays([every.take(pa.array(names)), every.take(pa.array(names[root]))], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= LOCAL:
            yield given()
            held, size = [], 0
    if size:
        yield given()


def components(edges: DataFrame, folder: str, tag: str) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)``, root the smallest node.

    Tasks first reduce LOCAL edges each to a star for each of their components, again and again
    while that halves the edges or at last one such share is left.  What is then left of a larger
    graph goes through rounds in which every node, and the root it had, take the smallest root
    among the node's neighbours, with pointer jumping.  Every round is a written table; only counts
    reach the driver.  Nodes are longs or structs of longs without nulls.  Empty edges give no
    rows; repeated edges and self-loops change nothing.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType.simpleString()
    ddl = f"a {kind}, b {kind}"
    turn, rows_ = 0, None
    now = stored(edges.select("a", "b").mapInArrow(_forests, ddl), folder, f"{tag}-0")
    while True:
        last, rows_ = rows_, now.count()
        if last is not None and (last <= LOCAL or 2 * rows_ > last):
            break
        turn += 1
        parts = -(-rows_ // LOCAL) or 1
        # What other tasks found of a node meets in one; a node has a row for each of them at most, so no task is hot.
        dealt = now.repartition(parts, "a") if parts > 1 else now.coalesce(1)
        now = stored(dealt.mapInArrow(_forests, ddl), folder, f"{tag}-{turn}")
        forget(spark, folder, f"{tag}-{turn - 1}")
    if last <= LOCAL:
        return now.toDF("node", "root")
    both = stored(now.union(now.select("b", "a")).distinct(), folder, f"{tag}-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), folder, f"{tag}-labels-0")
    small = labels.count() <= FEW
    sent = F.broadcast if small else (lambda df: df)
    turn = 0
    while True:
        turn += 1
        near = both.join(sent(labels), both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = near.join(sent(labels), labels["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        hooks = F.explode(F.array(F.struct("node", "was", "root"), F.struct(F.col("was").alias("node"), F.lit(None).cast(kind).alias("was"), "root")))
        step = step.select(hooks.alias("x")).select("x.*").groupBy("node").agg(F.max("was").alias("was"), F.min("root").alias("root"))
        step = stored(step, folder, f"{tag}-step-{turn}")
        up = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
        moved = stored(step.join(sent(up), "root", "left").select("node", "was", F.coalesce(F.least("top", "root"), "root").alias("root")), folder, f"{tag}-labels-{turn}")
        done = moved.filter("was <> root").limit(1).count() == 0
        forget(spark, folder, f"{tag}-labels-{turn - 1}")
        forget(spark, folder, f"{tag}-step-{turn}")
        labels = moved.select("node", "root")
        if done:
            forget(spark, folder, f"{tag}-edges")
            return labels


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id and text hash are in ``gone(id, tag)``; null ids match null ids.

    ``gone`` is broadcast if it has been counted to have few rows (16 bytes each); beyond that the
    documents are shuffled by both keys.
    """
    i, t = own_names(docs, "id", "tag")
    gone = few(gone.select(id_key(gone, "id").alias(i), F.col("tag").alias(t)).distinct())
    keyed = docs.withColumns({i: id_key(docs, id_col), t: F.xxhash64(text_col)})
    return keyed.join(gone, [i, t], "left_anti").drop(i, t)
