"""Near-duplicates by the Jaccard similarity of word shingles, with candidates that miss no pair.

Two sets of similarity ``s`` share at least ``s`` of the larger one, so under any fixed order of
shingles, two of the first ``n - ceil(s n) + 2`` of each set are the same.  The order is by rising
frequency in a sample, which keeps buckets small; it decides no result.  A bucket's texts link to
its smallest and to their predecessor; then the pairs follow whose sides are still apart (see
``prefixes``).  Every candidate link is verified on the whole sets of shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, few, rows, scratch, stored, tasks
from .prefixes import PACKED, SHARED, Packer, across, cell_of, crowded, parts_of, wanted

#: The similarity as a fraction, so that its test is in whole numbers.
PART, WHOLE = 4, 5
#: Bits of a shingle's hash that pick its cell of counts; one document in so many is counted.
CELL_BITS, SAMPLED = 20, 16
_BASE, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of word shingles, in ASCII lower case; fewer words than ``width`` make one shingle, none give none."""
    data = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
    at = np.flatnonzero(~_SPACE[data])
    if not len(at):
        return np.empty(0, np.uint64)
    starts = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    sizes = np.diff(np.append(starts, len(at)))
    powers = np.full(int(sizes.max()), _BASE, np.uint64)
    powers[:1] = 1
    powers = np.multiply.accumulate(powers)
    words = _mixed(np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(at)) - np.repeat(starts, sizes)], starts))
    width = min(width, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total = total * _NEXT + words[k : k + len(total)]
    return np.unique(_mixed(total + np.uint64(width)))


def _levels(docs: DataFrame, width: int) -> np.ndarray:
    """How common the shingles of each cell are in a sample of the documents: four steps for each power of two."""
    cells = 1 << CELL_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for (text,) in rows(batches, "text"):
            np.add.at(total, (shingle_set(text, width) & np.uint64(cells - 1)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    sample = docs.select("tag", "text").filter(F.pmod("tag", F.lit(SAMPLED)) == 0)
    found = sample.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1").toArrow()
    level = np.zeros(cells, np.uint8)
    level[found["cell"].to_numpy()] = np.minimum(4 * np.log2(found["n"].to_numpy()), 63)
    return level


def _similar(pairs: DataFrame, docs: DataFrame, width: int, folder: str, name: str) -> DataFrame:
    """Of pairs ``(a, b)`` of tags, those whose shingle sets have the similarity."""
    pairs = stored(pairs, folder, f"{name}-pairs")
    ends = pairs.select(F.col("a").alias("item")).union(pairs.select("b"))
    # The sets of the texts in question: a bitmap of 2 MB at most says which they are.
    held = docs.sparkSession.sparkContext.broadcast(wanted(ends))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.filter(pa.array(held.value[cell_of(batch.column("tag").to_numpy())], pa.bool_()))
            for i in range(0, asked.num_rows, 64):
                part = asked.slice(i, 64)
                found = [shingle_set(t, width).view(np.int64) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("tag"), pa.array(found, pa.list_(pa.int64()))], names=["tag", "set"])

    found = docs.select("tag", "text").mapInArrow(sets, "tag long, set array<long>")
    asked = found.join(few(stored(ends.distinct().withColumnRenamed("item", "tag"), folder, f"{name}-ends")), "tag", "left_semi")
    kept = stored(asked.groupBy("tag").agg(F.first("set").alias("set")), folder, f"{name}-sets")
    both = pairs.join(kept.toDF("a", "x"), "a").join(kept.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(WHOLE * shared >= PART * (F.size("x") + F.size("y") - shared)).select("a", "b")


def shingle_keys(found: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The rarest ``n - ceil(s n) + SHARED`` shingles of a set; a set of less than SHARED gives as many keys all the same."""
    n = len(found)
    if n < SHARED:
        one = found if n else np.zeros(1, np.uint64)
        return np.concatenate([_mixed(one + np.uint64(k)) for k in range(SHARED)])
    rank = level[found & np.uint64((1 << CELL_BITS) - 1)]
    return found[np.argsort(rank, kind="stable")[: n - -(-PART * n // WHOLE) + SHARED]]


def similar_documents(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, tag, component)`` of every row: the smallest id reachable over links of Jaccard similarity PART / WHOLE or more.

    ``tag`` is a hash of the text; equal texts are always linked, as are all without a word; a null
    id keeps its row and never names a component (null if it has no other); other columns are not
    read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = scratch(spark)
    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    level = spark.sparkContext.broadcast(_levels(narrow, width))
    # A word of prose has some five characters and every fifth shingle is a key; only the sizes of parts follow from it.
    parts = parts_of(int(narrow.agg(F.sum(F.length("text") / 25 + SHARED)).first()[0] or 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts)
        for tag, text in rows(batches, "tag", "text"):
            if tag not in packer.seen:
                found = shingle_set(text, width)
                keys = shingle_keys(found, level.value)
                one = lambda x: np.array([x])
                yield from packer.add(keys, one(len(found)), one(tag), one(len(keys)), one(0))
        yield from packer.flush()

    found = stored(crowded(narrow.select("tag", "text").mapInArrow(run, PACKED), parts, tasks(spark)), folder, "found")
    first = components(_similar(found.filter("key is null").select("a", "b").distinct(), narrow, width, folder, "near"), folder, "near")
    rest = across(found.filter("key is not null"), few(first.toDF("item", "root")))
    more = _similar(rest, narrow, width, folder, "rest")
    groups = components(first.toDF("a", "b").union(more), folder, "all")
    named = stored(narrow.select("id", "tag").join(few(groups.withColumnRenamed("node", "tag")), "tag", "left").select("id", "tag", F.coalesce("root", "tag").alias("root")), folder, "named")
    least = named.groupBy("root").agg(F.min("id").alias("component"), F.count("*").alias("many"))
    # A row that is alone in its group needs no join.
    least = few(least.filter("many > 1").drop("many"))
    out = named.join(least.withColumn("grouped", F.lit(True)), "root", "left")
    return out.select(F.col("id").alias(id_col), "tag", F.when(F.col("grouped"), F.col("component")).otherwise(F.col("id")).alias("component"))
