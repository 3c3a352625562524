"""SimHash near-duplicates over deletion-variant signatures.

A fingerprint of 64 bits is cut into ``d // 2 + 1`` segments: of two fingerprints that differ in
at most ``d`` bits, one segment then differs in at most one.  Every segment is indexed once for
each of its bits with that bit cleared (a one-wildcard variant); two segments that differ in at
most one bit share a variant, so an equality join on the variants finds every pair, and the full
Hamming distance verifies it.  There are 64 rows a *distinct* fingerprint, however many documents
carry it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import components, rows, scratch, stored

BITS, SEED = 64, 42


def fingerprint_hashes(hashes: np.ndarray) -> int:
    """The signed 64-bit word whose bits are set in over half of the unsigned hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, width: int) -> int:
    """Of word shingles, repeats included; fewer words than ``width`` make one shingle, none give zero."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return fingerprint_hashes(np.array([xxh64_intdigest(line, SEED)], np.uint64))
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    ends = starts[width:]
    hashes = np.fromiter((xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(starts, ends)), np.uint64, len(ends))
    return fingerprint_hashes(hashes)


def fingerprints(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, tag, fp)`` of every row, ``tag`` a hash of the text, ``fp`` a signed long; no shuffle."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text, width) for (text,) in rows([batch], "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["id", "tag", "fp"])

    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {kind.simpleString()}, tag long, fp long")


def variants(fp, d: int):
    """The one-wildcard variants of all segments as one array: bit position above the segment without that bit."""
    n = d // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    width = max(b - a for a, b in zip(cuts, cuts[1:]))
    keys = []
    for a, b in zip(cuts, cuts[1:]):
        part = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        for i in range(a, b):
            keys.append(part.bitwiseAND(F.lit(((1 << (b - a)) - 1) & ~(1 << (i - a)))) + F.lit(i << width))
    return F.array(*keys)


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, tag, fp, component)`` of every row: the smallest id reachable over links of at most ``distance`` bits.

    Within a variant's bucket, rows first link to the fingerprint with most documents and to
    their predecessor (one sort, linear rows).  The equality join then only returns pairs whose
    sides are still in different components, so a ball of near copies does not become all of its
    pairs, and no link that connects anything is lost.

    Null and empty texts have fingerprint zero and link like any other; repeated rows each get a
    row; a null id keeps its row and never names a component (null if it has no other); other
    columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = scratch(spark)
    fps = stored(fingerprints(docs, width, id_col, text_col), folder, "fps")
    uniq = stored(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("first")), folder, "uniq")
    far = lambda a, b: F.bit_count(a.bitwiseXOR(b))
    ahead = Window.partitionBy("key").orderBy(F.desc("n"), "fp").rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy("key").orderBy(F.desc("n"), "fp")
    spread = uniq.select("fp", "n", F.explode(variants(F.col("fp"), distance)).alias("key"))
    hubs = spread.select("fp", F.first("fp").over(ahead).alias("hub"), F.lag("fp").over(order).alias("before"))
    hubs = hubs.select("fp", F.explode(F.array("hub", "before")).alias("to"))
    near = hubs.filter((F.col("to") != F.col("fp")) & (far(F.col("fp"), F.col("to")) <= distance))
    first = components(near.select(F.col("fp").alias("a"), F.col("to").alias("b")).distinct(), folder, "hub")
    known = stored(
        uniq.join(first, uniq["fp"] == first["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), folder, "known"
    )
    index = known.select("fp", "root", F.explode(variants(F.col("fp"), distance)).alias("key"))
    # The planner takes the index for as small as the table it is exploded from and would send all of it through the driver.
    a, b = index.alias("a"), index.hint("merge").alias("b")
    rest = a.join(
        b,
        (F.col("a.key") == F.col("b.key")) & (F.col("a.root") < F.col("b.root")) & (far(F.col("a.fp"), F.col("b.fp")) <= distance),
    ).select(F.col("a.root").alias("a"), F.col("b.root").alias("b"))
    second = components(rest.distinct(), folder, "rest")
    whole = known.join(second, known["root"] == second["node"], "left").select(
        "fp", "first", F.coalesce(second["root"], known["root"]).alias("root")
    )
    least = whole.groupBy("root").agg(F.min("first").alias("component"))
    named = stored(whole.select("fp", "root").join(least, "root").select("fp", "component"), folder, "named")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), "tag", "fp", "component")
