"""How far the sources of a language differ in their words, from joint histograms of counts.

What two sources differ by depends on a term's two counts alone.  For every pair of sources the
distinct (count, count) combinations are tallied, those with a zero by difference from the
histograms of each source, and the divergence is evaluated once for each combination and
multiplied.  Only terms that both sources have are ever paired.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, rows, scratch, stored

#: Bytes of terms: A-Z become a-z, a-z and all of other code points stay, the rest parts terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Counts that a task holds before it sends them on (about 60 MB).
HELD = 300_000
#: Bytes of a text that are split at a time.
PART = 1 << 20
#: What shares are multiples of.
SCALE = 1_000_000_000


def _parts(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, of some PART bytes at a time."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PART)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source; an empty term says that the group occurs."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [b"", *n]
            for at in range(0, len(terms), 1 << 16):
                part = terms[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )

    for lang, source, text in rows(batches, "lang", "source", "text"):
        if (lang, source) not in held:
            held[lang, source] = Counter(), Counter()
            size += 1
        n, docs = held[lang, source]
        before, seen = len(n), set()
        for part in _parts(text.translate(TERM_BYTES)):
            n.update(part)
            seen.update(part)
        docs.update(seen)
        size += len(n) - before
        if size >= HELD:
            yield from given()
            held, size = {}, 0
    yield from given()


def _share(n: str, total: str, terms: str) -> Column:
    """``1 + floor(SCALE * (n + 2) / (total + 2 * terms))``, exact at any size; null without terms."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * ({n} + 2)) div nullif({total} + 2 * {terms}, 0)")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``: part `pair` has every other source of the
    language by its divergence from the source, part `term` the ``top`` terms that the source has
    more of than its language, by theirs.

    Terms are letters and code points beyond ASCII, A-Z lower-cased; a language keeps those of at
    least ``least_docs`` (1 or more) of its rows.  Null texts, languages and sources are empty
    strings; an empty text makes its group occur; rows that repeat count each; a text of any
    length is read in parts; ties rank by the item's bytes.  Other columns are not read.  An
    empty table gives no rows, a language without kept terms zero for each pair.  Large sides
    are shuffled, and only tables counted to be small are broadcast.
    """
    if least_docs < 1:
        raise ValueError("least_docs is 1 or more")
    folder = scratch(docs.sparkSession)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)]
    read = docs.select(named[0].alias("lang"), named[1].alias("source"), named[2].cast("binary").alias("text"))
    tallied = read.mapInArrow(_tally, "lang string, source string, term binary, n long, docs long")
    # One exchange for both aggregations: a term has a row for each source, and those of a task were added up in it.
    cells = tallied.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    every = cells.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    every = stored(every.filter((F.col("docs") >= least_docs) | (F.octet_length("term") == 0)), folder, "terms")
    kept = every.filter(F.octet_length("term") > 0)
    counts = stored(kept.select("lang", F.inline("by_source"), "total").groupBy("lang", "source", "n", "total").agg(F.count("*").alias("times")), folder, "counts")

    # Sizes of each group and language; all pairs of sources are what the result has rows for.
    held = counts.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("of_source"), F.sum("times").alias("n_terms"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("of_lang"))
    groups = every.filter(F.octet_length("term") == 0).select("lang", F.inline("by_source")).drop("n")
    groups = groups.join(few(langs), "lang", "left").join(few(held), ["lang", "source"], "left").fillna(0, ["terms", "of_lang", "of_source", "n_terms"])
    groups = few(stored(groups, folder, "groups"))

    # Cells of both counts, and what they take from the cells in which one or both are zero.
    one = kept.select("lang", F.posexplode("by_source").alias("i", "x"), "by_source")
    both = one.select("lang", F.col("x.source").alias("s"), F.col("x.n").alias("a"), F.explode(F.slice("by_source", F.col("i") + 2, F.size("by_source") - F.col("i") - 1)).alias("y"))
    joint = both.select("lang", "s", F.col("y.source").alias("t"), "a", F.col("y.n").alias("b")).groupBy("lang", "s", "t", "a", "b").agg(F.count("*").alias("times"))
    none = F.lit(0).cast("long")
    split = F.inline(F.array(
        F.struct(F.col("a"), F.col("b"), F.col("times")), F.struct(F.col("a"), none.alias("b"), (-F.col("times")).alias("times")),
        F.struct(none.alias("a"), F.col("b"), (-F.col("times")).alias("times")), F.struct(none.alias("a"), none.alias("b"), F.col("times")),
    ))
    joint = joint.select("lang", "s", "t", split)
    g, h = groups.alias("g"), groups.alias("h")
    pairs = g.join(h, (F.col("g.lang") == F.col("h.lang")) & (F.col("g.source") < F.col("h.source"))).select(
        F.col("g.lang").alias("lang"), F.col("g.source").alias("s"), F.col("h.source").alias("t"), F.col("g.terms").alias("terms"), F.col("g.of_source").alias("of_s"), F.col("h.of_source").alias("of_t"),
        (F.col("g.terms") - F.col("g.n_terms") - F.col("h.n_terms")).alias("times"),
    )
    pairs = stored(pairs, folder, "pairs")
    marginal = counts.groupBy("lang", "source", "n").agg(F.sum("times").alias("times"))
    marginal = few(stored(marginal, folder, "marginal"))
    sides = [
        pairs.select("lang", "s", "t").join(marginal.withColumnRenamed("source", own), ["lang", own]).select("lang", "s", "t", *(F.col("n").alias(c) if c == side else none.alias(c) for c in ("a", "b")), "times")
        for own, side in (("s", "a"), ("t", "b"))
    ]
    cells = joint.unionByName(sides[0]).unionByName(sides[1]).unionByName(pairs.select("lang", "s", "t", none.alias("a"), none.alias("b"), "times"))
    cells = cells.groupBy("lang", "s", "t", "a", "b").agg(F.sum("times").alias("times")).filter("times > 0")
    cells = cells.join(few(pairs.select("lang", "s", "t", "terms", "of_s", "of_t")), ["lang", "s", "t"])
    cells = cells.withColumn("p", _share("a", "of_s", "terms")).withColumn("q", _share("b", "of_t", "terms"))
    sums = cells.groupBy("lang", "s", "t").agg(F.sum(_apart("p", "q") * F.col("times")).alias("value"))
    ways = F.inline(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item")), F.struct(F.col("t").alias("source"), F.col("s").alias("item"))))
    value = F.coalesce("value", F.lit(0).cast("long")).alias("value")
    found = pairs.join(few(sums), ["lang", "s", "t"], "left").select("lang", ways, value)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = found.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    # Combinations of the counts in a source and in its language, best first, until they have enough terms.
    combos = counts.join(groups.select("lang", "source", "terms", "of_source", "of_lang"), ["lang", "source"])
    combos = combos.withColumn("p", _share("n", "of_source", "terms")).withColumn("q", _share("total", "of_lang", "terms")).filter("p > q")
    combos = combos.select("lang", "source", "n", "total", "times", _apart("p", "q").alias("value"))
    higher = Window.partitionBy("lang", "source").orderBy(F.desc("value")).rangeBetween(Window.unboundedPreceding, -1)
    best = combos.withColumn("before", F.sum("times").over(higher)).filter(F.coalesce("before", F.lit(0)) < top)
    best = few(stored(best.select("lang", "source", "n", "total", "value"), folder, "best"))
    said = kept.select("lang", "term", "total", F.inline("by_source")).join(best, ["lang", "source", "n", "total"])
    said = said.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    said = said.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return found.unionByName(said)
