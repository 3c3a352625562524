"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are counted per cell of (source, language, topic).  Target shares of each marginal are the
observed ones to a power under one (or given), which flattens them; raking then scales the cells to
each marginal in turn.  A document of a cell is sampled with probability min(1, c * w), where w is
the cell's fitted over observed mass and c makes the expected tokens the wanted share of all.  The
cell table is small, so raking is a few windows over it; documents meet it once, in a salted join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW, scratch, stored

MARGINS = ("source", "lang", "topic")
#: Raking rounds, the power of the default targets, the sampled share of tokens, salts of the cells.
ROUNDS, POWER, SHARE, SALTS = 8, 0.5, 0.5, 16
WORD_BREAK = r"[\x20\x09-\x0D]+"
CONTENT = 8
ADDED = ("_tokens", "_topic", "_weight", "_p", "_sampled")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def topic_of(found: Column) -> Column:
    """The commonest bucket (first hex digit of MD5) of words with CONTENT letters or more; ties to the smaller, 'none' without."""
    letters = F.array_join(F.transform(F.filter(found, lambda w: F.length(w) >= CONTENT), lambda w: F.substring(F.md5(w.cast("binary")), 1, 1)), "")
    return letters


def with_topic(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``_tokens`` (words of the whole text) and ``_topic``."""
    d = docs.withColumn("_words", words(F.col(text_col)))
    d = d.withColumns({"_tokens": F.size("_words").cast("long"), "_letters": topic_of(F.col("_words"))}).drop("_words")
    counts = [F.struct((F.length("_letters") - F.length(F.replace("_letters", F.lit(x), F.lit("")))).alias("n"), F.lit(-i).alias("i"), F.lit(x).alias("t")) for i, x in enumerate("0123456789abcdef")]
    return d.withColumn("_topic", F.when(F.length("_letters") == 0, "none").otherwise(F.greatest(*counts)["t"])).drop("_letters")


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, power: float = POWER) -> DataFrame:
    """Adds ``mass``, the fitted share of each of ``cells(source, lang, topic, tokens)``."""
    total = Window.partitionBy(F.lit(1))
    out = cells.withColumn("mass", F.col("tokens") / F.sum("tokens").over(total))
    for m in MARGINS:
        given = (targets or {}).get(m)
        if given:
            share = F.element_at(F.create_map(*[F.lit(x) for kv in given.items() for x in kv]), F.col(m))
            out = out.withColumn(f"to_{m}", F.coalesce(share, F.lit(0.0)))
        else:
            by = Window.partitionBy(m)
            out = out.withColumn("_m", F.pow(F.sum("mass").over(by), power)).withColumn("_n", F.count("*").over(by))
            out = out.withColumn(f"to_{m}", F.col("_m") / F.sum(F.col("_m") / F.col("_n")).over(total)).drop("_m", "_n")
    for _ in range(rounds):
        for m in MARGINS:
            # A value that targets give no share has no mass left to divide.
            out = out.withColumn("mass", F.coalesce(F.try_divide(F.col("mass") * F.col(f"to_{m}"), F.sum("mass").over(Window.partitionBy(m))), F.lit(0.0)))
    return out


def probabilities(cells: DataFrame, share: float = SHARE, **rake_options) -> DataFrame:
    """Adds ``weight`` (fitted over observed share) and ``p`` (probability of a document) to the cells."""
    total = Window.partitionBy(F.lit(1))
    fitted = rake(cells.filter("tokens > 0"), **rake_options).withColumn("weight", F.col("mass") / (F.col("tokens") / F.sum("tokens").over(total)))
    # By falling weight a prefix of the cells is taken whole; the rest share what is left in proportion.
    order = Window.orderBy(F.desc("weight"), *MARGINS)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    left = share * F.sum("tokens").over(total) - F.coalesce(F.sum("tokens").over(before), F.lit(0))
    c = F.try_divide(left, F.sum(F.col("weight") * F.col("tokens")).over(after))
    ok = fitted.withColumn("c", c).withColumn("ok", F.col("c") * F.col("weight") <= 1)
    factor = F.max(F.when(F.col("ok"), F.struct(F.col("weight"), F.col("c")))).over(total)["c"]
    return ok.withColumn("p", F.least(F.lit(1.0), factor * F.col("weight"))).drop("c", "ok")


def _uniform(key: Column, seed: int) -> Column:
    """In [0, 1): the first 8 hex digits of an MD5 of the key and the seed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix(docs: DataFrame, share: float = SHARE, seed: int = 17, targets=None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, broadcast_cells: int = FEW) -> DataFrame:
    """All columns of ``docs`` plus ``_tokens, _topic, _weight, _p, _sampled``.

    Null sources and languages are values of their own (''); documents without words weigh
    nothing and are sampled with probability 1, so that mixing never drops them by chance; the
    draw is a hash of the id, so repeated rows (and null ids) are drawn alike.  ``targets`` gives
    shares of tokens by margin and value; a value that a given margin doesn't list has share zero
    and its documents with words are not sampled.  ``topic_col`` names a column of topics, in place
    of the bucket of the content words.  Extra columns pass through whatever their names (but those
    above, which are replaced); an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = scratch(spark)
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    key, text = place[id_col], place[text_col]
    named = with_topic(docs.toDF(*place.values()), text).withColumns({"_source": F.coalesce(F.col(place[source_col]).cast("string"), F.lit("")), "_lang": F.coalesce(F.col(place[lang_col]).cast("string"), F.lit(""))})
    if topic_col:
        named = named.withColumn("_topic", F.coalesce(F.col(place[topic_col]).cast("string"), F.lit("")))
    cells = named.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic")).agg(F.sum("_tokens").alias("tokens"))
    cells = stored(cells, folder, "cells")
    cells = stored(probabilities(cells, share, targets=targets).select("source", "lang", "topic", "weight", "p"), folder, "p").toDF("_source", "_lang", "_topic", "_weight", "_p")
    if cells.count() <= broadcast_cells:
        joined = named.join(F.broadcast(cells), ["_source", "_lang", "_topic"], "left")
    else:
        salted = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = named.withColumn("_salt", F.pmod(F.xxhash64(key, text), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, ["_source", "_lang", "_topic", "_salt"], "left").drop("_salt")
    p = F.coalesce("_p", F.lit(1.0))
    out = joined.withColumns({"_weight": F.coalesce("_weight", F.lit(1.0)), "_p": p, "_sampled": _uniform(F.col(key), seed) < p})
    return out.select(*[F.col(to).alias(c) for c, to in place.items() if c not in ADDED], *ADDED)
