"""The lattice: every token of a text with all readings that lexicon, fixlist and fallbacks license.

A surface is evaluated once however often it occurs: distinct surfaces meet the lexicon, their
readings are parsed and projected, and the result is joined back to the tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlattice.functions import readings as R
from textlattice.functions import text as X
from textlattice.operators import intervals
from textlattice.operators import phrases as phrases_in
from textlattice.plans.session import shared_folder, written
from textlattice.schemas import READINGS, check_profile

#: A surface is hot if it is more than one in so many tokens: there are fewer hot ones than this.
HOT = 1000
#: Surfaces, and readings of them, up to which all are broadcast.
FEW_SURFACES = 50_000
#: Fixed value: single characters that a backend stream reserves; they read as themselves.
PROTECTED = tuple("\\^$/<>{}[]@#*+~|=&`")


def empty() -> Column:
    return F.array().cast(READINGS)


def once(x: Column) -> Column:
    """A column that no later filter or projection copies into itself: readings are large expressions."""
    return F.explode(F.array(x))


def fixlist_readings(fixlist: DataFrame, profile: str = "universal") -> DataFrame:
    """``(form_key, fixed)``: the readings of each folded form, in order of ``ord``."""
    parsed = fixlist.select("form_key", "ord", once(R.of("parse", "raw", source="fixlist", profile=profile)).alias("r")).filter("r is not null")
    return parsed.groupBy("form_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "r"))), lambda x: x["r"]).alias("fixed"))


def lexicon_readings(lexicon: DataFrame, profile: str = "universal") -> DataFrame:
    """``(surface, read)``: all readings in candidate order, then the aliases they license."""
    parsed = lexicon.select("surface", "cand_idx", once(R.of("parse", "raw", profile=profile)).alias("r")).filter("r is not null")
    grouped = parsed.groupBy("surface").agg(F.transform(F.sort_array(F.collect_list(F.struct("cand_idx", "r"))), lambda x: x["r"]).alias("read"))
    return grouped.select("surface", F.concat("read", R.of("aliases", "read", "surface", profile=profile)).alias("read"))


def surface_readings(surfaces: DataFrame, lexicon: DataFrame, fixlist: DataFrame | None = None, guesses: DataFrame | None = None, profile: str = "universal") -> DataFrame:
    """``(surface, kind, readings)`` of distinct surfaces.

    A fixlist entry replaces all other readings.  Reserved single characters read as punctuation
    or symbols.  Lexical surfaces without any get, in this order,
    the number reading, bounded hypotheses (``guesses(surface, guessed_readings)``), the unknown one.
    """
    check_profile(profile)
    s = surfaces.select("surface").distinct()
    s = s.join(lexicon_readings(lexicon, profile), "surface", "left").withColumn("form_key", X.casefold(F.col("surface")))
    s = s.join(fixlist_readings(fixlist, profile), "form_key", "left") if fixlist is not None else s.withColumn("fixed", F.lit(None).cast(READINGS))
    s = s.join(guesses, "surface", "left") if guesses is not None else s.withColumn("guessed_readings", F.lit(None).cast(READINGS))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    one = F.when(F.col("surface").isin(*PROTECTED), F.array(R.of("protected", "surface")))
    s = s.withColumn("own", R.distinct(F.coalesce(some("fixed"), some("read"), one, empty())))
    s = s.withColumn("k", X.kind_with_readings(F.col("surface"), F.transform("own", lambda r: r["upos"])))
    lexical = F.col("k").isin("word", "number")
    fallback = F.coalesce(
        F.when(F.col("k") == "number", F.array(R.of("number", "surface"))), F.when(F.col("k") == "word", some("guessed_readings")), F.array(R.of("unknown", "surface"))
    )
    s = s.withColumn("readings", F.when((F.size("own") == 0) & lexical, fallback).otherwise(F.col("own")))
    return s.select("surface", X.kind_with_readings(F.col("surface"), F.transform("readings", lambda r: r["upos"])).alias("kind"), "readings")


def read_tokens(t: DataFrame, lexicon: DataFrame, fixlist: DataFrame | None = None, guesses: DataFrame | None = None, profile: str = "universal", surface_col: str = "text") -> DataFrame:
    """Token rows with ``kind, readings, selected, sentence_end``, which replace columns of these names.

    Surfaces are evaluated once each and written.  If they have been counted to be few they are
    broadcast; else the hot ones are, of which there are fewer than HOT, and the other tokens meet
    theirs in a join in which white space and hot tokens are dealt out evenly.
    """
    spark = t.sparkSession
    space = F.col(surface_col).rlike(f"^[{X.WS}]+$")
    counts = t.filter(~space).groupBy(F.col(surface_col).alias("surface")).agg(F.count("*").alias("n_tokens"))
    path = f"{shared_folder(spark)}/surfaces-{uuid.uuid4().hex}"
    # A number of files that small sizes don't lower: reading a surface is more work than its bytes show.
    written(counts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "surface"), f"{path}/counts")
    counts = spark.read.schema("surface string, n_tokens long").parquet(f"{path}/counts")
    written(surface_readings(counts, lexicon, fixlist, guesses, profile), f"{path}/found")
    found = spark.read.schema(f"surface string, kind string, readings {READINGS}").parquet(f"{path}/found")
    n, n_readings = found.agg(F.count("*"), F.sum(F.size("readings"))).first()
    t = t.drop("kind", "readings", "selected", "sentence_end")
    own_cols = ("_key", "_s0", "_k0", "_r0", "_s1", "_k1", "_r1")
    own = lambda df, x: df.select(F.col("surface").alias(f"_s{x}"), F.col("kind").alias(f"_k{x}"), F.col("readings").alias(f"_r{x}"))
    if n + (n_readings or 0) <= FEW_SURFACES:
        t = t.join(F.broadcast(own(found, 0)), F.col(surface_col) == F.col("_s0"), "left")
        kind, read = F.col("_k0"), F.col("_r0")
    else:
        total = counts.agg(F.sum("n_tokens")).first()[0]
        hot = counts.filter(F.col("n_tokens") * HOT > total).select("surface")
        t = t.join(F.broadcast(own(found.join(F.broadcast(hot), "surface", "left_semi"), 0)), F.col(surface_col) == F.col("_s0"), "left")
        # No surface begins with a space and goes on.
        key = F.when(space | F.col("_s0").isNotNull(), F.concat(F.lit(" "), F.pmod(F.xxhash64(*t.columns[:3]), F.lit(9973)).cast("string"))).otherwise(F.col(surface_col))
        t = t.withColumn("_key", key).join(own(found.join(F.broadcast(hot), "surface", "left_anti"), 1), F.col("_key") == F.col("_s1"), "left")
        kind, read = F.coalesce("_k0", "_k1"), F.coalesce("_r0", "_r1")
    t = t.select(*[c for c in t.columns if c not in own_cols], F.coalesce(kind, F.lit("space")).alias("kind"), F.coalesce(read, empty()).alias("readings"))
    r = F.col("readings")
    ends = F.when(F.size(r) > 0, F.exists(r, lambda x: F.array_contains(x["tags"], "sent"))).otherwise(F.coalesce(F.col(surface_col).rlike(r"[.!?]"), F.lit(False)))
    return t.select("*", F.when(F.size(r) == 1, F.lit(0)).alias("selected"), (ends & (F.col("kind") != "space")).alias("sentence_end"))


def analyze(docs: DataFrame, lexicon: DataFrame, fixlist: DataFrame | None = None, guesses: DataFrame | None = None, profile: str = "universal", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token rows ``(id, tok_idx, text, start, end, kind, readings, selected, sentence_end)``.

    ``selected`` is 0 where exactly one reading is left, else null.  A sentence ends at a reading
    tagged ``sent`` or, without readings, at a surface with ``.``, ``!`` or ``?``.
    """
    t = X.explode_tokens(docs, id_col, text_col)
    return read_tokens(t, lexicon, fixlist, guesses, profile).select(id_col, "tok_idx", "text", "start", "end", "kind", "readings", "selected", "sentence_end")


def phrase_spans(docs: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, start, end, token_start, token_end, text)`` where ``phrases(surface)`` stand in the text."""
    return phrases_in.find(docs.select(F.col(id_col), X.tokens(F.col(text_col)).alias("_parts")), phrases, id_col, "_parts")


def span_readings(spans: DataFrame, lexicon: DataFrame, fixlist: DataFrame | None = None, profile: str = "universal") -> DataFrame:
    """Spans with ``readings, selected, sentence_end``: those of the lexicon, to which a fixlist adds; neither is made distinct."""
    s = spans.select(F.col("text").alias("surface")).distinct()
    s = s.join(lexicon_readings(lexicon, profile), "surface", "left").withColumn("form_key", X.casefold(F.col("surface")))
    s = s.join(fixlist_readings(fixlist, profile), "form_key", "left") if fixlist is not None else s.withColumn("fixed", F.lit(None).cast(READINGS))
    s = s.select(F.col("surface").alias("_surface"), F.concat(F.coalesce("read", empty()), F.coalesce("fixed", empty())).alias("readings")).filter(F.size("readings") > 0)
    r = F.col("readings")
    j = spans.join(s, spans["text"] == s["_surface"]).drop("_surface")
    return j.select("*", F.when(F.size(r) == 1, F.lit(0)).alias("selected"), F.exists(r, lambda x: F.array_contains(x["tags"], "sent")).alias("sentence_end"))


span_cover = intervals.span_cover


def generate(lexicon: DataFrame, queries: DataFrame, limit: int = 128) -> DataFrame:
    """Surfaces of ``queries(query_id, lemma, tags)`` through the inverse lexicon, distinct and in order, up to ``limit`` each."""
    if limit < 1:
        raise ValueError("limit must be positive")
    asked = queries.select("query_id", R.lexical_form(F.col("lemma"), F.col("tags")).alias("raw")).filter("raw is not null")
    hits = asked.join(lexicon, "raw").groupBy("query_id", "surface").agg(F.min("cand_idx").alias("first"))
    order = Window.partitionBy("query_id").orderBy("first", "surface")
    return hits.withColumn("ord", (F.row_number().over(order) - 1)).filter(F.col("ord") < limit).select("query_id", "ord", "surface")


def check_partition(tokens: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Violations ``(id, problem)`` of the partition's constraints; none for a sound lattice."""
    w = Window.partitionBy(id_col).orderBy("tok_idx")
    space = F.col("text").rlike(f"^[{X.WS}]+$")
    t = tokens.withColumn("prev", F.coalesce(F.lag("end").over(w), F.lit(0)))
    problem = (
        F.when(F.length("text") == 0, "empty token").when(F.col("start") != F.col("prev"), "gap or overlap").when(F.col("end") != F.col("start") + F.length("text"), "length")
        .when(~space & F.col("text").rlike(f"[{X.WS}]"), "white space inside a token")
    )
    own = t.select(id_col, problem.alias("problem")).filter("problem is not null")
    whole = tokens.groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tok_idx", "text"))), lambda x: x["text"]), "").alias("joined"))
    lost = docs.join(whole, id_col, "left").filter(F.coalesce("joined", F.lit("")) != F.coalesce(text_col, F.lit(""))).select(id_col, F.lit("text is not restored").alias("problem"))
    return own.unionByName(lost)


def check_edges(edges: DataFrame) -> DataFrame:
    """Violations ``(row_id, edge, start, end, problem)`` of a lattice's constraints (``Engine.lattice``); none for a sound one.

    Tokens are one path from 0 to the end of the text; a span starts and ends on nodes of that path,
    which makes it a way around the tokens it says it covers.
    """
    own = ["row_id", "edge", "start", "end"]
    t = edges.filter("edge = 'token'")
    w = Window.partitionBy("row_id").orderBy("token_start")
    broken = F.when(F.col("start") != F.coalesce(F.lag("end").over(w), F.lit(0)), "tokens are no path").when(F.col("token_end") != F.col("token_start") + 1, "a token of several")
    bad = t.select(*own, broken.alias("problem"))
    at = lambda end: t.select(F.col("row_id").alias(f"_r{end}"), F.col(f"token_{end}").alias(f"_t{end}"), F.col(end).alias(f"_{end}"))
    s, a, b = edges.filter("edge = 'span'"), at("start"), at("end")
    s = s.join(a, (s["row_id"] == a["_rstart"]) & (s["token_start"] == a["_tstart"]), "left").join(b, (s["row_id"] == b["_rend"]) & (s["token_end"] == b["_tend"]), "left")
    off = (
        F.when(F.col("_start").isNull() | (F.col("start") != F.col("_start")), "span starts off the path").when(F.col("_end").isNull() | (F.col("end") != F.col("_end")), "span ends off the path")
        .when(F.col("token_end") - F.col("token_start") < 2, "span of one token")
    )
    return bad.unionByName(s.select(*own, off.alias("problem"))).filter("problem is not null")
