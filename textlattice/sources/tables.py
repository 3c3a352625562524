"""Small text sources: fixlists, transducer text, the backend stream, probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlattice.functions import text as X

#: A unit, an unterminated unit (up to the end), a gap, or any one character.
UNIT = r"(?s)\^(?:\\.|[^\\$])*\$|\^(?:\\.|[^\\$])*\z|(?:\\.|[^\\^])+|."


def fixlist(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(form_key, ord, raw)`` and ``(line_no, message)`` of ``lines(line_no, line)``: JSON objects or three tab-separated cells.

    Forms are keyed by case fold; several lines of one form keep their order.
    """
    live = lines.filter((F.trim("line") != "") & ~F.startswith(F.ltrim("line"), F.lit("#")))
    is_json = F.startswith(F.ltrim("line"), F.lit("{"))
    j = F.from_json("line", "form string, lemma string, tags array<string>")
    has_tags = F.get_json_object("line", "$.tags").isNotNull()
    c = F.split("line", "\t")
    angle = F.regexp_extract_all(F.get(c, F.lit(2)), F.lit("<([^<>]+)>"), F.lit(1))
    comma = F.filter(F.transform(F.split(F.get(c, F.lit(2)), ","), lambda t: F.trim(t)), lambda t: t != "")
    rows = live.select(
        "line_no", is_json.alias("is_json"), F.when(is_json, j["form"]).otherwise(F.trim(F.get(c, F.lit(0)))).alias("form"), F.when(is_json, j["lemma"]).otherwise(F.trim(F.get(c, F.lit(1)))).alias("lemma"),
        F.when(is_json & ~has_tags, F.array(F.lit("x"))).when(is_json, j["tags"]).when(F.contains(F.get(c, F.lit(2)), F.lit("<")), angle).otherwise(comma).alias("tags"),
        F.when(~is_json & (F.size(c) != 3), "expected 3 columns").when(is_json & j.isNull(), "malformed JSON").alias("bad"),
    )
    message = (
        F.when(F.col("bad").isNotNull(), F.col("bad")).when(F.coalesce("form", F.lit("")) == "", "missing form").when(F.coalesce("lemma", F.lit("")) == "", "missing lemma")
        .when(F.col("tags").isNull() | (F.size("tags") == 0) | F.exists("tags", lambda t: t.isNull() | (t == "")), "malformed tags")
    )
    rows = rows.withColumn("message", message)
    good = rows.filter("message is null").withColumn("form_key", X.casefold(F.col("form")))
    lemma = F.replace(F.replace(F.replace(F.col("lemma"), F.lit("\\"), F.lit("\\\\")), F.lit("+"), F.lit("\\+")), F.lit("<"), F.lit("\\<"))
    raw = F.concat(lemma, F.array_join(F.transform("tags", lambda t: F.concat(F.lit("<"), t, F.lit(">"))), ""))
    order = Window.partitionBy("form_key").orderBy("line_no")
    return good.select("form_key", (F.row_number().over(order) - 1).alias("ord"), raw.alias("raw")), rows.filter("message is not null").select("line_no", "message")


def transducer(lines: DataFrame) -> dict[str, DataFrame]:
    """``arcs``, ``finals`` and ``errors`` of AT&T text ``lines(line_no, line)``; only weight zero is accepted."""
    c = F.split("line", "\t")
    rows = lines.filter(F.trim("line") != "").select("line_no", c.alias("c"), F.size(c).alias("n"))
    number = lambda x: x.rlike("^[0-9]+$")
    weight = F.when(F.col("n").isin(2, 5), F.element_at("c", -1)).otherwise("0").try_cast("double")
    bad = (
        F.when(~F.col("n").isin(1, 2, 4, 5), "expected 1, 2, 4 or 5 columns").when(~number(F.col("c")[0]) | (F.col("n") >= 4) & ~number(F.get("c", F.lit(1))), "malformed state")
        .when(weight.isNull() | (weight != 0), "weight is not zero")
    )
    rows = rows.withColumn("message", bad)
    sym = lambda x: F.when(x.isin("@0@", "@_EPSILON_SYMBOL_@", "ε"), "").when(x == "@_SPACE_@", " ").when(x == "@_TAB_@", "\t").otherwise(x)
    good = rows.filter("message is null")
    cell = lambda i: F.get("c", F.lit(i))
    return {
        "arcs": good.filter("n >= 4").select(cell(0).cast("int").alias("src"), cell(1).cast("int").alias("dst"), sym(cell(2)).alias("isym"), sym(cell(3)).alias("osym")),
        "finals": good.filter("n <= 2").select(cell(0).cast("int").alias("state")).distinct(),
        "errors": rows.filter("message is not null").select("line_no", "message"),
    }


def stream_units(x: Column) -> Column:
    """Units and gaps of a backend stream as (text, readings); an unterminated unit is plain text, empty readings go."""

    def unit(u: Column) -> Column:
        inner = F.substring(u, F.lit(2), F.length(u) - 2)
        parts = X.split_unescaped(inner, "/")
        readings = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda r: r != "")
        whole = F.startswith(u, F.lit("^")) & F.endswith(u, F.lit("$")) & (F.length(u) >= 2)
        return F.when(whole, F.struct(X.unescape(F.get(parts, F.lit(0))).alias("text"), readings.alias("readings"))).otherwise(
            F.struct(X.unescape(u).alias("text"), F.array().cast("array<string>").alias("readings"))
        )

    return F.transform(F.regexp_extract_all(x, F.lit(UNIT), F.lit(0)), unit)


def bad_probes(probes: DataFrame) -> DataFrame:
    """Probes ``(surface, expected, tracked)`` that are empty, not folded, repeated or without lists."""
    w = Window.partitionBy("surface")
    problem = (
        F.when(F.coalesce("surface", F.lit("")) == "", "empty").when(X.casefold(F.col("surface")) != F.col("surface"), "not folded")
        .when(F.count("*").over(w) > 1, "repeated").when(F.col("expected").isNull() | F.col("tracked").isNull(), "no list")
    )
    return probes.select("surface", problem.alias("problem")).filter("problem is not null")


def probe_gate(probes: DataFrame, readings: DataFrame) -> DataFrame:
    """Per probe what is missing of ``expected`` and what of ``tracked`` is there, given ``readings(surface, raw)``."""
    got = readings.groupBy("surface").agg(F.collect_set("raw").alias("raws"))
    j = probes.join(got, "surface", "left").withColumn("raws", F.coalesce("raws", F.array().cast("array<string>")))
    return j.select("surface", (F.size("raws") > 0).alias("has_readings"), F.sort_array(F.array_except("expected", "raws")).alias("missing"), F.sort_array(F.array_intersect("tracked", "raws")).alias("tracked_present"))
