"""CoNLL-U gold as DataFrames, parsed natively from whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlattice.functions import text as X


def features(x: Column) -> Column:
    """FEATS as a sorted array of (k, v); ``_`` is empty."""
    pairs = F.transform(F.split(x, r"\|"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_extract(p, "=(.*)$", 1).alias("v")))
    return F.when(x.isin("_", ""), F.array().cast("array<struct<k:string,v:string>>")).otherwise(F.sort_array(pairs))


def bad_features(x: Column) -> Column:
    """Whether FEATS has an item without ``k=v`` or a key twice."""
    items = F.split(x, r"\|")
    keys = F.transform(items, lambda p: F.substring_index(p, "=", 1))
    return ~x.isin("_", "") & (F.exists(items, lambda p: ~p.rlike("^[^=]+=.+$")) | (F.size(F.array_distinct(keys)) < F.size(keys)))


def misc(x: Column) -> Column:
    """MISC as (k, v); a bare flag has the value ``Yes``."""
    pair = lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.contains(p, F.lit("=")), F.regexp_extract(p, "=(.*)$", 1)).otherwise("Yes").alias("v"))
    return F.when(x.isin("_", ""), F.array().cast("array<struct<k:string,v:string>>")).otherwise(F.transform(F.split(x, r"\|"), pair))


def spaces(x: Column) -> Column:
    r"""Decodes ``\s \n \t \r \p \\`` from left to right."""
    known = {"\\s": " ", "\\n": "\n", "\\t": "\t", "\\r": "\r", "\\p": "|", "\\\\": "\\"}
    pieces = F.regexp_extract_all(x, F.lit(r"(?s)(\\.|[^\\]++|\\)"), F.lit(1))
    table = F.create_map(*[F.lit(y) for kv in known.items() for y in kv])
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")


def _value(m: Column, key: str) -> Column:
    return F.try_element_at(F.filter(m, lambda p: p["k"] == key), F.lit(1))["v"]


def lines(texts: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``(path, sent_no, line_no, line)`` of non-blank lines; a byte-order mark is dropped."""
    clean = F.regexp_replace(F.regexp_replace(text_col, r"^\x{feff}", ""), "\r\n?", "\n")
    rows = texts.select(path_col, F.posexplode(F.split(clean, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
    w = Window.partitionBy(path_col).orderBy("line_no")
    blank = F.trim("line") == ""
    rows = rows.withColumn("sent_no", F.sum(blank.cast("int")).over(w))
    return rows.filter(~blank).select(path_col, "sent_no", "line_no", "line")


def parse(texts: DataFrame, path_col: str = "path", text_col: str = "text") -> dict[str, DataFrame]:
    """``tokens``, ``multiword``, ``sentences`` and ``errors`` of gold files; sentences are ``path#number``."""
    all_lines = lines(texts, path_col, text_col).withColumn("sent_id", F.concat_ws("#", path_col, "sent_no"))
    comment = F.startswith("line", F.lit("#"))
    cells = F.split("line", "\t")
    data = all_lines.filter(~comment).withColumn("c", cells)
    sound = data.filter(F.size("c") == 10)
    plain, span, empty = r"^[0-9]+$", r"^[0-9]+-[0-9]+$", r"^[0-9]+\.[0-9]+$"
    tok_id = F.col("c")[0]
    message = (
        F.when(F.size("c") != 10, "expected 10 columns").when(~tok_id.rlike(f"{plain}|{span}|{empty}"), "malformed id")
        .when(tok_id.rlike(plain) & bad_features(F.col("c")[5]), "malformed features")
    )
    errors = data.select(path_col, "line_no", message.alias("message")).filter("message is not null")
    words = sound.filter(tok_id.rlike(plain))
    tokens = words.select(
        "sent_id", (F.row_number().over(Window.partitionBy("sent_id").orderBy("line_no")) - 1).alias("ordinal"), tok_id.cast("int").alias("tok_id"),
        F.col("c")[1].alias("form"), F.col("c")[2].alias("lemma"), F.upper(F.col("c")[3]).alias("upos"), features(F.col("c")[5]).alias("features"), misc(F.col("c")[9]).alias("misc"), "line_no",
    )
    multiword = sound.filter(tok_id.rlike(span)).select(
        "sent_id", F.substring_index(tok_id, "-", 1).cast("int").alias("start_id"), F.substring_index(tok_id, "-", -1).cast("int").alias("end_id"), F.col("c")[1].alias("form"), misc(F.col("c")[9]).alias("misc"), "line_no"
    )
    said = all_lines.filter(comment).select("sent_id", F.regexp_extract("line", r"^#\s*text\s*=\s*(.*)$", 1).alias("text"), F.col("line").rlike(r"^#\s*text\s*=").alias("is_text"))
    said = said.filter("is_text").groupBy("sent_id").agg(F.first("text").alias("comment"))
    inside = tokens.join(multiword.select(F.col("sent_id").alias("s"), "start_id", "end_id"), (F.col("s") == F.col("sent_id")) & F.col("tok_id").between(F.col("start_id"), F.col("end_id")), "left_anti")
    shown = inside.select("sent_id", "line_no", "form", "misc").unionByName(multiword.select("sent_id", "line_no", "form", "misc"))
    after = F.when(_value(F.col("misc"), "SpaceAfter") == "No", "").when(_value(F.col("misc"), "SpacesAfter").isNotNull(), spaces(_value(F.col("misc"), "SpacesAfter"))).otherwise(" ")
    shown = shown.select("sent_id", F.struct("line_no", F.concat(F.coalesce(spaces(_value(F.col("misc"), "SpacesBefore")), F.lit("")), "form", after).alias("x")).alias("p"))
    built = shown.groupBy("sent_id").agg(F.rtrim(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["x"]), "")).alias("built"))
    nodes = sound.groupBy("sent_id").agg(F.count_if(tok_id.rlike(empty)).alias("empty_nodes"))
    sentences = nodes.join(built, "sent_id", "left").join(said, "sent_id", "left").select(
        "sent_id", F.coalesce("comment", "built").alias("text"), F.col("comment").isNotNull().alias("used_text_comment"), "empty_nodes"
    )
    return {"tokens": tokens.drop("line_no"), "multiword": multiword.drop("line_no"), "sentences": sentences, "errors": errors}
