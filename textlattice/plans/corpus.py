"""Queries over the driver's tables, with the same query in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlattice.functions import text as X
from textlattice.operators import evaluate as E
from textlattice.operators import intervals as I
from textlattice.operators import lattice as L
from textlattice.sources import files

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table; one of fewer partitions than there are cores (a small file) is dealt out to all of them."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "conversations") and df.rdd.getNumPartitions() < cores else df


RX, WS = X.TOKEN_PLAIN, X.WS
KIND = f"CASE WHEN regexp_matches(tok, '^[{WS}]*$') THEN 'space' WHEN regexp_matches(tok, '\\p{{L}}') THEN 'word' WHEN regexp_matches(tok, '^\\p{{N}}+$') THEN 'number' WHEN regexp_matches(tok, '^\\p{{P}}+$') THEN 'punct' ELSE 'symbol' END"
TOKS = f"SELECT doc_id, lang, unnest(regexp_extract_all(text, '{RX}')) AS tok FROM documents"
PLACED = f"""tk AS (SELECT doc_id, lang, unnest(list_zip(regexp_extract_all(text, '{RX}'), range(len(regexp_extract_all(text, '{RX}'))))) AS z FROM documents),
placed AS (SELECT doc_id, lang, z[1] AS tok, CAST(z[2] AS INT) AS idx FROM tk),
offs AS (SELECT *, sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY idx) AS e FROM placed)"""
FOLD = "translate(replace(replace(lower({0}), 'ß', 'ss'), 'ŉ', 'ʼn'), 'ς', 'σ')"


def counted(docs: DataFrame) -> DataFrame:
    """(lang, tok, n): what depends on the surface alone is computed once for each."""
    return docs.select("lang", F.explode(X.tokens(F.col("text"))).alias("tok")).groupBy("lang", "tok").agg(F.count("*").alias("n"))


@query(f"SELECT lang, kind, count(*) AS n_tokens, count(DISTINCT tok) AS n_types FROM (SELECT lang, tok, {KIND} AS kind FROM ({TOKS})) GROUP BY ALL")
def token_kind_by_lang(spark, sf):
    """Tokens and types by language and kind."""
    return counted(t(spark, sf, "documents")).groupBy("lang", X.kind(F.col("tok")).alias("kind")).agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_types"))


@query(f"WITH {PLACED} SELECT doc_id, count(*) AS n_tokens, CAST(max(e) AS BIGINT) AS last_end, CAST(sum(e * (idx % 97)) AS BIGINT) AS check_sum FROM offs GROUP BY doc_id")
def token_offsets(spark, sf):
    """Offsets of all tokens, as a check sum per document."""
    tok = X.explode_tokens(t(spark, sf, "documents"))
    return tok.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.max("end").cast("long").alias("last_end"), F.sum(F.col("end").cast("long") * (F.col("tok_idx") % 97)).alias("check_sum"))


@query(f"SELECT count(*) AS n_docs, CAST(sum(CASE WHEN array_to_string(regexp_extract_all(text, '{RX}'), '') = text THEN 0 ELSE 1 END) AS BIGINT) AS n_lossy FROM documents")
def lossless_check(spark, sf):
    """Documents whose tokens do not restore them: none."""
    d = t(spark, sf, "documents")
    return d.agg(F.count("*").alias("n_docs"), F.sum(F.when(F.array_join(X.tokens(F.col("text")), "") == F.col("text"), 0).otherwise(1)).alias("n_lossy"))


@query(f"""WITH {PLACED}, s AS (SELECT *, CASE WHEN regexp_matches(tok, '[.!?]') THEN 1 ELSE 0 END AS e_ FROM placed WHERE NOT regexp_matches(tok, '^[{WS}]+$')),
n AS (SELECT *, coalesce(sum(e_) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM s),
g AS (SELECT lang, doc_id, sent, count(*) AS len FROM n GROUP BY ALL)
SELECT lang, count(*) AS n_sentences, max(len) AS longest, round(avg(len), 6) AS mean_len FROM g GROUP BY lang""")
def sentence_stats(spark, sf):
    """Sentences by language: number, longest and mean length in tokens."""
    d = t(spark, sf, "documents")
    tok = X.explode_tokens(d).filter(~F.col("text").rlike(f"^[{WS}]+$")).withColumn("sentence_end", F.col("text").rlike("[.!?]"))
    s = E.sentence_ids(tok).groupBy("doc_id", "sent_no").agg(F.count("*").alias("len")).join(d.select("doc_id", "lang"), "doc_id")
    return s.groupBy("lang").agg(F.count("*").alias("n_sentences"), F.max("len").alias("longest"), F.round(F.avg("len"), 6).alias("mean_len"))


@query("""WITH l AS (SELECT doc_id, unnest(list_zip(x, range(len(x)))) AS z FROM (SELECT doc_id, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS x FROM documents)),
r AS (SELECT doc_id, z[1] AS line, sum(length(z[1])) OVER (PARTITION BY doc_id ORDER BY z[2]) AS e FROM l)
SELECT doc_id, count(*) AS n_lines, CAST(max(e) AS BIGINT) AS n_chars FROM r WHERE e <= 1000 GROUP BY doc_id""")
def line_prefix(spark, sf):
    """Whole lines within the first 1,000 characters of each document."""
    p = X.whole_line_prefix(t(spark, sf, "documents"), 1000)
    return p.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max("end").cast("long").alias("n_chars"))


@query("""SELECT surface, n FROM (SELECT unnest(regexp_extract_all(text, '[^\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+')) AS surface FROM documents)
JOIN (SELECT 1) ON length(surface) <= 256 GROUP BY surface HAVING (n := count(*)) > 0 ORDER BY n DESC, surface LIMIT 50""".replace("HAVING (n := count(*)) > 0 ", "").replace("SELECT surface, n FROM", "SELECT surface, count(*) AS n FROM"))
def surface_inventory_top(spark, sf):
    """The 50 commonest white-space parted surfaces."""
    d = t(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(f"[^{WS}]+"), F.lit(0))).alias("surface")).filter(F.length("surface") <= 256)
    return d.groupBy("surface").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "surface").limit(50)


@query(f"SELECT lang, count(DISTINCT translate({FOLD.format('tok')}, '‘’ʼʻ‐‑‒–—−', '''''''''------')) AS n_keys FROM ({TOKS}) WHERE NOT regexp_matches(tok, '^[{WS}]+$') GROUP BY lang".replace("'''''''''------'", "'''''''''------'"))
def alignment_keys(spark, sf):
    """Distinct alignment keys by language."""
    c = counted(t(spark, sf, "documents")).filter(~F.col("tok").rlike(f"^[{WS}]+$"))
    return c.select("lang", X.alignment_key(F.col("tok")).alias("k")).distinct().groupBy("lang").agg(F.count("*").alias("n_keys"))


@query("""SELECT chain, count(*) AS n FROM (SELECT unnest(regexp_extract_all(url, '[\\p{L}\\p{M}\\p{N}]+(?:[\\x{2d}\\x{2010}\\x{2011}][\\p{L}\\p{M}\\p{N}]+)+')) AS chain FROM pages) GROUP BY chain""")
def hyphen_chains(spark, sf):
    """Hyphenated chains in URLs."""
    return t(spark, sf, "pages").select(F.explode(X.hyphen_chains(F.col("url"))).alias("chain")).groupBy("chain").agg(F.count("*").alias("n"))


BIGRAMS = f"""bt AS (SELECT item_id, regexp_extract_all(text, '{RX}') AS x FROM benchmark),
bg AS (SELECT DISTINCT x[i] || x[i + 1] || x[i + 2] AS phrase FROM bt, range(1, 4000) r(i) WHERE i + 2 <= len(x) AND regexp_matches(x[i], '\\p{{L}}') AND x[i + 1] = ' ' AND regexp_matches(x[i + 2], '\\p{{L}}'))"""


@query(f"""WITH {BIGRAMS}, {PLACED.replace('offs AS', 'offs0 AS')},
w AS (SELECT doc_id, tok || lead(tok, 1) OVER o || lead(tok, 2) OVER o AS phrase FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY idx))
SELECT phrase AS text, count(*) AS n FROM w SEMI JOIN bg USING (phrase) GROUP BY phrase""")
def phrase_hits(spark, sf):
    """Two-word phrases of the benchmark in the documents."""
    b = t(spark, sf, "benchmark").select("item_id", F.posexplode(X.tokens(F.col("text"))).alias("i", "a"))
    w = Window.partitionBy("item_id").orderBy("i")
    b = b.select("a", F.lead("a", 1).over(w).alias("s"), F.lead("a", 2).over(w).alias("b")).filter("a rlike '\\\\p{L}' and s = ' ' and b rlike '\\\\p{L}'")
    spans = L.phrase_spans(t(spark, sf, "documents"), b.select(F.concat("a", "s", "b").alias("surface")).distinct())
    return spans.groupBy("text").agg(F.count("*").alias("n"))


LEX = f"lex AS (SELECT DISTINCT tok AS surface FROM (SELECT unnest(regexp_extract_all(text, '{RX}')) AS tok FROM benchmark) WHERE regexp_matches(tok, '\\p{{L}}'))"


def bench_lexicon(spark, sf) -> DataFrame:
    words = t(spark, sf, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("surface")).filter(F.col("surface").rlike(r"\p{L}")).distinct()
    return words.select("surface", F.lit(0).alias("cand_idx"), F.concat(X.casefold(F.col("surface")), F.lit("<n><nom>")).alias("raw"))


@query(f"""WITH {LEX}, w AS (SELECT lang, tok FROM ({TOKS}) WHERE regexp_matches(tok, '\\p{{L}}'))
SELECT lang, count(*) AS n_words, count(surface) AS n_known, count(*) - count(surface) AS n_oov, count(DISTINCT CASE WHEN surface IS NULL THEN tok END) AS oov_types, round(count(surface) / count(*), 6) AS coverage
FROM w LEFT JOIN lex ON tok = surface GROUP BY lang""")
def lexicon_coverage(spark, sf):
    """Words of the documents that the benchmark's vocabulary knows."""
    c = counted(t(spark, sf, "documents")).filter(F.col("tok").rlike(r"\p{L}"))
    j = c.join(bench_lexicon(spark, sf).select("surface"), c["tok"] == F.col("surface"), "left")
    known = F.sum(F.when(F.col("surface").isNotNull(), F.col("n")).otherwise(0))
    return j.groupBy("lang").agg(
        F.sum("n").alias("n_words"), known.alias("n_known"), (F.sum("n") - known).alias("n_oov"), F.count(F.when(F.col("surface").isNull(), 1)).alias("oov_types"), F.round(known / F.sum("n"), 6).alias("coverage")
    )


@query(f"""WITH {LEX}, w AS (SELECT tok, {KIND} AS kind FROM (SELECT unnest(regexp_extract_all(text, '{RX}')) AS tok FROM conversations))
SELECT count(*) AS lexical_tokens, CAST(sum(CASE WHEN kind = 'word' AND surface IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS dictionary, CAST(0 AS BIGINT) AS fixlist, CAST(0 AS BIGINT) AS guesser,
CAST(sum(CASE WHEN kind = 'number' THEN 1 ELSE 0 END) AS BIGINT) AS rule, CAST(0 AS BIGINT) AS base_guess, CAST(sum(CASE WHEN kind = 'word' AND surface IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS "unknown", CAST(0 AS BIGINT) AS zero,
count(*) AS candidates, CAST(1.0 AS DOUBLE) AS mean_candidates, CAST(1 AS INT) AS max_candidates FROM w LEFT JOIN lex ON tok = surface WHERE kind IN ('word', 'number')""")
def lattice_coverage(spark, sf):
    """Origin of the readings of every lexical token of the conversations, over the whole lattice."""
    d = t(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text")
    return E.coverage(L.analyze(d, bench_lexicon(spark, sf)))


@query(f"""WITH b AS (SELECT DISTINCT tok FROM (SELECT unnest(regexp_extract_all(text, '{RX}')) AS tok FROM benchmark)), k AS (SELECT tok, {KIND} AS kind FROM b)
SELECT tok AS surface, kind, CASE kind WHEN 'number' THEN tok || '<num>' ELSE {FOLD.format('tok')} || '<unknown>' END AS raw, CASE kind WHEN 'number' THEN 'rule' ELSE 'unknown' END AS source, CASE kind WHEN 'number' THEN 'NUM' ELSE 'X' END AS upos
FROM k WHERE kind IN ('word', 'number')""")
def fallback_readings(spark, sf):
    """What tokens without any reading get."""
    s = t(spark, sf, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("surface"))
    none = spark.createDataFrame([], "surface string, cand_idx int, raw string")
    r = L.surface_readings(s, none).filter("kind in ('word', 'number')").select("surface", "kind", F.explode("readings").alias("r"))
    return r.select("surface", "kind", "r.raw", "r.source", "r.upos")


@query("SELECT conv_id, turn, replace(replace(replace(replace(replace(text, '\\', '\\\\'), '_', '\\_'), ' ', '_'), chr(13), '\\r'), chr(10), '\\n') AS escaped FROM conversations")
def gap_escape(spark, sf):
    """Gaps of the conversations made visible."""
    return t(spark, sf, "conversations").select("conv_id", "turn", X.escape_gap(F.col("text")).alias("escaped"))


@query("SELECT page_id, CAST(CASE WHEN regexp_matches(html, '[^\\x{9}\\x{a}\\x{d}\\x{20}-\\x{d7ff}\\x{e000}-\\x{fffd}\\x{10000}-\\x{10ffff}]') THEN 1 ELSE 0 END AS INT) AS forbidden, length(replace(replace(replace(html, '&', '&amp;'), '>', '&gt;'), '<', '&lt;')) AS n_escaped FROM pages")
def xml_repertoire(spark, sf):
    """Pages that XML 1.0 cannot hold, and the length of their escaped text."""
    return t(spark, sf, "pages").select("page_id", (X.xml_forbidden(F.col("html")) > 0).cast("int").alias("forbidden"), F.length(X.escape_xml(F.col("html"))).cast("long").alias("n_escaped"))


@query(f"""WITH {PLACED}, s AS (SELECT doc_id, unnest([0, 1, 2]) AS span_idx, unnest([0, 10, 25]) AS s, unnest([7, 30, 26]) AS t FROM documents WHERE length(text) >= 40)
SELECT s.doc_id, CAST(span_idx AS INT) AS span_idx, CAST(s AS INT) AS "start", CAST(t AS INT) AS "end", CAST(min(idx) AS INT) AS token_start, CAST(max(idx) + 1 AS INT) AS token_end FROM s JOIN offs ON s.doc_id = offs.doc_id AND e > s AND e - length(tok) < t GROUP BY ALL""")
def span_token_coverage(spark, sf):
    """Tokens that three character spans of each document touch."""
    at = ((0, 7), (10, 30), (25, 26))
    d = t(spark, sf, "documents").filter(F.length("text") >= 40).select("doc_id", X.token_ends(X.tokens(F.col("text"))).alias("e"))
    starts, stops = (F.array(*[F.lit(p[k]) for p in at]) for k in (0, 1))
    d = d.select("doc_id", F.posexplode(F.arrays_zip(starts.alias("start"), stops.alias("end"), I.cover_in_row(F.col("e"), starts, stops).alias("c"))).alias("span_idx", "z"))
    return d.filter("z.c is not null").select("doc_id", "span_idx", "z.start", "z.end", "z.c.token_start", "z.c.token_end")


@query("""SELECT event_type, count(value) AS n, min(value) AS min, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stdev FROM events GROUP BY event_type""")
def latency_summary(spark, sf):
    """Exact percentiles of event values."""
    s = E.latency(t(spark, sf, "events"), "value", "event_type")
    return s.select("event_type", "n", "min", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")], "max", *[F.round(c, 6).alias(c) for c in ("mean", "stdev")])


@query(f"""SELECT source, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(len(regexp_extract_all(text, '{RX}'))) AS BIGINT) AS tokens, round(count(*) / 2.5::DOUBLE, 6) AS calls_per_s,
round(sum(len(regexp_extract_all(text, '{RX}'))) / 2.5::DOUBLE, 6) AS tokens_per_s, round(sum(length(text)) / 2.5::DOUBLE, 6) AS chars_per_s, round(sum(strlen(text)) / 2.5::DOUBLE, 6) AS bytes_per_s FROM documents GROUP BY source""")
def throughput_by_source(spark, sf):
    """Volumes by source, and rates at a stated elapsed time."""
    g = t(spark, sf, "documents").groupBy("source").agg(
        F.count("*").alias("calls"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.size(X.tokens(F.col("text")))).alias("tokens")
    )
    return E.throughput(g.withColumn("s", F.lit(2.5)), "s", "calls", "tokens", "chars", "bytes").drop("s")


@query(f"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{RX}')) AS tok FROM conversations), d AS (SELECT DISTINCT tok FROM ({TOKS}) WHERE regexp_matches(tok, '\\p{{L}}'))
SELECT conv_id, count(*) AS n_words, count(d.tok) AS n_known FROM w LEFT JOIN d ON w.tok = d.tok WHERE regexp_matches(w.tok, '\\p{{L}}') GROUP BY conv_id""")
def conversation_lexicon(spark, sf):
    """Words of conversations that occur in documents."""
    w = t(spark, sf, "conversations").select("conv_id", F.explode(X.tokens(F.col("text"))).alias("tok")).filter(F.col("tok").rlike(r"\p{L}")).groupBy("conv_id", "tok").agg(F.count("*").alias("n"))
    d = counted(t(spark, sf, "documents")).filter(F.col("tok").rlike(r"\p{L}")).select("tok").distinct().withColumn("k", F.lit(1))
    return w.join(d, "tok", "left").groupBy("conv_id").agg(F.sum("n").alias("n_words"), F.sum(F.when(F.col("k") == 1, F.col("n")).otherwise(0)).alias("n_known"))


@query(f"""WITH {LEX}, w AS (SELECT doc_id, tok FROM ({TOKS}) WHERE regexp_matches(tok, '\\p{{L}}')), r AS (SELECT doc_id, count(*) AS n, count(*) - count(surface) AS u FROM w LEFT JOIN lex ON tok = surface GROUP BY doc_id)
SELECT quality, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words, CAST(sum(u) AS BIGINT) AS n_unknown, round(sum(u) / sum(n), 6) AS unknown_rate FROM r JOIN labels USING (doc_id) GROUP BY quality""")
def quality_vs_unknown(spark, sf):
    """Share of unknown words by quality label."""
    d = t(spark, sf, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("tok")).filter(F.col("tok").rlike(r"\p{L}")).groupBy("doc_id", "tok").agg(F.count("*").alias("n"))
    j = d.join(bench_lexicon(spark, sf).select("surface"), d["tok"] == F.col("surface"), "left").groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("surface").isNull(), F.col("n")).otherwise(0)).alias("u"))
    j = j.join(t(spark, sf, "labels"), "doc_id")
    return j.groupBy("quality").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_words"), F.sum("u").alias("n_unknown"), F.round(F.sum("u") / F.sum("n"), 6).alias("unknown_rate"))


@query("SELECT doc_id, lang, sha256(text) AS sha FROM documents WHERE lang = 'en' AND trim(text) <> '' ORDER BY doc_id LIMIT 100")
def ordered_sample(spark, sf):
    """The first 100 English documents with a text, and their digests."""
    s = files.sample(t(spark, sf, "documents"), 100, "doc_id", where=F.col("lang") == "en")
    return s.select("doc_id", "lang", F.sha2("text", 256).alias("sha"))


@query(f"SELECT lang, kind, count(*) AS n FROM (SELECT lang, {KIND} AS kind FROM ({TOKS})) GROUP BY CUBE (lang, kind)")
def scope_cube(spark, sf):
    """Token counts by every grouping of language and kind."""
    c = counted(t(spark, sf, "documents")).groupBy("lang", X.kind(F.col("tok")).alias("kind")).agg(F.sum("n").alias("n"))
    return c.cube("lang", "kind").agg(F.sum("n").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf):
    """Tumbling windows over events (beyond the base feature set)."""
    g = t(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n")


@query("""SELECT doc_id, CASE WHEN e = 0 THEN 0 ELSE 1 END AS has_sharp_s, folded_md5 FROM (SELECT doc_id, strlen(text) - strlen(replace(text, 'ß', '')) AS e, md5(""" + FOLD.format("text") + """) AS folded_md5 FROM documents)""")
def casefold_documents(spark, sf):
    """Case folds of whole documents."""
    return t(spark, sf, "documents").select("doc_id", F.when(F.contains("text", F.lit("ß")), 1).otherwise(0).alias("has_sharp_s"), F.md5(X.casefold(F.col("text")).cast("binary")).alias("folded_md5"))


@query("SELECT doc_id, md5(nfc_normalize(text)) AS nfc_md5 FROM documents")
def nfc_documents(spark, sf):
    """Canonical composition of whole documents."""
    return t(spark, sf, "documents").select("doc_id", F.md5(X.nfc(F.col("text")).cast("binary")).alias("nfc_md5"))

