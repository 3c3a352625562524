"""The thin queries of the thirteen operators, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    import public_tokenizers

    from .bpe import encode_documents

    out = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 4-word shingles, links at 4 bits."""
    from .simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"), distance=4, width=4)
    return out.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rules and outlier verdict of every document."""
    from .quality import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("d2", 3).alias("d2"))


@query
def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings of documents before it."""
    from .substrings import remove_repeats

    docs = table(spark, sf_dir, "documents")
    out = remove_repeats(docs, 50)
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(
        "doc_id",
        (F.octet_length("kept") + length).cast("long").alias("n_bytes"),
        length.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products of every fiftieth vector."""
    from .mtree import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0)


ORACLES["op10_top_k"] = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a fifth of the ids is held out of the labels."""
    from .toxicity import toxicity

    fold = lambda c: F.crc32(c.cast("string").cast("binary")) % 5 == 0
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~fold(F.col("doc_id")))
    return out.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "evidence_ids",
    )


@query
def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    from .urls import judge_urls

    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template")


ORACLES["op6_urls"] = r"""
WITH r AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), u AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
    list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM h
), base AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled,
    list_concat(list_transform(parts[1:6], lambda s: CASE WHEN regexp_matches(s, '^(?:[^0-9]*[0-9][^.]*|[0-9a-fA-F-]{16,}|[^.]{40,})(\.[A-Za-z0-9]{1,5})?$')
      THEN '*' || regexp_extract(s, '(\.[A-Za-z0-9]{1,5})$', 1) ELSE s END), CASE WHEN len(parts) > 6 THEN ['**'] ELSE [] END) AS t0 FROM u
), seen AS (
  SELECT host, t0, count(*) AS n, count(ruled) AS l, count(*) FILTER (ruled = 'block') AS b FROM base GROUP BY ALL
)""" + "".join(
    f"""
, s{i} AS (SELECT *, t0[{i}] AS seg FROM {f"(SELECT *, t0[1:0] AS t FROM seen)" if i == 1 else f"l{i - 1}"})
, c{i} AS (SELECT host, t, seg, sum(n) AS n_seg FROM s{i} WHERE seg IS NOT NULL GROUP BY ALL)
, w{i} AS (SELECT host, t, seg, count(*) OVER (PARTITION BY host, t) > 16 AND n_seg < 0.02 * sum(n_seg) OVER (PARTITION BY host, t) AS wild FROM c{i})
, l{i} AS (SELECT s.host, s.t0, s.n, s.l, s.b, CASE WHEN s.seg IS NULL THEN s.t ELSE list_append(s.t, CASE WHEN w.wild THEN '*' ELSE s.seg END) END AS t
   FROM s{i} s LEFT JOIN w{i} w ON s.host = w.host AND s.t = w.t AND s.seg = w.seg)"""
    for i in range(1, 7)
) + """
, tree AS (SELECT host, t0, n, l, b, CASE WHEN len(t0) > 6 THEN list_append(t, '**') ELSE t END AS t FROM l6)
, br AS (SELECT host, t, sum(l) AS l, sum(b) AS b, greatest(len(t) - CASE WHEN coalesce(t[-1], '') LIKE '*%' THEN 2 ELSE 1 END, 0) AS lv FROM tree GROUP BY ALL)
, b2 AS (SELECT *, t[1:lv] AS above, t[lv + 2:] AS below FROM br)
, b3 AS (SELECT *, lag(b) OVER o AS pb, lag(l) OVER o AS pl FROM b2 WINDOW o AS (PARTITION BY host, above, below ORDER BY CASE WHEN l > 0 THEN b / l END NULLS FIRST, t))
, b4 AS (SELECT *, (b + pb + 1.0::DOUBLE) / (l + pl + 2.0::DOUBLE) AS mid, abs((b + 1.0::DOUBLE) / (l + 2.0::DOUBLE) - (pb + 1.0::DOUBLE) / (pl + 2.0::DOUBLE)) AS d FROM b3)
, b5 AS (SELECT *, CASE WHEN pl IS NULL THEN 0 ELSE CAST(d / sqrt(mid * (1 - mid) * (1 / (l + 2.0::DOUBLE) + 1 / (pl + 2.0::DOUBLE))) > 1.96 AS INT) END AS new FROM b4)
, b6 AS (SELECT *, sum(new) OVER (PARTITION BY host, above, below ORDER BY CASE WHEN l > 0 THEN b / l END NULLS FIRST, t) AS merged FROM b5)
, b7 AS (SELECT *, sum(l) OVER m AS ml, sum(b) OVER m AS mb, sum(l) OVER (PARTITION BY t) AS tl, sum(b) OVER (PARTITION BY t) AS tb,
   sum(l) OVER () AS al, sum(b) OVER () AS ab FROM b6 WINDOW m AS (PARTITION BY host, above, below, merged))
, v AS (SELECT host, t, CASE WHEN (mb + 4.0::DOUBLE * ((tb + 4.0::DOUBLE * (ab / greatest(al, 1))) / (tl + 4.0::DOUBLE))) / (ml + 4.0::DOUBLE) >= 0.5 THEN 'block' ELSE 'allow' END AS said FROM b7)
SELECT base.page_id, base.host, base.path, base.rule, coalesce(base.ruled, v.said) AS verdict, '/' || array_to_string(tree.t, '/') AS template
FROM base JOIN tree ON base.host = tree.host AND base.t0 = tree.t0 JOIN v ON tree.host = v.host AND tree.t = v.t
"""


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document, with coverage and span."""
    from .licenses import scan_licenses

    out = scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("matches").cast("long").alias("n_matches"), "matches")


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document."""
    from .lines import line_dedup

    docs = table(spark, sf_dir, "documents")
    out = line_dedup(docs.select("doc_id", "text").withColumn("n_lines", F.size(F.split("text", "\n")).cast("long")))
    return out.select(
        "doc_id", "n_lines", F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell weight, probability and draw of every document."""
    from .mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = mix(docs)
    return out.select(
        "doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
        F.round("_weight", 6).alias("weight"), F.round("_p", 6).alias("p"), F.col("_sampled").alias("sampled"),
    )


def _rake_sql() -> str:
    from .mixing import MARGINS, ROUNDS

    out, last = "", "c1"
    for r in range(ROUNDS):
        for m in MARGINS:
            name = f"k{r}{m[0]}"
            out += f", {name} AS MATERIALIZED (SELECT * REPLACE (mass * to_{m} / sum(mass) OVER (PARTITION BY {m}) AS mass) FROM {last})\n"
            last = name
    return out + f", fit AS (SELECT * FROM {last})\n"


MIX_SQL = """
docs AS (SELECT *, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM {source})
, lettered AS (SELECT *, array_to_string(list_transform(list_filter(words, lambda w: length(w) >= 8), lambda w: md5(w)[1]), '') AS letters FROM docs)
, named AS (SELECT * EXCLUDE (words, letters), coalesce(source, '') AS s_, coalesce(lang, '') AS l_, CAST(len(words) AS BIGINT) AS n_tokens,
  CASE WHEN letters = '' THEN 'none' ELSE list_sort([{{'n': length(letters) - length(replace(letters, x, '')), 'i': -CAST(('0x' || x) AS INT), 't': x}}
    FOR x IN ['0','1','2','3','4','5','6','7','8','9','a','b','c','d','e','f']], 'DESC')[1].t END AS topic FROM lettered)
, cells AS (SELECT s_ AS source, l_ AS lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM named GROUP BY ALL HAVING sum(n_tokens) > 0)
, c0 AS (SELECT *, tokens / sum(tokens) OVER () AS mass FROM cells)
, c1 AS MATERIALIZED (SELECT source, lang, topic, tokens, mass,
   sqrt(ms) / (SELECT sum(sqrt(x)) FROM (SELECT sum(mass) AS x FROM c0 GROUP BY source)) AS to_source,
   sqrt(ml) / (SELECT sum(sqrt(x)) FROM (SELECT sum(mass) AS x FROM c0 GROUP BY lang)) AS to_lang,
   sqrt(mt) / (SELECT sum(sqrt(x)) FROM (SELECT sum(mass) AS x FROM c0 GROUP BY topic)) AS to_topic
   FROM (SELECT *, sum(mass) OVER (PARTITION BY source) AS ms, sum(mass) OVER (PARTITION BY lang) AS ml, sum(mass) OVER (PARTITION BY topic) AS mt FROM c0))
{rake}
, weighed AS (SELECT *, mass / (tokens / sum(tokens) OVER ()) AS weight FROM fit)
, ordered AS (SELECT *, (0.5 * sum(tokens) OVER () - coalesce(sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(weight * tokens) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM weighed WINDOW o AS (ORDER BY weight DESC, source, lang, topic))
, scaled AS (SELECT *, least(1.0, weight * first_value(c) OVER (ORDER BY CASE WHEN c * weight <= 1 THEN 0 ELSE 1 END, weight DESC, c DESC)) AS p FROM ordered)
, drawn AS (SELECT n.*, coalesce(k.weight, 1.0) AS weight, coalesce(k.p, 1.0) AS p,
   CAST(('0x' || md5(concat_ws(':', CAST(n.doc_id AS VARCHAR), '17'))[1:8]) AS BIGINT) / 4294967296.0 < coalesce(k.p, 1.0) AS sampled
   FROM named n LEFT JOIN scaled k ON n.s_ = k.source AND n.l_ = k.lang AND n.topic = k.topic)
"""
ORACLES["op3_mixing"] = "WITH " + MIX_SQL.format(source="documents", rake=_rake_sql()) + (
    "SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(p, 6) AS p, sampled FROM drawn"
)


@query
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source of a language is from the others, and the terms that set it apart."""
    from .divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"), least_docs=10, top=10)


ORACLES["op11_divergence"] = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10
), groups AS (SELECT DISTINCT lang, source FROM d
), occ AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) GROUP BY ALL
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN occ o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
), gp AS (
  SELECT *, 1 + 1000000000 * (n + 2) // (sum(n) OVER w + 2 * count(*) OVER w) AS p FROM cells WINDOW w AS (PARTITION BY lang, source)
), lp AS (
  SELECT lang, term, 1 + 1000000000 * (n + 2) // (sum(n) OVER w + 2 * count(*) OVER w) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY ALL) WINDOW w AS (PARTITION BY lang)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(p.value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN pair p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
), terms AS (
  SELECT gp.lang, source, 'term' AS part, gp.term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM gp JOIN lp ON gp.lang = lp.lang AND gp.term = lp.term WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INT) AS rank FROM ranked WHERE part = 'pair' OR r <= 10
"""


@query
def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, a tenth of which the contract makes periodic."""
    from .runs import collapse_runs

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("words").cast("long")
    docs = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    a = F.when(n > 0, F.col("g") % n)
    docs = docs.select("*", n.alias("n"), a.alias("a")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int")), F.expr("cast((n - a) div p + 1 as int)"))), F.lit(1), F.expr("cast(n - a as int)"))
    periodic = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), tail), " ")
    out = collapse_runs(docs.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text")), least=6, power=4)
    # Exact: the first of the greatest quotients, compared crosswise; runs come by start and period.
    best = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda x, r: F.when(
        x.isNull() | (r["length"] * x["period"] > x["length"] * r["period"]), r).otherwise(x))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = out.select("doc_id", "runs", "collapsed", best.alias("best"), lines.alias("lines"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: the stated patterns' matches, and what the character models add."""
    from .secrets import KINDS, scan_secrets

    out = scan_secrets(table(spark, sf_dir, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["order"] < len(KINDS))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k, _, _ in KINDS]
    return out.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
