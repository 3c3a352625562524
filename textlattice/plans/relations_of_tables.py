"""Queries on transducers, alignment, measures and sources over data derived from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlattice.functions import text as X
from textlattice.operators import align as A
from textlattice.operators import cohorts as K
from textlattice.operators import evaluate as E
from textlattice.operators import lattice as L
from textlattice.operators import select as C
from textlattice.operators import transducer as D
from textlattice.plans.corpus import FOLD, KIND, LEX, PLACED, RX, WS, bench_lexicon, t
from textlattice.plans.derived import _apart, _apart_sql
from textlattice.plans.readings_of_tables import CONV, WORDS, draw, draw_sql, talks, words
from textlattice.plans.session import shared_folder
from textlattice.sources import arcs as binary
from textlattice.sources import conllu, files, tables
from textlattice.streaming import chunks

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# --- transducers: a trie of the benchmark's words, each of which says <n> at its end

TRIE = f"""{LEX}, px AS (SELECT DISTINCT surface[1:k] AS prefix FROM lex, range(0, 400) r(k) WHERE k <= length(surface)), st AS (SELECT prefix, row_number() OVER (ORDER BY prefix) - 1 AS state FROM px),
last AS (SELECT count(*) AS state FROM st), tr AS (SELECT p.state AS src, c.state AS dst, c.prefix[-1] AS isym, c.prefix[-1] AS osym FROM st c JOIN st p ON p.prefix = c.prefix[1:length(c.prefix) - 1] WHERE c.prefix <> ''
UNION ALL SELECT s.state, (SELECT state FROM last), '', '<n>' FROM lex JOIN st s ON surface = prefix)"""


def trie(spark, sf) -> tuple[DataFrame, DataFrame]:
    return D.compile_words(bench_lexicon(spark, sf).select(F.col("surface").alias("word"), F.lit("<n>").alias("tail")))


@query(f"WITH {TRIE} SELECT CAST(src AS INT) AS src, CAST(dst AS INT) AS dst, isym, osym FROM tr")
def compiled_arcs(spark, sf):
    """Arcs of the trie: states numbered over ranges of prefixes."""
    return trie(spark, sf)[0]


@query(f"WITH {TRIE}, g AS (SELECT src, count(*) AS n FROM tr GROUP BY src) SELECT CAST(src AS INT) AS src, CAST(coalesce(sum(n) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, n FROM g")
def csr_offsets(spark, sf):
    """Row offsets of the trie's arcs."""
    return D.csr(trie(spark, sf)[0])


@query(f"""WITH {TRIE}, s AS (SELECT DISTINCT isym AS x FROM tr UNION SELECT ''), i AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS id FROM s), o AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS id FROM (SELECT DISTINCT osym AS x FROM tr UNION SELECT ''))
SELECT row_number() OVER (ORDER BY src, i.id, o.id, dst) - 1 AS arc, CAST(src AS INT) AS src, CAST(dst AS INT) AS dst, CAST(i.id AS INT) AS in_id, CAST(o.id AS INT) AS out_id FROM tr JOIN i ON isym = i.x JOIN o ON osym = o.x""")
def coded_arcs(spark, sf):
    """The trie's arcs in order, their symbols by number."""
    return D.coded(trie(spark, sf)[0])[0].select("arc", "src", "dst", "in_id", "out_id")


@query(f"WITH {TRIE} SELECT CAST(src AS INT) AS src, CAST(dst AS INT) AS dst, isym, osym FROM tr")
def arc_round_trip(spark, sf):
    """The trie written as binary blocks, and what the data source reads of them."""
    arcs, finals = trie(spark, sf)
    path = f"{shared_folder(spark)}/arcs-{uuid.uuid4().hex}"
    binary.write(arcs, finals, path)
    return binary.read(spark, path)[0]


@query(f"""WITH {TRIE}, {WORDS}, ch AS (SELECT DISTINCT w, unnest(string_split(w, '')) AS c FROM words), odd AS (SELECT DISTINCT w FROM ch WHERE c NOT IN (SELECT isym FROM tr))
SELECT w AS word, CASE WHEN surface IS NOT NULL THEN CAST(0 AS INT) END AS cand_idx, surface || '<n>' AS output, CASE WHEN length(w) > 256 THEN 'input bound' WHEN odd.w IS NOT NULL THEN 'unknown symbol' ELSE 'ok' END AS status FROM words LEFT JOIN lex ON w = surface LEFT JOIN odd USING (w)""")
def fst_lookup(spark, sf):
    """All words of the documents through the trie."""
    arcs, finals = trie(spark, sf)
    return D.lookup(words(spark, sf).select(F.col("w").alias("word")), arcs, finals)


@query(f"""WITH RECURSIVE {TRIE}, {CONV}, ws AS (SELECT DISTINCT tok AS word FROM cv WHERE regexp_matches(tok, '\\p{{L}}')),
walk(word, state, pos, outp) AS (SELECT word, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '' FROM ws UNION ALL SELECT w.word, a.dst, w.pos + length(a.isym), w.outp || a.osym FROM walk w JOIN tr a ON a.src = w.state AND (a.isym = '' OR a.isym = w.word[w.pos + 1]))
SELECT DISTINCT word, outp AS output FROM walk JOIN last ON walk.state = last.state WHERE pos = length(word)""")
def fst_lookup_recursive(spark, sf):
    """Words of conversations through the trie by rounds of joins, as a recursive query does it."""
    arcs, finals = trie(spark, sf)
    w = talks(spark, sf).select(F.explode(X.tokens(F.col("text"))).alias("word")).filter(F.col("word").rlike(r"\p{L}"))
    return D.lookup_joined(w, arcs, finals).filter("output is not null").select("word", "output")


def _relation(df: DataFrame, tail: str) -> DataFrame:
    return df.select(F.col("w").alias("surface"), F.concat("w", F.when(draw(F.col("w"), 3) == 0, tail).otherwise("<n>")).alias("raw"))


@query(f"""WITH {WORDS}, {CONV}, c AS (SELECT DISTINCT tok AS w FROM cv WHERE regexp_matches(tok, '\\p{{L}}')), a AS (SELECT w AS surface, w || CASE {draw_sql('w', 3)} WHEN 0 THEN '<v>' ELSE '<n>' END AS raw FROM words),
b AS (SELECT w AS surface, w || CASE {draw_sql('w', 3)} WHEN 0 THEN '<x>' ELSE '<n>' END AS raw FROM c) SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def relation_diff(spark, sf):
    """Readings of the words of documents and of conversations: differences both ways."""
    c = talks(spark, sf).select(F.explode(X.tokens(F.col("text"))).alias("w")).filter(F.col("w").rlike(r"\p{L}")).distinct()
    return D.difference(_relation(words(spark, sf), "<v>"), _relation(c, "<x>"))


# --- alignment: the tokens of the benchmark, and what a tokenizer that shouts and splits makes of them

GOLD = f"""gt AS (SELECT item_id, regexp_extract_all(text, '{RX}') AS x FROM benchmark), gk AS (SELECT item_id, unnest(list_zip(list_filter(x, lambda y: NOT regexp_matches(y, '^[{WS}]+$')), range(len(list_filter(x, lambda y: NOT regexp_matches(y, '^[{WS}]+$')))))) AS q FROM gt),
gold AS (SELECT CAST(item_id AS VARCHAR) AS sent_id, CAST(q[2] AS INT) AS ordinal, q[1] AS form FROM gk),
pieces AS (SELECT *, {draw_sql('form', 7)} = 0 AND regexp_matches(form, '^\\p{{L}}{{4,}}$') AS cut, {draw_sql('form', 5)} = 0 AND upper(form) <> form AND lower(upper(form)) = lower(form) AS loud FROM gold),
parts AS (SELECT *, CASE WHEN cut THEN 2 ELSE 1 END AS n, CAST(sum(CASE WHEN cut THEN 2 ELSE 1 END) OVER (PARTITION BY sent_id ORDER BY ordinal) AS INT) AS upto FROM pieces)"""


def gold(spark, sf) -> DataFrame:
    """``(sent_id, ordinal, tok_id, form)``: tokens of the benchmark's items that are not space."""
    x = F.filter(X.tokens(F.col("text")), lambda y: ~y.rlike(f"^[{WS}]+$"))
    g = t(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("sent_id"), F.posexplode(x).alias("ordinal", "form"))
    return g.select("sent_id", "ordinal", (F.col("ordinal") + 1).alias("tok_id"), "form")


def predicted(spark, sf) -> DataFrame:
    """``(sent_id, tok_idx, text)``: a seventh of the longer words in two, a fifth of the others in capitals."""
    f = F.col("form")
    cut = (draw(f, 7) == 0) & f.rlike(r"^\p{L}{4,}$")
    loud = (draw(f, 5) == 0) & (F.upper(f) != f) & (F.lower(F.upper(f)) == F.lower(f))
    parts = F.when(cut, F.array(F.substring(f, 1, 2), F.substring(f, F.lit(3), F.length(f)))).when(loud, F.array(F.upper(f))).otherwise(F.array(f))
    g = gold(spark, sf).groupBy("sent_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", parts.alias("p")))), lambda x: x["p"])).alias("x"))
    return g.select("sent_id", F.posexplode("x").alias("tok_idx", "text"))


@query(f"WITH {GOLD} SELECT sent_id, ordinal, CAST(upto - 1 AS INT) AS tok_idx, CASE WHEN loud THEN 'normalized' ELSE 'exact' END AS match_kind FROM parts WHERE NOT cut")
def align_offsets(spark, sf):
    """One-to-one pairs by equal key offsets."""
    return A.by_offsets(gold(spark, sf), predicted(spark, sf))


OPS_SQL = "SELECT sent_id, ordinal AS op_idx, 'match' AS kind, ordinal AS gold_start, CAST(1 AS INT) AS gold_size, CAST(upto - n AS INT) AS pred_start, CAST(n AS INT) AS pred_size, CASE WHEN cut THEN 'group' WHEN loud THEN 'normalized' ELSE 'exact' END AS match_kind FROM parts"


@query(f"WITH {GOLD} {OPS_SQL}")
def align_dp(spark, sf):
    """The whole alignment of the benchmark with its groups."""
    return A.align(gold(spark, sf), predicted(spark, sf))


@query(f"""WITH {GOLD} SELECT count(DISTINCT sent_id) AS sentences, count(*) AS gold_tokens, CAST(sum(n) AS BIGINT) AS predicted_tokens, count(*) FILTER (NOT cut AND NOT loud) AS one_to_one_exact, count(*) FILTER (NOT cut AND loud) AS one_to_one_normalized, count(*) FILTER (cut) AS grouped_operations,
count(*) FILTER (cut) AS grouped_gold_tokens, CAST(2 * count(*) FILTER (cut) AS BIGINT) AS grouped_predicted_tokens, CAST(0 AS BIGINT) AS unaligned_gold_tokens, CAST(0 AS BIGINT) AS unaligned_predicted_tokens FROM parts""")
def align_counts(spark, sf):
    """Counters of the alignment."""
    return A.counts(A.align(gold(spark, sf), predicted(spark, sf)))


@query(f"WITH {GOLD} SELECT '1:2' AS shape, 'split' AS direction, 'other' AS evidence, count(*) AS count FROM parts WHERE cut HAVING count(*) > 0")
def group_evidence(spark, sf):
    """What explains the alignment's groups."""
    p = predicted(spark, sf)
    none = spark.createDataFrame([], "sent_id string, gold_start int, gold_end int")
    return E.group_evidence(A.align(gold(spark, sf), p), none, p.select("sent_id", "tok_idx", X.kind(F.col("text")).alias("kind")))


@query(f"""WITH {GOLD}, {LEX}, said AS (SELECT *, CASE WHEN loud THEN upper(form) ELSE form END AS tok FROM parts), k AS (SELECT said.*, {KIND} AS kind, surface IS NOT NULL AS known, tok IN ('\\', '^', '$', '/', '<', '>', '{{', '}}', '[', ']', '@', '#', '*', '+', '~', '|', '=', '&', '`') AS own FROM said LEFT JOIN lex ON tok = surface),
g AS (SELECT *, unnest(CASE WHEN cut THEN ['end_to_end'] WHEN known OR own OR kind = 'number' THEN ['end_to_end', 'aligned_only', 'selected_only'] ELSE ['end_to_end', 'aligned_only'] END) AS scope FROM k)
SELECT scope, count(*) FILTER (NOT cut AND (known OR own OR kind = 'number')) AS lemma_correct, count(*) AS lemma_total, count(*) FILTER (NOT cut AND known) AS upos_correct, count(*) AS upos_total, count(*) FILTER (NOT cut AND known) AS features_correct, count(*) FILTER (NOT cut AND known) AS full_correct,
count(*) FILTER (NOT cut AND (known OR own)) AS candidate_subset_correct FROM g GROUP BY scope""")
def evaluation_scopes(spark, sf):
    """The benchmark as gold against the readings of its shouted and split tokens: end to end, aligned, selected."""
    case = F.array(F.struct(F.lit("Case").alias("k"), F.lit("Nom").alias("v")))
    g, p = gold(spark, sf), predicted(spark, sf)
    said = L.read_tokens(p, bench_lexicon(spark, sf))
    s = E.scoped(g.select("sent_id", "ordinal", X.casefold(F.col("form")).alias("lemma"), F.lit("NOUN").alias("upos"), case.alias("features")), said, A.align(g, p))
    return E.metric_set(s, "scope").select("scope", "lemma_correct", "lemma_total", "upos_correct", "upos_total", "features_correct", "full_correct", "candidate_subset_correct")


# --- measures

CANDS = f"""g AS (SELECT w, {draw_sql('w', 6)} AS k FROM words WHERE {FOLD.format('upper(w)')} = {FOLD.format('w')})"""


@query(f"""WITH {WORDS}, {CANDS} SELECT count(*) FILTER (k IN (0, 1, 3)) AS lemma_correct, count(*) FILTER (k <> 5) AS lemma_total, count(*) FILTER (k IN (0, 1, 4)) AS upos_correct, count(*) AS upos_total, count(*) FILTER (k IN (0, 3)) AS features_correct, count(*) AS features_total,
count(*) FILTER (k = 0) AS full_correct, count(*) FILTER (k <> 5) AS full_total, count(*) FILTER (k IN (0, 1, 3)) AS gold_subset_correct, count(*) FILTER (k IN (0, 3, 4)) AS candidate_subset_correct FROM g""")
def metric_set(spark, sf):
    """Recall over candidate sets of all words: hits, richer ones, unknown ones, other classes and lemmas, gold without lemma."""
    k, w = draw(F.col("w"), 6), F.col("w")
    f = lambda *p: F.array(*(F.struct(F.lit(a).alias("k"), F.lit(b).alias("v")) for a, b in p)).cast("array<struct<k:string,v:string>>")
    case, more = f(("Case", "Nom")), f(("Case", "Nom"), ("Number", "Plur"))
    c = lambda lemma, upos, feats, source: F.array(F.struct(lemma.alias("lemma"), F.lit(upos).alias("upos"), feats.alias("features"), F.lit(source).alias("source")))
    cands = (
        F.when(k == 0, c(F.upper(w), "NOUN", case, "lexicon")).when(k == 1, c(w, "NOUN", more, "lexicon")).when(k == 2, c(w, "NOUN", case, "unknown")).when(k == 3, c(w, "VERB", case, "lexicon"))
        .when(k == 4, c(F.concat(w, F.lit("x")), "NOUN", f(), "lexicon")).otherwise(F.lit(None).cast("array<struct<lemma:string,upos:string,features:array<struct<k:string,v:string>>,source:string>>"))
    )
    some = words(spark, sf).filter(X.casefold(F.upper("w")) == X.casefold(F.col("w")))
    p = some.select(F.when(k == 5, "_").otherwise(w).alias("gold_lemma"), F.lit("NOUN").alias("gold_upos"), case.alias("gold_features"), cands.alias("candidates"))
    return E.metric_set(p).select("lemma_correct", "lemma_total", "upos_correct", "upos_total", "features_correct", "features_total", "full_correct", "full_total", "gold_subset_correct", "candidate_subset_correct")


@query(f"""WITH {PLACED}, w AS (SELECT {draw_sql('tok', 5)} AS k FROM placed WHERE regexp_matches(tok, '\\p{{L}}'))
SELECT count(*) AS gold_tokens, count(*) FILTER (k = 0) AS unaligned, count(*) FILTER (k = 1) AS no_candidate, count(*) FILTER (k = 2) AS single, count(*) FILTER (k = 3) AS ambiguous_selected, count(*) FILTER (k = 4) AS unresolved,
round(count(*) FILTER (k IN (2, 3)) / count(*) FILTER (k <> 0), 6) AS coverage_aligned, round(count(*) FILTER (k IN (2, 3)) / count(*), 6) AS coverage_end_to_end FROM w""")
def selection_stats(spark, sf):
    """Every word of the documents in one bucket of selection."""
    k = draw(F.col("text"), 5)
    w = X.explode_tokens(t(spark, sf, "documents")).filter(F.col("text").rlike(r"\p{L}"))
    return E.selection_stats(w.select((k != 0).alias("aligned"), F.when(k == 1, 0).when(k == 2, 1).otherwise(3).alias("n_candidates"), F.when(k == 3, 1).alias("selected")))


@query(f"""WITH {PLACED}, c AS (SELECT doc_id, CAST(e - length(tok) AS INT) AS s, CAST(e AS INT) AS e, tok, {draw_sql('tok', 40)} AS k FROM offs WHERE regexp_matches(tok, '\\p{{L}}')),
b AS (SELECT doc_id, s AS "start", CASE WHEN k = 1 THEN 'selected_raw_analysis_absent' ELSE 'no_identical_lattice_span' END AS reason, tok || '<n>' AS raw FROM c WHERE k IN (1, 2)) SELECT * FROM b ORDER BY doc_id, "start" LIMIT 20""")
def raw_containment(spark, sf):
    """The first chosen readings that a lattice without some of them lacks."""
    k = draw(F.col("text"), 40)
    w = X.explode_tokens(t(spark, sf, "documents")).filter(F.col("text").rlike(r"\p{L}"))
    lat = w.filter(k != 2).select("doc_id", "start", "end", "text", F.array(F.concat("text", F.when(k == 1, "<v>").otherwise("<n>"))).alias("raws"))
    return E.containment(w.select("doc_id", "start", "end", "text", F.concat("text", F.lit("<n>")).alias("raw")), lat).select("doc_id", "start", "raw", "reason")


@query(f"""WITH {PLACED}, {LEX}, f AS (SELECT DISTINCT {FOLD.format('surface')} AS key FROM lex WHERE {draw_sql('surface', 5)} = 0), w AS (SELECT *, {KIND} AS kind FROM placed), j AS (SELECT kind, surface, key FROM w LEFT JOIN lex ON tok = surface LEFT JOIN f ON key = {FOLD.format('tok')} WHERE kind IN ('word', 'number'))
SELECT count(*) AS lexical_tokens, count(*) FILTER (key IS NULL AND surface IS NOT NULL) AS dictionary, count(*) FILTER (key IS NOT NULL) AS fixlist, CAST(0 AS BIGINT) AS guesser, count(*) FILTER (key IS NULL AND surface IS NULL AND kind = 'number') AS rule, CAST(0 AS BIGINT) AS base_guess,
count(*) FILTER (key IS NULL AND surface IS NULL AND kind = 'word') AS "unknown", CAST(0 AS BIGINT) AS zero, count(*) AS candidates, 1.0::DOUBLE AS mean_candidates, CAST(1 AS INT) AS max_candidates FROM j""")
def coverage_origins(spark, sf):
    """Origin of the readings of every lexical token of the documents, a fixlist included."""
    lex = bench_lexicon(spark, sf)
    fix = lex.filter(draw(F.col("surface"), 5) == 0).select(X.casefold(F.col("surface")).alias("form_key")).distinct().select("form_key", F.lit(0).alias("ord"), F.concat("form_key", F.lit("<np>")).alias("raw"))
    return E.coverage(L.analyze(t(spark, sf, "documents"), lex, fix))


@query(f"""WITH {PLACED}, w AS (SELECT doc_id, idx, {draw_sql('tok', 4)} AS k FROM placed WHERE regexp_matches(tok, '\\p{{L}}')), l AS (SELECT *, lead(k) OVER (PARTITION BY doc_id ORDER BY idx) AS nxt FROM w)
SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN k = 0 AND (nxt IS NULL OR nxt <> 1) THEN 2 ELSE 1 END) AS BIGINT) AS n_left, count(*) FILTER (k = 0 AND nxt = 1) AS second_chosen FROM l GROUP BY doc_id""")
def rule_disambiguation(spark, sf):
    """A rule that selects verbs before adjectives, over words with two readings and with one."""
    tok = X.explode_tokens(t(spark, sf, "documents")).filter(F.col("text").rlike(r"\p{L}"))
    k = draw(F.col("text"), 4)
    tags = F.when(k == 0, F.array(F.array(F.lit("n")), F.array(F.lit("v")))).when(k == 1, F.array(F.array(F.lit("adj")))).otherwise(F.array(F.array(F.lit("n"))))
    r = tok.select("doc_id", "tok_idx", F.posexplode(tags).alias("cand_idx", "tags"))
    left = C.select_single(C.apply_rules(r, [("SELECT", "v", [(1, "adj")]), ("REMOVE", "adj", [])]))
    return left.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n").alias("n_left"), F.count(F.when(F.col("selected") == 1, 1)).alias("second_chosen"))


@query("""WITH b AS (SELECT event_type AS name, count(*) AS v FROM events WHERE event_id % 3 = 0 GROUP BY 1), a AS (SELECT event_type AS name, count(*) AS v FROM events WHERE event_id % 3 = 0 OR user_id % 2 = 0 GROUP BY 1)
SELECT name, coalesce(b.v, 0) AS initial, coalesce(a.v, 0) AS final, coalesce(a.v, 0) - coalesce(b.v, 0) AS during_run FROM b FULL JOIN a USING (name)""")
def counter_deltas(spark, sf):
    """Events by type before, after and during a run."""
    e = t(spark, sf, "events")
    n = lambda df: df.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("v"))
    return E.counter_delta(n(e.filter("event_id % 3 = 0")), n(e.filter("event_id % 3 = 0 or user_id % 2 = 0")))


@query("""WITH h AS (SELECT conv_id, count(DISTINCT role) AS r, count(DISTINCT length(text) % 2) AS l FROM conversations GROUP BY conv_id)
SELECT conv_id AS run_id, array_to_string(list_filter([CASE WHEN r > 1 THEN 'tokens' END, CASE WHEN l > 1 THEN 'provenance' END], lambda x: x IS NOT NULL), ',') AS differs FROM h WHERE r > 1 OR l > 1""")
def worker_consistency(spark, sf):
    """Conversations whose turns don't agree in role or parity of length."""
    d = t(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), F.when(F.col("role") == "user", 0).otherwise(F.ascii("role")).alias("tokens"), (F.length("text") % 2).cast("string").alias("provenance"))
    return E.consistency(d).select("run_id", F.array_join("differs", ",").alias("differs"))


@query("SELECT round(max(value), 6) AS max_mib, round(avg(value), 6) AS mean_mib FROM events")
def memory_summary(spark, sf):
    """Greatest and mean of event values, as of memory samples."""
    return E.memory(t(spark, sf, "events").select(F.col("value").alias("rss_mib"))).select(F.round("max_mib", 6).alias("max_mib"), F.round("mean_mib", 6).alias("mean_mib"))


@query(f"""WITH {WORDS} SELECT w AS surface FROM words WHERE {draw_sql('w', 10)} IN (1, 2)""")
def ledger_difference(spark, sf):
    """Words whose ordered candidates differ: turned round, or missing on one side."""
    k = draw(F.col("w"), 10)
    w = words(spark, sf)
    two = lambda a, b: F.array(F.concat("w", F.lit(a)), F.concat("w", F.lit(b)))
    made = lambda df, x: df.select(F.col("w").alias("surface"), F.posexplode(x).alias("cand_idx", "raw"))
    return E.ledger_difference(made(w.filter(k != 2), two("<n>", "<v>")), made(w, F.when(k == 1, two("<v>", "<n>")).otherwise(two("<n>", "<v>")))).select("surface")


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, CASE doc_id % 10 WHEN 1 THEN 'missing' WHEN 2 THEN 'unexpected' WHEN 3 THEN 'size' ELSE 'sha256' END AS problem FROM documents WHERE doc_id % 10 IN (1, 2, 3, 4)""")
def manifest_check(spark, sf):
    """Documents as files against a manifest with faults."""
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("k"), F.col("doc_id").cast("string").alias("path"), F.length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))
    k = F.col("k") % 10
    stated = d.filter(k != 2).select("path", F.when(k == 3, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(k == 4, F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"))
    return files.verify_manifest(d.filter(k != 1).select("path", "size", "sha256"), stated)


@query(f"""WITH {LEX}, p AS (SELECT surface, {draw_sql('surface', 4)} AS k FROM lex WHERE surface = {FOLD.format('surface')}) SELECT surface, k <> 0 AS has_readings, CASE k WHEN 0 THEN surface || '<n><nom>' WHEN 1 THEN surface || '<v>' ELSE '' END AS missing, CASE WHEN k IN (0, 3) THEN '' ELSE surface || '<n><nom>' END AS tracked_present FROM p""")
def probe_gate(spark, sf):
    """Probes made of the benchmark's words against a lexicon without some of them."""
    lex = bench_lexicon(spark, sf).filter(F.col("surface") == X.casefold(F.col("surface"))).withColumn("k", draw(F.col("surface"), 4)).withColumn("raw", F.concat("surface", F.lit("<n><nom>")))
    verb = F.concat("surface", F.lit("<v>"))
    p = lex.select("surface", F.when(F.col("k") == 1, F.array("raw", verb)).otherwise(F.array("raw")).alias("expected"), F.when(F.col("k") == 3, F.array(verb)).otherwise(F.array("raw")).alias("tracked"))
    g = tables.probe_gate(p, lex.filter("k <> 0").select("surface", "raw"))
    return g.select("surface", "has_readings", F.array_join("missing", "|").alias("missing"), F.array_join("tracked_present", "|").alias("tracked_present"))


# --- sources

@query(f"""WITH {GOLD}, k AS (SELECT * FROM gold WHERE NOT (CAST(sent_id AS BIGINT) % 7 = 0 AND ordinal = 0))
SELECT sent_id || '#0' AS sent_id, count(*) AS n_tokens, md5(string_agg(form || '/NOUN/' || CASE {draw_sql('form', 3)} WHEN 0 THEN '2' ELSE '0' END, ' ' ORDER BY ordinal)) AS tokens_md5, md5(string_agg(form, ' ' ORDER BY ordinal)) AS text_md5 FROM k GROUP BY 1""")
def conllu_parse(spark, sf):
    """Documents written as gold rows and read again: forms, classes, features and texts as digests."""
    g = gold_text(spark, sf)
    p = conllu.parse(g)
    s = p["sentences"].select("sent_id", "text")
    tok = p["tokens"].groupBy("sent_id").agg(
        F.count("*").alias("n_tokens"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "form", "upos", F.size("features").alias("f")))), lambda x: F.concat_ws("/", x["form"], x["upos"], x["f"].cast("string"))), " ").cast("binary")).alias("tokens_md5")
    )
    return tok.join(s, "sent_id").select("sent_id", "n_tokens", "tokens_md5", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def gold_text(spark, sf) -> DataFrame:
    """``(path, text)``: each benchmark item as a sentence of gold rows; of the items divisible by 7 the first row has a cell too few."""
    g = gold(spark, sf)
    feats = F.when(draw(F.col("form"), 3) == 0, "b=1|a=2").otherwise("_")
    cells = F.concat_ws("\t", F.col("tok_id").cast("string"), "form", F.lower("form"), F.lit("noun"), F.lit("_"), feats, F.lit("0"), F.lit("x"), F.lit("_"))
    short = (F.col("sent_id").cast("long") % 7 == 0) & (F.col("tok_id") == 1)
    row = F.when(short, cells).otherwise(F.concat(cells, F.lit("\t_")))
    rows = g.groupBy("sent_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", row.alias("row")))), lambda x: x["row"]), "\n").alias("body"))
    return rows.select(F.col("sent_id").alias("path"), F.concat(F.lit("# sent_id = s\n"), "body", F.lit("\n\n")).alias("text"))


@query(f"WITH {GOLD} SELECT sent_id AS path, CAST(2 AS INT) AS line_no, 'expected 10 columns' AS message FROM gold WHERE CAST(sent_id AS BIGINT) % 7 = 0 AND ordinal = 0")
def conllu_errors(spark, sf):
    """The gold rows that have a cell too few."""
    return conllu.parse(gold_text(spark, sf))["errors"].select("path", "line_no", "message")


@query("SELECT conv_id, turn, md5(replace(replace(text, chr(13), ' '), chr(9), ' ')) AS restored FROM conversations")
def conllu_spaces(spark, sf):
    """Texts with their white space escaped as in MISC, and decoded again."""
    x = F.replace(F.replace(F.col("text"), F.lit("\r"), F.lit(" ")), F.lit("\t"), F.lit(" "))
    for a, b in (("\\", "\\\\"), (" ", "\\s"), ("\n", "\\n"), ("|", "\\p")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return t(spark, sf, "conversations").select("conv_id", "turn", F.md5(conllu.spaces(x).cast("binary")).alias("restored"))


def _fix_lines(spark, sf) -> DataFrame:
    """``(line_no, line)``: a line for each word of the benchmark, in turn tab-separated, JSON, in angle brackets, and broken."""
    w = bench_lexicon(spark, sf).select("surface")
    k, s = draw(F.col("surface"), 5), F.col("surface")
    line = (
        F.when(k == 0, F.concat_ws("\t", s, F.lower(s), F.lit("n, nom"))).when(k == 1, F.to_json(F.struct(s.alias("form"), F.lower(s).alias("lemma"), F.array(F.lit("v")).alias("tags")))).when(k == 2, F.concat_ws("\t", s, s, F.lit("<np><nom>")))
        .when(k == 3, F.to_json(F.struct(s.alias("form"), s.alias("lemma")))).otherwise(F.concat(F.lit("broken "), s))
    )
    return w.select(F.conv(F.substring(F.md5(s.cast("binary")), 1, 7), 16, 10).cast("int").alias("line_no"), line.alias("line"))


FIXED = f"{LEX}, fx AS (SELECT surface, {draw_sql('surface', 5)} AS k, CAST('0x' || md5(surface)[1:7] AS INT) AS line_no FROM lex)"


@query(f"""WITH {FIXED}, r AS (SELECT {FOLD.format('surface')} AS form_key, line_no, CASE k WHEN 0 THEN lower(surface) || '<n><nom>' WHEN 1 THEN lower(surface) || '<v>' WHEN 2 THEN surface || '<np><nom>' ELSE surface || '<x>' END AS raw FROM fx WHERE k < 4)
SELECT form_key, CAST(row_number() OVER (PARTITION BY form_key ORDER BY line_no) - 1 AS INT) AS ord, raw FROM r""")
def fixlist_source(spark, sf):
    """A fixlist of the benchmark's words in all notations."""
    return tables.fixlist(_fix_lines(spark, sf))[0]


@query(f"WITH {FIXED} SELECT line_no, 'expected 3 columns' AS message FROM fx WHERE k = 4")
def fixlist_errors(spark, sf):
    """The fixlist's lines that are rejected."""
    return tables.fixlist(_fix_lines(spark, sf))[1]


def _att(spark, sf) -> DataFrame:
    """The trie as transducer text; arcs to states divisible by 50 have a weight, those by 77 a cell too few."""
    arcs, finals = trie(spark, sf)
    sym = lambda c: F.when(F.col(c) == "", "@0@").otherwise(F.col(c))
    k, dst, src = F.col("dst"), F.col("dst").cast("string"), F.col("src").cast("string")
    line = F.when(k % 50 == 0, F.concat_ws("\t", src, dst, sym("isym"), sym("osym"), F.lit("1.5"))).when(k % 77 == 0, F.concat_ws("\t", src, dst, sym("isym"))).otherwise(F.concat_ws("\t", src, dst, sym("isym"), sym("osym"), F.lit("0.0")))
    return arcs.select((F.col("src") * 100_000 + k).cast("long").alias("line_no"), line.alias("line")).unionByName(finals.select(F.lit(-1).cast("long").alias("line_no"), F.col("state").cast("string").alias("line")))


@query(f"WITH {TRIE} SELECT CAST(src AS INT) AS src, CAST(dst AS INT) AS dst, isym, osym FROM tr WHERE dst % 50 <> 0 AND dst % 77 <> 0")
def transducer_source(spark, sf):
    """Arcs of the trie written as transducer text."""
    return tables.transducer(_att(spark, sf))["arcs"]


@query(f"WITH {TRIE} SELECT src * 100000 + dst AS line_no, CASE WHEN dst % 50 = 0 THEN 'weight is not zero' ELSE 'expected 1, 2, 4 or 5 columns' END AS message FROM tr WHERE dst % 50 = 0 OR dst % 77 = 0")
def transducer_errors(spark, sf):
    """Its lines that are rejected."""
    return tables.transducer(_att(spark, sf))["errors"]


@query(f"""WITH {CONV}, u AS (SELECT doc_id, idx, tok, regexp_matches(tok, '\\p{{L}}') AS w FROM cv WHERE tok NOT IN ('^', '$', '/', '\\')) SELECT doc_id, count(*) FILTER (w) AS n_units, md5(string_agg(tok, '' ORDER BY idx)) AS restored, md5(coalesce(string_agg(tok || '<n>|' || tok || '<v>', '|' ORDER BY idx) FILTER (w), '')) AS readings FROM u GROUP BY doc_id""")
def stream_units(spark, sf):
    """Conversations as a backend stream, read again: units, text and readings."""
    tok = F.filter(X.tokens(F.col("text")), lambda x: ~x.isin("^", "$", "/", "\\"))
    unit = lambda x: F.when(x.rlike(r"\p{L}"), F.concat(F.lit("^"), x, F.lit("/"), x, F.lit("<n>/"), x, F.lit("<v>$"))).otherwise(x)
    d = talks(spark, sf).select("doc_id", tables.stream_units(F.array_join(F.transform(tok, unit), "")).alias("u"))
    n = F.size(F.filter("u", lambda x: F.size(x["readings"]) > 0)).cast("long")
    return d.select("doc_id", n.alias("n_units"), F.md5(F.array_join(F.transform("u", lambda x: x["text"]), "").cast("binary")).alias("restored"), F.md5(F.array_join(F.flatten(F.transform("u", lambda x: x["readings"])), "|").cast("binary")).alias("readings"))


@query(f"""WITH {WORDS}, n AS (SELECT DISTINCT nfc_normalize(w) AS w FROM words), c AS (SELECT w, unnest(list_zip(string_split(w, ''), range(length(w)))) AS q FROM n), d AS (SELECT w, q[2] AS i, length({_apart_sql('q[1]')}) AS l FROM c), s AS (SELECT w, i, sum(l) OVER (PARTITION BY w ORDER BY i) AS e FROM d)
SELECT {_apart_sql('w')} AS text, w AS nfc, '0,' || string_agg(CAST(e AS BIGINT), ',' ORDER BY i) AS boundaries FROM s GROUP BY w""")
def nfc_boundaries(spark, sf):
    """Words with letters and marks apart, composed, with the map of boundaries."""
    d = words(spark, sf).select(_apart(X.nfc(F.col("w"))).alias("text")).distinct().withColumn("n", X.nfc_with_boundaries(F.col("text")))
    return d.select("text", "n.nfc", F.concat_ws(",", F.col("n.boundaries").cast("array<string>")).alias("boundaries"))


@query("""SELECT page_id, CASE WHEN NOT contains(e, '"') THEN '"' || e || '"' WHEN NOT contains(e, '''') THEN '''' || e || '''' ELSE '"' || replace(e, '"', '&quot;') || '"' END AS quoted FROM
(SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '>', '&gt;'), '<', '&lt;'), chr(10), '&#10;'), chr(13), '&#13;'), chr(9), '&#9;') AS e FROM pages)""")
def xml_attributes(spark, sf):
    """Pages as attribute values."""
    return t(spark, sf, "pages").select("page_id", X.quote_attribute(F.col("html")).alias("quoted"))


@query(f"""WITH {PLACED}, b AS (SELECT DISTINCT tok FROM placed WHERE tok IN ('\\', '^', '$', '/', '<', '>', '{{', '}}', '[', ']', '@', '#', '*', '+', '~', '|', '=', '&', '`'))
SELECT tok AS surface, CASE WHEN regexp_matches(tok, '\\p{{P}}') THEN 'PUNCT' ELSE 'SYM' END AS upos, CASE WHEN tok IN ('=', '~', '|', '&', '`') THEN '' ELSE '\\' END || tok || CASE WHEN regexp_matches(tok, '\\p{{P}}') THEN '<punct>' ELSE '<sym>' END AS raw, CASE WHEN regexp_matches(tok, '\\p{{P}}') THEN 'punct' ELSE 'symbol' END AS kind FROM b""")
def protected_characters(spark, sf):
    """Reserved single characters of the documents read as themselves."""
    s = t(spark, sf, "documents").select(F.explode(X.tokens(F.col("text"))).alias("surface")).filter(F.col("surface").isin(*L.PROTECTED))
    r = L.surface_readings(s, spark.createDataFrame([], "surface string, cand_idx int, raw string"))
    return r.select("surface", F.col("readings")[0]["upos"].alias("upos"), F.col("readings")[0]["raw"].alias("raw"), "kind")


@query(f"""WITH {LEX}, {CONV}, w AS (SELECT tok, {draw_sql('tok', 4)} AS k, surface IS NOT NULL AS known FROM cv LEFT JOIN lex ON tok = surface WHERE regexp_matches(tok, '\\p{{L}}'))
SELECT count(*) AS gold_tokens, count(DISTINCT {FOLD.format('tok')}) AS gold_types, count(*) FILTER (known) AS compiled, CAST(0 AS BIGINT) AS fixlist, count(*) FILTER (known) AS effective, count(*) FILTER (NOT known) AS oov, count(DISTINCT CASE WHEN NOT known THEN {FOLD.format('tok')} END) AS oov_types,
count(*) FILTER (NOT known) AS oov_with_guess, count(*) FILTER (NOT known) AS unknown_placeholders, CAST(1 AS INT) AS max_candidates FROM w""")
def gold_coverage(spark, sf):
    """Coverage of the words of conversations by source of their readings."""
    a = L.analyze(talks(spark, sf), bench_lexicon(spark, sf)).filter(F.col("text").rlike(r"\p{L}"))
    d = a.select(X.casefold(F.col("text")).alias("key"), F.lit("NOUN").alias("gold_upos"), "readings")
    return E.gold_coverage(d).select("gold_tokens", "gold_types", "compiled", "fixlist", "effective", "oov", "oov_types", "oov_with_guess", "unknown_placeholders", "max_candidates")


@query(f"""WITH {PLACED}, w AS (SELECT {KIND} AS kind, {draw_sql('tok', 6)} AS k FROM placed)
SELECT count(*) FILTER (kind IN ('word', 'number')) AS lexical_tokens, count(*) FILTER (kind IN ('word', 'number') AND k < 4) AS predicted, count(*) FILTER (kind IN ('word', 'number') AND k IN (0, 1, 5)) AS ambiguous, count(*) FILTER (kind IN ('word', 'number') AND k = 0) AS resolved,
count(*) FILTER (kind IN ('word', 'number') AND k IN (1, 5)) AS abstained, round(count(*) FILTER (kind IN ('word', 'number') AND k = 0) / count(*) FILTER (kind IN ('word', 'number') AND k IN (0, 1, 5)), 6) AS resolution_rate FROM w""")
def neural_resolution(spark, sf):
    """What re-ranking resolved, over all tokens of the documents."""
    k = draw(F.col("text"), 6)
    tok = X.explode_tokens(t(spark, sf, "documents"))
    d = tok.select(X.kind(F.col("text")).alias("kind"), F.when(k.isin(0, 1, 5), 2).otherwise(1).alias("n_candidates"), (k < 4).alias("predicted"), F.when(k == 0, 1).alias("selected"))
    return E.neural_resolution(d)


@query("""WITH x AS (SELECT string_agg(text, chr(10) ORDER BY item_id) AS text FROM benchmark WHERE text <> '') SELECT CAST(unnest([1, 2, 3]) AS INT) AS run, md5(text) AS text_md5 FROM x""")
def workload_text(spark, sf):
    """The benchmark's items as one workload, three times."""
    return files.workload(t(spark, sf, "benchmark"), spark, repeat=3, order="item_id").select("run", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""SELECT CAST(user_id AS VARCHAR) AS run_id, CASE WHEN NOT bool_or(event_type <> 'view') THEN 'not_applicable' WHEN count(*) FILTER (value > 90) = 0 THEN 'complete' ELSE 'incomplete' END AS status FROM events GROUP BY user_id""")
def run_completeness(spark, sf):
    """Whether a user's events hit a bound."""
    hit = (F.col("value") > 90).cast("int")
    z = F.lit(0)
    return E.completeness(t(spark, sf, "events").select(F.col("user_id").cast("string").alias("run_id"), hit.alias("caps"), z.alias("timeouts"), z.alias("failures"), z.alias("cycles"), z.alias("unsafe"), (F.col("event_type") != "view").alias("applicable")))


@query(f"""WITH {WORDS}, h AS (SELECT w, {draw_sql('w', 5)} AS k FROM words) SELECT w, CASE k WHEN 0 THEN CAST(0 AS INT) WHEN 1 THEN CAST(1 AS INT) END AS selected FROM h""")
def span_selection(spark, sf):
    """Choices of readings by the one genuine contextual one, over all words."""
    k, w = draw(F.col("w"), 5), F.col("w")
    n, v = F.concat(w, F.lit("<n>")), F.concat(w, F.lit("<v>"))
    raws = F.when(k == 0, F.array(n)).when(k == 3, F.array(n, n)).otherwise(F.array(n, v))
    said = F.when(k == 1, F.array(v, F.concat(F.lit("*"), w))).when(k == 2, F.array(n, v)).when(k == 3, F.array(n)).otherwise(F.lit(None).cast("array<string>"))
    return words(spark, sf).select("w", K.select_span(raws, said).alias("selected"))


@query(f"""WITH c AS (SELECT page_id, unnest(list_zip(string_split(url, ''), range(length(url)))) AS q FROM pages), n AS (SELECT page_id, q[1] AS c, q[2] AS i, lag(q[1]) OVER o AS p, lead(q[1]) OVER o AS x FROM c WINDOW o AS (PARTITION BY page_id ORDER BY q[2]))
SELECT page_id, coalesce(string_agg(i, ',' ORDER BY i) FILTER (c IN ('-', '‐', '‑') AND regexp_matches(p, '[\\p{{L}}\\p{{M}}\\p{{N}}]') AND regexp_matches(x, '[\\p{{L}}\\p{{M}}\\p{{N}}]')), '') AS inner_hyphens FROM n GROUP BY page_id""")
def hyphen_fences(spark, sf):
    """Places of hyphens inside chains of URLs."""
    d = t(spark, sf, "pages").filter(F.length("url") > 0).withColumn("c", K.characters(F.col("url")))
    return d.select("page_id", F.concat_ws(",", K.hyphen_indexes(F.col("c")).cast("array<string>")).alias("inner_hyphens"))



@query(f"WITH {TRIE}, l AS (SELECT DISTINCT p.state AS a, s.state AS b FROM lex JOIN st s ON surface = s.prefix JOIN st p ON p.prefix = surface[1:length(surface) - 1] WHERE {draw_sql('surface', 6)} = 0) SELECT CAST(a AS INT) AS state FROM l UNION SELECT CAST(b AS INT) FROM l")
def fst_epsilon_cycle(spark, sf):
    """States on cycles of input epsilons, after words of the trie got such arcs to their last letter and back."""
    arcs, _ = trie(spark, sf)
    ends = arcs.filter("osym = '<n>'").select(F.col("src").alias("end"))
    said = bench_lexicon(spark, sf).filter(draw(F.col("surface"), 6) == 0).select(F.col("surface").alias("word"))
    # A word's state is where its path leads: its letters are looked up in the order of prefixes.
    states = D.numbered(bench_lexicon(spark, sf).select(F.explode(F.transform(F.sequence(F.lit(0), F.length("surface")), lambda k: F.substring("surface", F.lit(1), k))).alias("prefix")).distinct(), ["prefix"], "state")
    mine = said.join(states, F.col("word") == F.col("prefix")).select(F.col("state").cast("int").alias("dst"))
    last = arcs.filter("isym <> ''").join(mine, "dst").join(ends, F.col("dst") == F.col("end"), "left_semi").select("src", "dst")
    more = last.unionByName(last.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select("src", "dst", F.lit("").alias("isym"), F.lit("x").alias("osym"))
    return D.epsilon_cycles(arcs.unionByName(more))


@query("""WITH RECURSIVE li AS (SELECT doc_id, unnest(list_zip(x, range(len(x)))) AS z FROM (SELECT doc_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS x FROM documents)), l AS (SELECT doc_id, z[2] AS k, length(z[1]) AS n FROM li),
r AS (SELECT doc_id, k, n AS size, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS chunk FROM l WHERE k = 0 UNION ALL SELECT l.doc_id, l.k, CASE WHEN r.size + l.n > 400 THEN l.n ELSE r.size + l.n END, CASE WHEN r.size + l.n > 400 THEN r.place + r.size ELSE r.place END, CASE WHEN r.size + l.n > 400 THEN r.chunk + 1 ELSE r.chunk END FROM r JOIN l ON l.doc_id = r.doc_id AND l.k = r.k + 1)
SELECT doc_id, max(chunk) + 1 AS n_chunks, CAST(sum(place * (chunk + 1)) AS BIGINT) AS starts FROM (SELECT DISTINCT doc_id, chunk, place FROM r) GROUP BY doc_id""")
def line_chunks(spark, sf):
    """Lines of the documents packed to 400 characters."""
    c = t(spark, sf, "documents").select("doc_id", F.posexplode(X.line_chunks(F.col("text"), 400)).alias("chunk", "c"))
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.col("c.start") * (F.col("chunk") + 1)).cast("long").alias("starts"))


WHOLE = f"""br AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^{WS}]+')) AS run FROM benchmark), dr AS (SELECT doc_id, unnest(list_zip(x, range(len(x)))) AS z FROM (SELECT doc_id, regexp_extract_all(text, '[{WS}]+|[^{WS}]+') AS x FROM documents)),
rn AS (SELECT DISTINCT z[1] AS run FROM dr), rt AS (SELECT run, regexp_extract_all(run, '{RX}') AS x FROM rn), tl AS (SELECT run, x, unnest(range(len(x) - 1)) AS k FROM rt WHERE len(x) > 1), hit AS (SELECT run, min(k) AS k FROM tl WHERE array_to_string(x[k + 1:], '') IN (SELECT run FROM br) GROUP BY run)"""


@query(f"""WITH {WHOLE} SELECT doc_id, CAST(sum(CASE WHEN hit.k IS NULL THEN len(x) ELSE hit.k + 1 END) AS BIGINT) AS n_tokens, count(hit.k) AS n_whole, md5(string_agg(CASE WHEN hit.k IS NULL THEN array_to_string(x, '|') ELSE array_to_string(list_append(x[1:hit.k], array_to_string(x[hit.k + 1:], '')), '|') END, '|' ORDER BY z[2])) AS tokens_md5
FROM dr JOIN rt ON rt.run = z[1] LEFT JOIN hit ON hit.run = z[1] GROUP BY doc_id""")
def whole_run_tokens(spark, sf):
    """Documents in which what the benchmark has of a run of several tokens stays whole."""
    lex = t(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(f"[^{WS}]+"), F.lit(0))).alias("surface")).distinct()
    w = K.whole_runs(t(spark, sf, "documents"), lex)
    many = (F.size(X.tokens(F.col("text"))) > 1) & ~F.col("text").rlike(f"^[{WS}]+$")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("tok_idx", "text"))), lambda x: x["text"])
    return w.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count(F.when(many, 1)).alias("n_whole"), F.md5(F.array_join(ordered, "|").cast("binary")).alias("tokens_md5"))


@query(f"""WITH {CONV}, s AS (SELECT doc_id, {draw_sql('doc_id', 3)} AS k, list(tok ORDER BY idx) AS x FROM cv GROUP BY ALL) SELECT doc_id, CAST(CASE k WHEN 0 THEN len(x) WHEN 1 THEN len(x) - 1 ELSE 0 END AS INT) AS n_segments, CASE k WHEN 1 THEN 'input is not covered' WHEN 2 THEN 'not aligned at 0' END AS error FROM s""")
def segment_alignment(spark, sf):
    """Tokens of conversations as cohorts against their text: whole, without the last, with a wrong first."""
    k, x = draw(F.col("doc_id"), 3), F.col("x")
    d = talks(spark, sf).select("doc_id", "text", X.tokens(F.col("text")).alias("x")).filter(F.size("x") > 0)
    some = F.when(k == 0, x).when(k == 1, F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(F.concat(F.array(F.concat(F.lit("#"), F.get(x, F.lit(0)))), F.slice(x, F.lit(2), F.size(x))))
    seg = F.transform(some, lambda s: F.struct(s.alias("text"), F.array().cast("array<string>").alias("readings")))
    a = d.select("doc_id", K.align_segments(F.col("text"), seg).alias("a"))
    return a.select("doc_id", F.size("a.segments").alias("n_segments"), "a.error")


@query(f"""WITH {CONV}, s AS (SELECT *, sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY idx) - length(tok) AS s FROM cv) SELECT doc_id, CAST(count(*) AS INT) AS n_atoms, CAST(sum(s * (idx % 89)) AS BIGINT) AS starts FROM s GROUP BY doc_id""")
def atomic_intervals(spark, sf):
    """Atoms of conversations when each single letter is a cohort of its own run: those of the tokens."""
    d = talks(spark, sf).select("doc_id", K.characters(F.col("text")).alias("c"), X.token_ends(X.tokens(F.col("text"))).alias("ends"))
    # Generated, so that no place of a text makes its characters anew.
    d = d.select("doc_id", F.inline(F.array(F.struct("c", "ends")))).filter(F.size("c") > 0)
    a = d.select("doc_id", K.atomic_intervals(F.col("c"), F.col("ends")).alias("a"))
    return a.select("doc_id", F.size("a").alias("n_atoms"), F.aggregate(F.transform("a", lambda p, i: p["start"].cast("long") * (i % 89)), F.lit(0).cast("long"), lambda x, y: x + y).alias("starts"))


@query(f"""WITH {CONV}, w AS (SELECT {draw_sql('tok', 3)} AS k FROM cv WHERE regexp_matches(tok, '\\p{{L}}')), c AS (SELECT k, unnest([0, 1]) AS cand FROM w)
SELECT k, CAST(cand AS INT) AS cand_idx, n, CASE k WHEN 0 THEN round(CASE cand WHEN 1 THEN 1 ELSE exp(-3.55::DOUBLE) END / (1 + exp(-3.55::DOUBLE)), 6) WHEN 1 THEN 0.5 END AS score, CASE WHEN k = 0 AND cand = 1 OR k = 1 AND cand = 0 THEN n ELSE 0 END AS n_selected FROM (SELECT k, cand, count(*) AS n FROM c GROUP BY k, cand)""")
def neural_rerank(spark, sf):
    """Words of conversations with two readings, re-ranked by predictions of the second, of neither, and of other spans."""
    f = lambda k, v: F.array(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")))
    tok = X.explode_tokens(talks(spark, sf)).filter(F.col("text").rlike(r"\p{L}")).withColumn("k", draw(F.col("text"), 3))
    two = F.inline(F.array(F.struct(F.lit(0).alias("cand_idx"), F.lit("NOUN").alias("upos"), f("Case", "Nom").alias("features")), F.struct(F.lit(1).alias("cand_idx"), F.lit("VERB").alias("upos"), f("Mood", "Imp").alias("features"))))
    r = tok.select("doc_id", "tok_idx", "start", "end", F.lit("word").alias("kind"), F.col("text").alias("lemma"), "k", F.lit(None).cast("double").alias("score"), two)
    p = tok.select("doc_id", "start", F.when(F.col("k") == 2, F.col("end") + 1000).otherwise(F.col("end")).alias("end"), F.lit(0).alias("ord"), "text", F.col("text").alias("lemma"), F.when(F.col("k") == 0, "VERB").otherwise("ADJ").alias("upos"), F.when(F.col("k") == 0, f("Mood", "Imp")).otherwise(f("Degree", "Cmp")).alias("features"))
    best = C.rerank(r.drop("k"), p).join(tok.select("doc_id", "tok_idx", "k"), ["doc_id", "tok_idx"])
    return best.groupBy("k", "cand_idx").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"), F.count(F.when(F.col("is_selected"), 1)).alias("n_selected"))


HIDDEN = "".join(c for c in X.PROTECTED if c not in "\0\r")


@query(f"""WITH p AS (SELECT page_id, CASE {draw_sql('CAST(page_id AS VARCHAR)', 3)} WHEN 0 THEN chr(57344) || html || chr(57347) ELSE html END AS h, {draw_sql('CAST(page_id AS VARCHAR)', 3)} = 0 AS odd FROM pages),
c AS (SELECT *, CASE WHEN odd THEN list_aggregate(list_transform(list_filter(range(57344, 57400), lambda i: i <> 57344 AND i <> 57347), lambda i: chr(CAST(i AS INT)))[1:{len(X.PROTECTED)}], 'string_agg', '') ELSE list_aggregate(list_transform(range(57344, {57344 + len(X.PROTECTED)}), lambda i: chr(CAST(i AS INT))), 'string_agg', '') END AS code FROM p)
SELECT page_id, md5(code) AS code_md5, md5(translate(translate(h, '{HIDDEN}', code), chr(13), code[{len(X.PROTECTED)}])) AS hidden_md5, true AS whole FROM c""")
def hidden_pages(spark, sf):
    """Markup of pages behind sentinels, some of which stand in the pages themselves, and back."""
    odd = draw(F.col("page_id").cast("string"), 3) == 0
    p = t(spark, sf, "pages").select("page_id", F.when(odd, F.concat(F.lit("\ue000"), "html", F.lit("\ue003"))).otherwise(F.col("html")).alias("h"))
    p = p.withColumn("x", X.hide(F.col("h")))
    return p.select("page_id", F.md5(F.col("x.code").cast("binary")).alias("code_md5"), F.md5(F.col("x.text").cast("binary")).alias("hidden_md5"), (X.reveal(F.col("x")) == F.col("h")).alias("whole"))


@query(f"""WITH p AS (SELECT page_id, html, {draw_sql('CAST(page_id AS VARCHAR)', 4)} AS k, length(html) // 2 AS mid FROM pages)
SELECT page_id, CASE WHEN k < 3 THEN 'html: U+' || CASE k WHEN 0 THEN '0001' WHEN 1 THEN '001F' ELSE 'FFFE' END || ' at ' || mid || ' cannot be in XML 1.0' END AS message FROM p""")
def xml_errors(spark, sf):
    """Pages with a character in their middle that XML 1.0 forbids, or none."""
    k, at = draw(F.col("page_id").cast("string"), 4), (F.length("html") / 2).cast("int")
    odd = F.when(k == 0, "\x01").when(k == 1, "\x1f").when(k == 2, "\ufffe").otherwise("")
    made = F.concat(F.substring("html", F.lit(1), at), odd, F.substring("html", at + 1, F.length("html")))
    return t(spark, sf, "pages").select("page_id", X.xml_error(made, "html").alias("message"))


@query(f"""WITH c AS (SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS id, text, {draw_sql("conv_id || '-' || turn", 5)} AS k, greatest((strlen(text) + 39) // 40, 1) AS n FROM conversations WHERE text IS NOT NULL)
SELECT id, CASE k WHEN 1 THEN n - 1 WHEN 2 THEN 0 WHEN 3 THEN n ELSE n END AS n_acknowledged, CASE k WHEN 1 THEN 'error' WHEN 2 THEN 'cancelled' ELSE 'text' END AS outcome, CASE WHEN k NOT IN (1, 2) THEN md5(text) END AS text_md5, CASE k WHEN 3 THEN 1 ELSE 0 END AS n_repeated FROM c""")
def chunk_stream(spark, sf):
    """Conversations as a stream of chunks of 40 bytes: of each five one ends in a wrong byte, one is cancelled, one says its first chunk again in a later batch."""
    raw = F.encode("text", "UTF-8")
    d = talks(spark, sf).filter("text is not null").select(F.col("doc_id").alias("id"), raw.alias("raw"), draw(F.col("doc_id"), 5).alias("k"))
    d = d.withColumn("n", F.greatest(F.ceil(F.octet_length("raw") / 40).cast("int"), F.lit(1)))
    d = d.select("id", "k", "n", "raw", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk_no"))
    content = F.substring("raw", F.col("chunk_no") * 40 + 1, F.lit(40))
    last = F.col("chunk_no") == F.col("n") - 1
    d = d.select("id", "k", "chunk_no", F.when((F.col("k") == 1) & last, F.concat(content, F.lit(b"\xff"))).otherwise(content).alias("content"), last.alias("last"), ((F.col("k") == 2) & (F.col("chunk_no") == 0)).alias("cancel"))
    path = f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    # Chunks of one text go to several files, and so to several batches; what is said again comes last.
    d.drop("k").repartition(8, F.rand(1)).write.parquet(f"{path}/in")
    d.filter("k = 3 and chunk_no = 0").drop("k").coalesce(1).write.mode("append").parquet(f"{path}/in")
    with chunks.with_states(spark):
        stream = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).option("maxFilesPerTrigger", 3).parquet(f"{path}/in")
        run = chunks.join_chunks(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    e = spark.read.schema(chunks.EVENT).parquet(f"{path}/out")
    ended = F.when(F.col("event").isin("text", "error", "cancelled"), F.col("event"))
    n = lambda event: F.count(F.when(F.col("event") == event, 1))
    gone = n("cancelled") > 0
    return e.groupBy("id").agg(F.when(gone, 0).otherwise(n("acknowledged")).cast("long").alias("n_acknowledged"), F.max(ended).alias("outcome"), F.md5(F.max("text").cast("binary")).alias("text_md5"),
                               F.when(gone, 0).otherwise(n("repeated") + n("late")).cast("int").alias("n_repeated"))
