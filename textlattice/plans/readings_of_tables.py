"""Queries on readings, formats and hypotheses over the words and texts of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlattice.engine import Engine
from textlattice.functions import readings as R
from textlattice.functions import tags as T
from textlattice.functions import text as X
from textlattice.operators import guess as G
from textlattice.operators import lattice as L
from textlattice.operators import serialize as S
from textlattice.plans.corpus import FOLD, KIND, LEX, PLACED, RX, TOKS, bench_lexicon, t
from textlattice.plans.derived import PHRASES, _windows, bench_phrases
from textlattice.plans.fixtures import PROJECTED, values

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def draw(x: Column, k: int) -> Column:
    """A number below ``k`` from a string's MD5."""
    return (F.conv(F.substring(F.md5(x.cast("binary")), 1, 4), 16, 10).cast("int") % k).cast("int")


def draw_sql(x: str, k: int) -> str:
    return f"CAST(CAST('0x' || md5({x})[1:4] AS INT) % {k} AS INT)"


WORDS = f"words AS (SELECT DISTINCT tok AS w FROM ({TOKS}) WHERE regexp_matches(tok, '\\p{{L}}'))"


def words(spark, sf) -> DataFrame:
    """The distinct words of the documents, as ``w``."""
    return t(spark, sf, "documents").select(F.explode(X.tokens(F.col("text"))).alias("w")).filter(F.col("w").rlike(r"\p{L}")).distinct()


def shown(c: Column) -> Column:
    return T.feature_text(c, "|")


#: Raw readings that words get in turn: (what follows the word, class, tags, features of the first and last morpheme, morphemes, guessed).
RAWS = [
    ("<n><nom>", "NOUN", "n,nom", "Case=Nom", "Case=Nom", 1, False), ("<v><tv><past><p3><sg>", "VERB", "v,tv,past,p3,sg", "Mood=Ind|Number=Sing|Person=3|Tense=Past|VerbForm=Fin", "Mood=Ind|Number=Sing|Person=3|Tense=Past|VerbForm=Fin", 1, False),
    ("<adj>+е<cop><aor><p3><sg>", "ADJ", "adj,cop,aor,p3,sg", "", "Aspect=Hab|Mood=Ind|Number=Sing|Person=3|Tense=Pres|VerbForm=Fin", 2, False), ("<np><unk>", "PROPN", "np,unk", "Foreign=Yes", "Foreign=Yes", 1, True),
    ("", "X", "", "", "", 1, False), ("+?", None, None, None, None, None, None), ("\\+x<abbr>", "NOUN", "abbr", "Abbr=Yes", "Abbr=Yes", 1, False),
]


@query(f"""WITH {WORDS}, k(k, tail, upos, tags, features, last_features, n_morphemes, guessed) AS ({values('k INT, tail VARCHAR, upos VARCHAR, tags VARCHAR, features VARCHAR, last_features VARCHAR, n_morphemes INT, guessed BOOLEAN', [(i, *r) for i, r in enumerate(RAWS)])})
SELECT w || tail AS raw, CASE WHEN upos IS NOT NULL THEN w || CASE WHEN tags = 'abbr' THEN '+x' ELSE '' END END AS lemma, upos, tags, features, n_morphemes, last_features, guessed FROM words JOIN k ON k = {draw_sql('w', len(RAWS))}""")
def parse_readings(spark, sf):
    """Raw readings of all words to lemma, class, tags and features."""
    tails = F.array(*(F.lit(r[0]) for r in RAWS))
    d = words(spark, sf).select(F.concat("w", F.get(tails, draw(F.col("w"), len(RAWS)))).alias("raw")).withColumn("r", R.parse(F.col("raw")))
    return d.select("raw", "r.lemma", "r.upos", F.array_join("r.tags", ",").alias("tags"), shown(F.col("r.features")).alias("features"), F.when(F.col("r").isNotNull(), F.size("r.morphemes")).alias("n_morphemes"),
                    shown(F.element_at("r.morphemes", -1)["features"]).alias("last_features"), "r.guessed")


def _projected(spark, sf, profile: str) -> DataFrame:
    said = F.array(*(F.lit(p[0]) for p in PROJECTED))
    d = words(spark, sf).select(F.substring("w", 1, 1).alias("letter"), F.get(said, draw(F.col("w"), len(PROJECTED))).alias("said")).withColumn("tags", F.split("said", " "))
    return T.project(d, "tags", profile).groupBy("letter", "said", "upos", shown(F.col("features")).alias("features")).agg(F.count("*").alias("n"))


def _projected_sql(place: int) -> str:
    rows = [(i, p[0], p[1], p[place]) for i, p in enumerate(PROJECTED)]
    return f"WITH {WORDS}, k AS ({values('k INT, said VARCHAR, upos VARCHAR, features VARCHAR', rows)}) SELECT w[1] AS letter, said, upos, features, count(*) AS n FROM words JOIN k ON k = {draw_sql('w', len(rows))} GROUP BY ALL"


@query(_projected_sql(2))
def ud_projection_universal(spark, sf):
    """Tag tuples dealt to all words, to class and features; evaluated once a tuple."""
    return _projected(spark, sf, "universal")


@query(_projected_sql(3))
def ud_projection_ktb(spark, sf):
    """The same under the treebank's profile."""
    return _projected(spark, sf, "ktb")


CONV = f"""ct AS (SELECT conv_id || '-' || turn AS doc_id, regexp_extract_all(text, '{RX}') AS x FROM conversations), ck AS (SELECT doc_id, unnest(list_zip(x, range(len(x)))) AS q FROM ct),
cv AS (SELECT doc_id, q[1] AS tok, CAST(q[2] AS INT) AS idx FROM ck)"""


def talks(spark, sf) -> DataFrame:
    return t(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text")


@query(f"""WITH {LEX}, {CONV}, fix AS (SELECT DISTINCT {FOLD.format('surface')} AS key FROM lex WHERE {draw_sql('surface', 5)} = 0),
j AS (SELECT cv.*, {KIND} AS kind, surface, key FROM cv LEFT JOIN lex ON tok = surface LEFT JOIN fix ON key = {FOLD.format('tok')}),
own AS (SELECT *, tok IN ('\\', '^', '$', '/', '<', '>', '{{', '}}', '[', ']', '@', '#', '*', '+', '~', '|', '=', '&', '`') AS o FROM j)
SELECT kind, CASE WHEN kind = 'space' THEN '' WHEN key IS NOT NULL THEN 'PROPN/fixlist;X/fixlist' WHEN surface IS NOT NULL THEN 'NOUN/lexicon' WHEN o THEN CASE WHEN kind = 'punct' THEN 'PUNCT/rule' ELSE 'SYM/rule' END
WHEN kind = 'number' THEN 'NUM/rule' WHEN kind = 'word' THEN 'X/unknown' ELSE '' END AS readings, CASE WHEN kind = 'space' OR key IS NOT NULL OR (surface IS NULL AND NOT o AND kind IN ('punct', 'symbol')) THEN NULL ELSE CAST(0 AS INT) END AS selected, count(*) AS n FROM own GROUP BY ALL""")
def fixlist_override(spark, sf):
    """Conversations under a lexicon and a fixlist, of which an entry replaces all other readings."""
    lex = bench_lexicon(spark, sf)
    keys = lex.filter(draw(F.col("surface"), 5) == 0).select(X.casefold(F.col("surface")).alias("form_key")).distinct()
    fix = keys.select("form_key", F.inline(F.array(F.struct(F.lit(0).alias("ord"), F.concat("form_key", F.lit("<np>")).alias("raw")), F.struct(F.lit(1).alias("ord"), F.concat("form_key", F.lit("<x>")).alias("raw")))))
    d = L.analyze(talks(spark, sf), lex, fix)
    said = F.array_join(F.transform("readings", lambda r: F.concat(r["upos"], F.lit("/"), r["source"])), ";")
    return d.groupBy("kind", said.alias("readings"), "selected").agg(F.count("*").alias("n"))


@query(f"""WITH {PHRASES}, {CONV}, w AS ({_windows('cv', 'doc_id')}) SELECT phrase AS text, count(*) AS n, CAST(sum(idx) AS BIGINT) AS places FROM w SEMI JOIN phrases USING (phrase) GROUP BY phrase""")
def lexicon_phrases(spark, sf):
    """Phrases of the benchmark in conversations."""
    s = L.phrase_spans(talks(spark, sf), bench_phrases(spark, sf))
    return s.groupBy("text").agg(F.count("*").alias("n"), F.sum("token_start").alias("places"))


def analyzed(spark, sf) -> DataFrame:
    """``(doc_id, tokens, spans)`` of the documents under the benchmark's vocabulary."""
    return Engine(spark, bench_lexicon(spark, sf)).documents(t(spark, sf, "documents"))


READ = f"""{PLACED}, {LEX}, rd0 AS (SELECT *, {KIND} AS kind, e - length(tok) AS s FROM offs LEFT JOIN lex ON tok = surface),
rd AS (SELECT *, kind IN ('word', 'number') AS lx, CASE WHEN kind = 'number' THEN tok ELSE {FOLD.format('tok')} END AS lemma, CASE WHEN surface IS NOT NULL THEN 'NOUN,Case=Nom' WHEN kind = 'number' THEN 'NUM,NumType=Card' ELSE 'X' END AS gr, surface IS NULL AS gs FROM rd0)"""


@query(f"""WITH {READ} SELECT doc_id, md5(string_agg(CASE WHEN lx THEN tok || '{{' || lemma || CASE WHEN gs THEN '?' ELSE '' END || '}}' ELSE regexp_replace(tok, '[^\\r\\n]', '', 'g') END, '' ORDER BY idx)) AS plain,
md5(string_agg(CASE WHEN lx THEN tok || '{{' || lemma || CASE WHEN gs THEN '?' ELSE '' END || '=' || gr || '}}' ELSE tok END, '' ORDER BY idx)) AS grammar FROM rd GROUP BY doc_id""")
def format_text(spark, sf):
    """Text output of every document: bare, and copied with grammar; as digests."""
    d, k = analyzed(spark, sf), F.col("tokens")
    return d.select("doc_id", F.md5(S.to_text(k).cast("binary")).alias("plain"), F.md5(S.to_text(k, copy_input=True, gram_info=True).cast("binary")).alias("grammar"))


@query(f"""WITH {READ} SELECT doc_id, md5('[' || coalesce(string_agg('{{"text":"' || tok || '","analysis":[{{"lex":"' || lemma || '","gr":"' || gr || '"' || CASE WHEN gs THEN ',"qual":"bastard"' ELSE '' END || '}}]}}', ',' ORDER BY idx) FILTER (lx), '') || ']' || chr(10)) AS said FROM rd GROUP BY doc_id""")
def format_json(spark, sf):
    """Compatibility JSON of every document, as a digest."""
    return analyzed(spark, sf).select("doc_id", F.md5(S.to_json(F.col("tokens"), gram_info=True).cast("binary")).alias("said"))


@query(f"""WITH {READ}, o AS (SELECT doc_id, idx, '{{"schema_version":"textlattice.record.v1","record_type":"token","consumes_input":true,"token_index":' || idx || ',"text":"' || tok || '","start":' || s || ',"end":' || e || ',"kind":"' || kind || '","normalized":null,"mode":"lattice","resource_version":null,"ud_profile":"universal",' ||
'"analysis":[{{"lemma":"' || lemma || '","upos":"' || split_part(gr, ',', 1) || '","features":' || CASE WHEN surface IS NOT NULL THEN '{{"Case":"Nom"}}' WHEN kind = 'number' THEN '{{"NumType":"Card"}}' ELSE '{{}}' END || ',"tags":' || CASE WHEN surface IS NOT NULL THEN '["n","nom"]' WHEN kind = 'number' THEN '["num"]' ELSE '["unknown"]' END ||
',"morphemes":[{{"lemma":"' || lemma || '","tags":' || CASE WHEN surface IS NOT NULL THEN '["n","nom"]' WHEN kind = 'number' THEN '["num"]' ELSE '["unknown"]' END || ',"upos":"' || split_part(gr, ',', 1) || '","features":' || CASE WHEN surface IS NOT NULL THEN '{{"Case":"Nom"}}' WHEN kind = 'number' THEN '{{"NumType":"Card"}}' ELSE '{{}}' END ||
'}}],"raw":"' || lemma || CASE WHEN surface IS NOT NULL THEN '<n><nom>' WHEN kind = 'number' THEN '<num>' ELSE '<unknown>' END || '","source":"' || CASE WHEN surface IS NOT NULL THEN 'lexicon' WHEN kind = 'number' THEN 'rule' ELSE 'unknown' END || '","score":null,"guessed":' || CASE WHEN gs THEN 'true' ELSE 'false' END || ',"orthographic_variant":false,"lex":"' || lemma || '","gr":"' || gr || '","qual":' || CASE WHEN gs THEN '"guessed"' ELSE 'null' END || '}}],"selected":0,"sentence_end":false}}' AS line FROM rd WHERE lx)
SELECT d.doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY idx) || chr(10), '')) AS said FROM (SELECT DISTINCT doc_id FROM rd) d LEFT JOIN o ON d.doc_id = o.doc_id GROUP BY d.doc_id""")
def format_jsonl(spark, sf):
    """Lossless lines of every document's lexical tokens, as a digest."""
    return analyzed(spark, sf).select("doc_id", F.md5(S.to_jsonl(F.col("tokens"), F.col("spans")).cast("binary")).alias("said"))


def _xml(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '>', '&gt;'), '<', '&lt;')"


@query(f"""WITH {READ} SELECT doc_id, md5('<?xml version="1.0" encoding="UTF-8"?><html><body><se>' || string_agg(CASE WHEN lx THEN '<w>' || tok || '<ana lex="' || lemma || '"' || CASE WHEN gs THEN ' qual="bastard"' ELSE '' END || ' gr="' || gr || '" /></w>' ELSE {_xml('tok')} END, '' ORDER BY idx) || '</se></body></html>' || chr(10)) AS said FROM rd GROUP BY doc_id""")
def format_xml(spark, sf):
    """XML of every document, as a digest."""
    return analyzed(spark, sf).select("doc_id", F.md5(S.to_xml(F.col("tokens")).cast("binary")).alias("said"))


@query(f"""WITH {READ}, n AS (SELECT *, tok IN ('\\', '^', '$', '/', '<', '>', '{{', '}}', '[', ']', '@', '#', '*', '+', '~', '|', '=', '&', '`') AS own, coalesce(sum(CASE WHEN tok IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM rd WHERE kind <> 'space'),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent ORDER BY idx) AS i FROM n),
l AS (SELECT doc_id, idx, i || chr(9) || tok || chr(9) || CASE WHEN lx THEN lemma WHEN own THEN tok ELSE '_' END || chr(9) || CASE WHEN lx THEN split_part(gr, ',', 1) WHEN kind = 'punct' THEN 'PUNCT' WHEN own THEN 'SYM' ELSE 'X' END || chr(9) || '_' || chr(9) || CASE WHEN lx AND gr <> 'X' THEN split_part(gr, ',', 2) ELSE '_' END || chr(9) || '_' || chr(9) || '_' || chr(9) || '_' || chr(9) ||
'StartChar=' || s || '|EndChar=' || e || CASE WHEN own OR (lx AND gs) THEN '|Guess=Yes' ELSE '' END || chr(10) || CASE WHEN tok IN ('.', '!', '?') OR lead(idx) OVER (PARTITION BY doc_id ORDER BY idx) IS NULL THEN chr(10) ELSE '' END AS line FROM r)
SELECT d.doc_id, md5(coalesce(string_agg(line, '' ORDER BY idx), '')) AS conllu_md5 FROM (SELECT DISTINCT doc_id FROM rd) d LEFT JOIN l ON d.doc_id = l.doc_id GROUP BY d.doc_id""")
def documents_conllu(spark, sf):
    """CoNLL-U of every document under the benchmark's vocabulary, ends of sentences included; as a digest."""
    return analyzed(spark, sf).select("doc_id", F.md5(S.to_conllu(F.col("tokens")).cast("binary")).alias("conllu_md5"))


@query(f"""WITH {READ} SELECT kind, count(*) AS n, count(*) FILTER (surface IS NOT NULL) AS n_noun, count(*) FILTER (surface IS NOT NULL) AS n_case, CAST(0 AS BIGINT) AS n_loc, count(*) FILTER (surface IS NOT NULL) AS n_dictionary FROM rd WHERE lx GROUP BY kind""")
def filter_gram(spark, sf):
    """Tokens with a reading that conjunctive filters leave, by kind."""
    r = L.analyze(t(spark, sf, "documents"), bench_lexicon(spark, sf)).filter(F.col("kind").isin("word", "number"))
    n = lambda *f, d=False: F.count(F.when(F.size(R.visible(F.col("readings"), f, d)) > 0, 1))
    return r.groupBy("kind").agg(F.count("*").alias("n"), n("n", "NOUN").alias("n_noun"), n("Case=Nom", "nom").alias("n_case"), n("NOUN", "loc").alias("n_loc"), n(d=True).alias("n_dictionary"))


#: Letters that make words of the alphabet that may be guessed.
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгһижклмнопқрстувхйыз"
KZ = f"kz AS (SELECT DISTINCT translate(lower(w), '{LATIN}', '{CYRILLIC}') AS w FROM words)"


def cyrillic(spark, sf) -> DataFrame:
    return words(spark, sf).select(F.translate(F.lower("w"), LATIN, CYRILLIC).alias("w")).distinct()


ELIGIBLE = f"(regexp_matches({FOLD.format('w')}, '^[{G.ALPHABET}]{{1,32}}$') AND len(list_filter(range(1, length(w) - 1), lambda i: w[i] = w[i + 1] AND w[i + 1] = w[i + 2])) = 0)"


@query(f"WITH {WORDS}, {KZ} SELECT w AS surface, {ELIGIBLE} AS eligible FROM kz")
def guess_eligibility(spark, sf):
    """Words, written in another alphabet, that may be guessed."""
    return cyrillic(spark, sf).select(F.col("w").alias("surface"), G.eligible(F.col("w")).alias("eligible"))


ROOT = """CASE draw WHEN 0 THEN w WHEN 1 THEN w[1:greatest(length(w) - 2, 0)] WHEN 2 THEN w[1:greatest(length(w) - 3, 0)] || 'п' ELSE 'зат' END"""


@query(f"""WITH {WORDS}, {KZ}, r0 AS (SELECT w, {draw_sql('w', 4)} AS draw FROM kz), r AS (SELECT w, {ROOT} AS l FROM r0), f AS (SELECT w, l, {FOLD.format('w')} AS fw, {FOLD.format('l')} AS fl FROM r)
SELECT w AS surface, l AS lemma, CASE WHEN fl = '' OR length(fl) > length(fw) THEN NULL WHEN starts_with(fw, fl) THEN 'identity' WHEN length(fl) >= 2 AND length(fl) < length(fw) AND fw[1:length(fl) - 1] = fl[1:length(fl) - 1] AND fw[length(fl)] || fl[length(fl)] IN ('бп', 'гк', 'ғқ') THEN 'stem_final_alternation' END AS kind FROM f""")
def root_kind(spark, sf):
    """How made-up lemmas stand in words."""
    w = F.col("w")
    cut = lambda n: F.substring(w, F.lit(1), F.greatest(F.length(w) - n, F.lit(0)))
    k = draw(w, 4)
    d = cyrillic(spark, sf).select(w.alias("surface"), F.when(k == 0, w).when(k == 1, cut(2)).when(k == 2, F.concat(cut(3), F.lit("п"))).otherwise("зат").alias("lemma"))
    return d.withColumn("kind", G.root_kind(F.col("surface"), F.col("lemma")))


@query(f"""WITH {WORDS}, {KZ}, a AS (SELECT w FROM kz WHERE {ELIGIBLE} AND length(w) >= 5), h AS (SELECT w, unnest([0, 1, 2]) AS k FROM a),
r AS (SELECT w, k, CASE k WHEN 0 THEN w[1:length(w) - 2] WHEN 1 THEN w ELSE w[1:length(w) - 3] END AS l FROM h), s AS (SELECT *, l || CASE k WHEN 0 THEN '<n><pl><nom>' WHEN 1 THEN '<v><tv><fut>' ELSE '<n><px1sg><loc>' END AS raw,
0.35::DOUBLE + 1.15::DOUBLE * CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END + 0.18::DOUBLE * (length(w) - length(l)) + CASE k WHEN 0 THEN 0.75::DOUBLE WHEN 2 THEN 1.75::DOUBLE ELSE 0 END - CASE k WHEN 1 THEN 1.0::DOUBLE ELSE 0 END AS score FROM r
WHERE length(l) >= 2 AND regexp_matches(l, '[{G.VOWELS}]') AND NOT regexp_matches(l, '[ьъ]$') AND NOT contains(l, 'ыы') AND NOT contains(l, 'іі')),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY w ORDER BY score DESC, length(l), raw) AS INT) AS rank FROM s), b AS (SELECT * FROM n WHERE rank <= 2)
SELECT w AS surface, rank, raw, round(exp(score) / sum(exp(score)) OVER (PARTITION BY w), 6) AS score FROM b""")
def guess_topk_softmax(spark, sf):
    """The best two hypotheses of every word that may be guessed, scores normalised."""
    w = F.col("w")
    some = cyrillic(spark, sf).filter(F.length("w") >= 5)
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    raws = F.array(F.concat(cut(2), F.lit("<n><pl><nom>")), F.concat(w, F.lit("<v><tv><fut>")), F.concat(cut(3), F.lit("<n><px1sg><loc>")))
    rel = some.select(w.alias("surface"), F.explode(raws).alias("raw"))
    return G.guess(rel, rel, limit=2).select("surface", "rank", "reading.raw", F.round("score", 6).alias("score"))


OUTCOMES = f"""{WORDS}, {KZ}, e AS (SELECT w, {ELIGIBLE} AS ok FROM kz), h AS (SELECT w, unnest([0, 1, 2]) AS k FROM e WHERE ok AND length(w) >= 5),
r AS (SELECT w, CASE k WHEN 0 THEN w[1:length(w) - 2] WHEN 1 THEN w ELSE w[1:length(w) - 3] END AS l FROM h),
s AS (SELECT w, count(*) AS n FROM r WHERE length(l) >= 2 AND regexp_matches(l, '[{G.VOWELS}]') AND NOT regexp_matches(l, '[ьъ]$') AND NOT contains(l, 'ыы') AND NOT contains(l, 'іі') GROUP BY w)"""


@query(f"""WITH {OUTCOMES} SELECT outcome, count(*) AS n, CAST(sum(n_raw) AS BIGINT) AS n_raw, CAST(sum(n_guesses) AS BIGINT) AS n_guesses FROM
(SELECT CASE WHEN NOT ok THEN 'not eligible' WHEN length(w) < 5 THEN 'no relation' WHEN n IS NULL THEN 'rejected' ELSE 'guessed' END AS outcome, CASE WHEN length(w) >= 5 THEN 3 ELSE 0 END AS n_raw, least(coalesce(n, 0), 2) AS n_guesses FROM e LEFT JOIN s USING (w)) GROUP BY outcome""")
def guess_outcomes(spark, sf):
    """What became of every word: guessed, rejected, without a relation, not eligible."""
    w = F.col("w")
    some = cyrillic(spark, sf).filter(F.length("w") >= 5)
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    raws = F.array(F.concat(cut(2), F.lit("<n><pl><nom>")), F.concat(w, F.lit("<v><tv><fut>")), F.concat(cut(3), F.lit("<n><px1sg><loc>")))
    rel = some.select(w.alias("surface"), F.explode(raws).alias("raw"))
    out = G.outcomes(cyrillic(spark, sf).select(w.alias("surface")), rel, limit=2)
    return out.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("n_raw").alias("n_raw"), F.sum("n_guesses").alias("n_guesses"))


@query(f"""WITH {LEX} SELECT md5(surface) AS query_id, CAST(0 AS INT) AS ord, surface FROM lex WHERE NOT contains(surface, '+') AND {draw_sql('surface', 6)} <> 5""")
def generate_forms(spark, sf):
    """Surfaces of lemmas with tags through the inverse lexicon; malformed queries have none."""
    lex = bench_lexicon(spark, sf).filter(~F.contains("surface", F.lit("+"))).withColumn("raw", F.concat("surface", F.lit("<n><nom>")))
    tags = F.when(draw(F.col("surface"), 6) == 5, F.array(F.lit("n"), F.lit("a b"))).otherwise(F.array(F.lit("<n>"), F.lit("nom")))
    q = lex.select(F.md5(F.col("surface").cast("binary")).alias("query_id"), F.col("surface").alias("lemma"), tags.alias("tags"))
    return L.generate(lex, q).select("query_id", "ord", "surface")


@query(f"WITH {WORDS} SELECT w AS x, {FOLD.format('w')} AS folded FROM words")
def casefold_keys(spark, sf):
    """Case folds of all words."""
    return words(spark, sf).select(F.col("w").alias("x"), X.casefold(F.col("w")).alias("folded"))



TALKS = "FROM (SELECT conv_id || '-' || turn AS doc_id, '' AS lang, text FROM conversations)"


@query(ORACLES["documents_conllu"].replace("FROM documents)", TALKS + ")"))
def format_conllu(spark, sf):
    """CoNLL-U of every turn of the conversations, as a digest."""
    d = Engine(spark, bench_lexicon(spark, sf)).documents(talks(spark, sf))
    return d.select("doc_id", F.md5(S.to_conllu(F.col("tokens")).cast("binary")).alias("conllu_md5"))


VIEWS = [("num", "NUM:NumType=Ord", "NUM:NumType=Ord;NUM:NumType=Card,Ord"), ("num ord", "", ""), ("adj subst nom", "NOUN:Case=Nom", "NOUN:Case=Nom"), ("n attr", "ADJ:Case=Nom", "ADJ:Case=Nom"), ("adj advl", "ADV:", "ADV:"), ("prn", "", "")]


@query(f"""WITH {WORDS}, k AS ({values('k INT, said VARCHAR, profile VARCHAR, views VARCHAR', [(i, v[0], p, v[1 + j]) for i, v in enumerate(VIEWS) for j, p in enumerate(("universal", "ktb"))])})
SELECT w[1] AS letter, said, profile, views, count(*) AS n FROM words JOIN k ON k = {draw_sql('w', len(VIEWS))} GROUP BY ALL""")
def ud_alternatives(spark, sf):
    """Views that usage tags and bare decimals license, for tags dealt to all words."""
    said = F.array(*(F.lit(v[0]) for v in VIEWS))
    d = words(spark, sf).select(F.substring("w", 1, 1).alias("letter"), F.get(said, draw(F.col("w"), len(VIEWS))).alias("said")).groupBy("letter", "said").agg(F.count("*").alias("n")).withColumn("tags", F.split("said", " "))
    show = lambda c: F.array_join(F.transform(c, lambda v: F.concat(v["upos"], F.lit(":"), shown(v["features"]))), ";")
    one = lambda p: d.select("letter", "said", F.lit(p).alias("profile"), show(T.alternatives(F.col("tags"), F.lit(True), p)).alias("views"), "n")
    return one("universal").union(one("ktb"))
