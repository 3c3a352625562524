"""Queries over small stated inputs.  Their SQL states the rows that published examples give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlattice.functions import readings as R
from textlattice.functions import tags as T
from textlattice.functions import text as X
from textlattice.operators import align as A
from textlattice.operators import evaluate as E
from textlattice.operators import guess as G
from textlattice.operators import lattice as L
from textlattice.operators import select as C
from textlattice.operators import serialize as S
from textlattice.operators import transducer as D
from textlattice.sources import conllu, files, tables

QUERIES, ORACLES = {}, {}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + v.replace("'", "''") + "'"


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of stated rows; ``columns`` are name and DuckDB type, comma separated."""
    cols = [c.strip().split(" ") for c in columns.split(",")]
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return "SELECT " + ", ".join(f'CAST("{n}" AS {k}) AS "{n}"' for n, k in cols) + f" FROM (VALUES {body}) t(" + ", ".join(f'"{n}"' for n, _ in cols) + ")"


def expects(columns: str, rows: list[tuple]):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = values(columns, rows)
        return f

    return add


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def feats(c):
    return T.feature_text(c, "|")


RAW = [
    "сәлем<ij>", "сәлем<n><nom>", "сәлем<ij>+е<cop><aor><p3><sg>", "бақша<n><loc>+ма<qst>", "Foobar<np><unk>", "сөз<n><future_tag><loc>", "қате<n><err_orth><nom>", "opaque", "", "*foobar", "foobar+?", "C\\+\\+<abbr>",
]


@expects("raw VARCHAR, lemma VARCHAR, upos VARCHAR, tags VARCHAR, features VARCHAR, n_morphemes INT, last_features VARCHAR, guessed BOOLEAN, variant BOOLEAN", [
    ("сәлем<ij>", "сәлем", "INTJ", "ij", "", 1, "", False, False), ("сәлем<n><nom>", "сәлем", "NOUN", "n,nom", "Case=Nom", 1, "Case=Nom", False, False),
    ("сәлем<ij>+е<cop><aor><p3><sg>", "сәлем", "INTJ", "ij,cop,aor,p3,sg", "", 2, "Aspect=Hab|Mood=Ind|Number=Sing|Person=3|Tense=Pres|VerbForm=Fin", False, False),
    ("бақша<n><loc>+ма<qst>", "бақша", "NOUN", "n,loc,qst", "Case=Loc", 2, "PartType=Int", False, False), ("Foobar<np><unk>", "Foobar", "PROPN", "np,unk", "Foreign=Yes", 1, "Foreign=Yes", True, False),
    ("сөз<n><future_tag><loc>", "сөз", "NOUN", "n,future_tag,loc", "Case=Loc", 1, "Case=Loc", False, False), ("қате<n><err_orth><nom>", "қате", "NOUN", "n,err_orth,nom", "Case=Nom|Typo=Yes", 1, "Case=Nom|Typo=Yes", False, True),
    ("opaque", "opaque", "X", "", "", 1, "", False, False), ("", None, None, None, None, None, None, None, None), ("*foobar", None, None, None, None, None, None, None, None), ("foobar+?", None, None, None, None, None, None, None, None),
    ("C\\+\\+<abbr>", "C++", "NOUN", "abbr", "Abbr=Yes", 1, "Abbr=Yes", False, False),
])
def parse_readings(spark, sf):
    """Raw readings to lemma, class, tags and features."""
    d = rows(spark, [(x,) for x in RAW], "raw string").withColumn("r", R.parse(F.col("raw")))
    return d.select("raw", "r.lemma", "r.upos", F.array_join("r.tags", ",").alias("tags"), feats(F.col("r.features")).alias("features"), F.when(F.col("r").isNotNull(), F.size("r.morphemes")).alias("n_morphemes"),
                    feats(F.element_at("r.morphemes", -1)["features"]).alias("last_features"), "r.guessed", F.col("r.orthographic_variant").alias("variant"))


PROJECTED = [
    ("np top gen", "PROPN", "Case=Gen|NameType=Geo", "Case=Gen"), ("n attr", "NOUN", "Case=Nom", "Case=Nom"), ("n equ gen", "NOUN", "Case=Gen", "Case=Gen"), ("n gen loc", "NOUN", "Case=Loc", "Case=Loc"), ("n equ", "NOUN", "Case=Equ", ""),
    ("prn dem", "PRON", "PronType=Dem", "PronType=Dem"), ("prn ref px3sp", "PRON", "Number[psor]=Plur,Sing|Person[psor]=3|PronType=Prs|Reflex=Yes", "Number[psor]=Plur,Sing|Person[psor]=3|PronType=Prs|Reflex=Yes"),
    ("num coll", "NUM", "NumType=Sets", "NumType=Coll"), ("num ord", "NUM", "NumType=Ord", "NumType=Ord"), ("num", "NUM", "NumType=Card", "NumType=Card"), ("np ant f", "PROPN", "Gender=Fem|NameType=Giv", "Gender=Fem"),
    ("v tv past p3 sg", "VERB", "Mood=Ind|Number=Sing|Person=3|Tense=Past|VerbForm=Fin", "Mood=Ind|Number=Sing|Person=3|Tense=Past|VerbForm=Fin"), ("v iv neg ifi_evid p1 pl", "VERB", "Evident=Nfh|Mood=Ind|Number=Plur|Person=1|Polarity=Neg|Tense=Past|VerbForm=Fin", "Evident=Fh|Mood=Ind|Number=Plur|Person=1|Polarity=Neg|Tense=Past|VerbForm=Fin"),
    ("v tv caus pass gna_perf", "VERB", "Aspect=Perf|VerbForm=Conv|Voice=Cau,Pass", "Aspect=Perf|VerbForm=Conv|Voice=Cau,Pass"), ("v iv recip imp p2 sg", "VERB", "Mood=Imp|Number=Sing|Person=2|PronType=Rcp|VerbForm=Fin|Voice=Rcp".replace("PronType=Rcp|", ""), "Mood=Imp|Number=Sing|Person=2|VerbForm=Fin|Voice=Rcp"),
    ("adj comp", "ADJ", "Degree=Cmp", "Degree=Cmp"), ("mod_ass", "PART", "PartType=Mod", ""), ("det neg", "DET", "PronType=Neg", "PronType=Neg"), ("prn neg itg", "PRON", "PronType=Int", "PronType=Int"), ("v tv ger_ppot nom", "VERB", "Case=Nom|Mood=Pot|Tense=Past|VerbForm=Ger", "Case=Nom|Mood=Pot|Tense=Past|VerbForm=Ger"),
    ("n pl px1sg dat", "NOUN", "Case=Dat|Number=Plur|Number[psor]=Sing|Person[psor]=1", "Case=Dat|Number=Plur|Number[psor]=Sing|Person[psor]=1"), ("strange", "X", "", ""),
]


def _projected(spark, profile):
    d = rows(spark, [(x[0],) for x in PROJECTED], "said string").withColumn("tags", F.split("said", " "))
    return T.project(d, "tags", profile).select("said", "upos", feats(F.col("features")).alias("features"))


@expects("said VARCHAR, upos VARCHAR, features VARCHAR", [(a, b, c) for a, b, c, _ in PROJECTED])
def ud_projection_universal(spark, sf):
    """Tag tuples to class and features."""
    return _projected(spark, "universal")


@expects("said VARCHAR, upos VARCHAR, features VARCHAR", [(a, b, d) for a, b, _, d in PROJECTED])
def ud_projection_ktb(spark, sf):
    """The same under the treebank's profile."""
    return _projected(spark, "ktb")


@expects("said VARCHAR, profile VARCHAR, views VARCHAR", [
    ("num", "universal", "NUM:NumType=Ord"), ("num", "ktb", "NUM:NumType=Ord;NUM:NumType=Card,Ord"), ("num ord", "universal", ""), ("num ord", "ktb", ""), ("adj subst nom", "universal", "NOUN:Case=Nom"), ("adj subst nom", "ktb", "NOUN:Case=Nom"),
    ("n attr", "universal", "ADJ:Case=Nom"), ("n attr", "ktb", "ADJ:Case=Nom"), ("adj advl", "universal", "ADV:"), ("adj advl", "ktb", "ADV:"), ("prn", "universal", ""), ("prn", "ktb", ""),
])
def ud_alternatives(spark, sf):
    """Views that usage tags and bare decimals license."""
    d = rows(spark, [(x,) for x in ("num", "num ord", "adj subst nom", "n attr", "adj advl", "prn")], "said string").withColumn("tags", F.split("said", " "))
    show = lambda c: F.array_join(F.transform(c, lambda v: F.concat(v["upos"], F.lit(":"), feats(v["features"]))), ";")
    one = lambda p: d.select("said", F.lit(p).alias("profile"), show(T.alternatives(F.col("tags"), F.lit(True), p)).alias("views"))
    return one("universal").union(one("ktb"))


LEXICON = [("сәлем", 0, "сәлем<n><nom>"), ("сәлем", 1, "сәлем<ij>"), ("1991", 0, "1991<num>"), ("жақсы", 0, "жақсы<adj><subst><nom>"), ("екі", 0, "екі<num>"), ("сөз", 0, "сөз<n><nom>"), ("сөз", 1, "сөз<n><attr>"), ("екі сөз", 0, "екі сөз<n><nom>")]
TEXT = "Сәлем сәлем 1991 жақсы, екі сөз 42 белгісіз"


def lexicon(spark):
    return rows(spark, LEXICON, "surface string, cand_idx int, raw string")


@expects("tok_idx INT, text VARCHAR, kind VARCHAR, selected INT, readings VARCHAR", [
    (0, "Сәлем", "word", 0, "X/unknown"), (1, " ", "space", None, ""), (2, "сәлем", "word", None, "NOUN/lexicon;INTJ/lexicon"), (3, " ", "space", None, ""), (4, "1991", "number", None, "NUM/lexicon;NUM/rule"), (5, " ", "space", None, ""),
    (6, "жақсы", "word", None, "ADJ/lexicon;NOUN/rule"), (7, ",", "punct", None, ""), (8, " ", "space", None, ""), (9, "екі", "number", 0, "NUM/lexicon"), (10, " ", "space", None, ""), (11, "сөз", "word", None, "PROPN/fixlist;X/fixlist"),
    (12, " ", "space", None, ""), (13, "42", "number", 0, "NUM/rule"), (14, " ", "space", None, ""), (15, "белгісіз", "word", 0, "X/unknown"),
])
def fixlist_override(spark, sf):
    """A whole lattice: aliases follow originals, a fixlist replaces, fallbacks fill."""
    fix = rows(spark, [("сөз", 0, "Сөз<np>"), ("сөз", 1, "сөз<x>")], "form_key string, ord int, raw string")
    d = L.analyze(rows(spark, [(1, TEXT)], "doc_id long, text string"), lexicon(spark), fix)
    return d.select("tok_idx", "text", "kind", "selected", F.array_join(F.transform("readings", lambda r: F.concat(r["upos"], F.lit("/"), r["source"])), ";").alias("readings"))


@expects("start INT, \"end\" INT, token_start INT, token_end INT, text VARCHAR".replace('"', ""), [(24, 31, 9, 12, "екі сөз")])
def lexicon_phrases(spark, sf):
    """Phrases of the lexicon in a text."""
    p = L.phrase_spans(rows(spark, [(1, TEXT)], "doc_id long, text string"), lexicon(spark))
    return p.select("start", "end", "token_start", "token_end", "text")


def document(spark) -> DataFrame:
    """Сәлем ! with scored readings, the first selected."""
    sql = """
    SELECT array(
      named_struct('tok_idx', 0, 'text', 'Сәлем', 'start', 0, 'end', 5, 'kind', 'word', 'sentence_end', false, 'normalized', 'Сәлем', 'selected', 0, 'raws', array('сәлем<n><nom>', 'сәлем<ij>'), 'scores', array(0.75D, 0.25D)),
      named_struct('tok_idx', 1, 'text', ' ', 'start', 5, 'end', 6, 'kind', 'space', 'sentence_end', false, 'normalized', ' ', 'selected', null, 'raws', array(), 'scores', array()),
      named_struct('tok_idx', 2, 'text', '!', 'start', 6, 'end', 7, 'kind', 'punct', 'sentence_end', true, 'normalized', '!', 'selected', null, 'raws', array(), 'scores', array())) AS t"""
    d = spark.sql(sql)
    fields = ["tok_idx", "text", "start", "end", "kind", "sentence_end", "normalized"]
    made = lambda t: F.zip_with(t["raws"], t["scores"], lambda r, s: R.parse(r, score=s))
    return d.select(F.transform("t", lambda t: F.struct(*[t[c].alias(c) for c in fields], t["selected"].cast("int").alias("selected"), made(t).alias("readings"))).alias("tokens"))


@expects("variant VARCHAR, said VARCHAR", [
    ("default", "Сәлем{сәлем|сәлем}"), ("copy", "Сәлем{сәлем|сәлем} !"), ("lemmas grammar weights", "сәлем:0.750000=NOUN,Case=Nom|сәлем:0.250000=INTJ"), ("merged", "сәлем:1.000000=(NOUN,Case=Nom|INTJ)"), ("copy newline", "Сәлем{сәлем|сәлем}\n_\n!\n"),
    ("copy sentences", "Сәлем{сәлем|сәлем} !{\\s}"), ("filter", "Сәлем{сәлем}"), ("selected", "Сәлем{сәлем=NOUN,Case=Nom}"),
])
def format_text(spark, sf):
    """Text output under its options."""
    d, t = document(spark), F.col("tokens")
    out = {
        "default": S.to_text(t), "copy": S.to_text(t, copy_input=True), "lemmas grammar weights": S.to_text(t, lemmas_only=True, gram_info=True, weights=True),
        "merged": S.to_text(t, lemmas_only=True, gram_info=True, weights=True, merge=True), "copy newline": S.to_text(t, copy_input=True, newline=True), "copy sentences": S.to_text(t, copy_input=True, sentence_markers=True),
        "filter": S.to_text(t, filters=("INTJ",)), "selected": S.to_text(t, gram_info=True, selected_only=True),
    }
    return d.select(F.inline(F.array(*[F.struct(F.lit(k).alias("variant"), v.alias("said")) for k, v in out.items()])))


@expects("variant VARCHAR, said VARCHAR", [
    ("plain", '[{"text":"Сәлем","analysis":[{"lex":"сәлем"},{"lex":"сәлем"}]}]\n'),
    ("all", '[{"text":"Сәлем","analysis":[{"lex":"сәлем","gr":"NOUN,Case=Nom","wt":0.75},{"lex":"сәлем","gr":"INTJ","wt":0.25}]},{"text":" "},{"text":"!"}]\n'), ("merged", '{"text":"Сәлем","analysis":[{"lex":"сәлем","gr":"(NOUN,Case=Nom|INTJ)","wt":1.0}]}\n'),
])
def format_json(spark, sf):
    """Compatibility JSON."""
    d, t = document(spark), F.col("tokens")
    out = {"plain": S.to_json(t), "all": S.to_json(t, copy_input=True, gram_info=True, weights=True), "merged": S.to_json(t, newline=True, gram_info=True, merge=True, weights=True)}
    return d.select(F.inline(F.array(*[F.struct(F.lit(k).alias("variant"), v.alias("said")) for k, v in out.items()])))


@expects("said VARCHAR", [(
    '{"schema_version":"textlattice.record.v1","record_type":"token","consumes_input":true,"token_index":0,"text":"Сәлем","start":0,"end":5,"kind":"word","normalized":"Сәлем","mode":"lattice","resource_version":null,"ud_profile":"universal",'
    '"analysis":[{"lemma":"сәлем","upos":"INTJ","features":{},"tags":["ij"],"morphemes":[{"lemma":"сәлем","tags":["ij"],"upos":"INTJ","features":{}}],"raw":"сәлем<ij>","source":"lexicon","score":0.25,"guessed":false,"orthographic_variant":false,"lex":"сәлем","gr":"INTJ","qual":null}],'
    '"selected":null,"sentence_end":false}\n',
)])
def format_jsonl(spark, sf):
    """Lossless lines under a filter that hides the chosen reading."""
    return document(spark).select(S.to_jsonl(F.col("tokens"), filters=("INTJ",)).alias("said"))


@expects("said VARCHAR", [('<?xml version="1.0" encoding="UTF-8"?><html><body><se><w>Сәлем<ana lex="сәлем" gr="NOUN,Case=Nom" wt="0.75" /><ana lex="сәлем" gr="INTJ" wt="0.25" /></w> !</se></body></html>\n',)])
def format_xml(spark, sf):
    """XML output."""
    return document(spark).select(S.to_xml(F.col("tokens"), weights=True, sentence_markers=True).alias("said"))


@expects("said VARCHAR", [("1\tСәлем\tсәлем\tNOUN\t_\tCase=Nom\t_\t_\t_\tStartChar=0|EndChar=5|Candidates=2\n2\t!\t_\tPUNCT\t_\t_\t_\t_\t_\tStartChar=6|EndChar=7\n\n",)])
def format_conllu(spark, sf):
    """CoNLL-U output."""
    return document(spark).select(S.to_conllu(F.col("tokens")).alias("said"))


@expects("value VARCHAR, quoted VARCHAR", [("a&b<c>", '"a&amp;b&lt;c&gt;"'), ('say "x"', "'say \"x\"'"), ("it's \"x\"", '"it\'s &quot;x&quot;"')])
def xml_attributes(spark, sf):
    """Quoting of attribute values."""
    return rows(spark, [("a&b<c>",), ('say "x"',), ("it's \"x\"",)], "value string").withColumn("quoted", X.quote_attribute(F.col("value")))


@expects("variant VARCHAR, n INT", [("all", 2), ("INTJ", 1), ("Case=Nom", 1), ("n Case=Nom NOUN", 1), ("loc", 0), ("dictionary", 2)])
def filter_gram(spark, sf):
    """Visible readings under conjunctive filters."""
    d, r = document(spark), F.col("tokens")[0]["readings"]
    out = {"all": (), "INTJ": ("INTJ",), "Case=Nom": ("Case=Nom",), "n Case=Nom NOUN": ("n", "Case=Nom", "NOUN"), "loc": ("loc",)}
    shown = [F.struct(F.lit(k).alias("variant"), F.size(R.visible(r, v)).alias("n")) for k, v in out.items()] + [F.struct(F.lit("dictionary").alias("variant"), F.size(R.visible(r, (), True)).alias("n"))]
    return d.select(F.inline(F.array(*shown)))


SURFACES = ["сөздер", "кітабы", "жүрегі", "қазағы", "аузы", "орны", "кітаты", "аааңқа", "hello", "", "сәл-ем", "қ" * 33]


@expects("surface VARCHAR, eligible BOOLEAN", [(s, s in ("сөздер", "кітабы", "жүрегі", "қазағы", "аузы", "орны", "кітаты")) for s in SURFACES])
def guess_eligibility(spark, sf):
    """Surfaces that may be guessed."""
    return rows(spark, [(s,) for s in SURFACES], "surface string").withColumn("eligible", G.eligible(F.col("surface")))


ROOTS = [("сөздер", "сөз", "identity"), ("кітабы", "кітап", "stem_final_alternation"), ("жүрегі", "жүрек", "stem_final_alternation"), ("қазағы", "қазақ", "stem_final_alternation"), ("аузы", "ауыз", None), ("орны", "орын", None), ("кітаты", "кітап", None), ("кітаб", "кітап", None), ("бы", "п", None)]


@expects("surface VARCHAR, lemma VARCHAR, kind VARCHAR", ROOTS)
def root_kind(spark, sf):
    """How lemmas stand in surfaces."""
    return rows(spark, [r[:2] for r in ROOTS], "surface string, lemma string").withColumn("kind", G.root_kind(F.col("surface"), F.col("lemma")))


HYPOTHESES = [("алмалар", "алма<n><pl><nom>"), ("алмалар", "алмала<v><tv><fut>"), ("алмалар", "алмалар<n><nom>"), ("алмалар", "зат<n><nom>"), ("алмалар", "ал<v><tv><neg><past>"), ("алмаларымда", "алма<n><pl><px1sg><loc>"), ("алмаларымда", "алмаларымда<n><nom>")]


@expects('surface VARCHAR, rank INT, raw VARCHAR, score DOUBLE', [])
def guess_topk_softmax(spark, sf):
    """Best two hypotheses of each surface, scores normalised."""
    rel = rows(spark, HYPOTHESES, "surface string, raw string")
    return G.guess(rel, rel, limit=2).select("surface", "rank", "reading.raw", F.round("score", 6).alias("score"))


# алмалар: ал 0.35+3*1.15... informative tags of ал<v><tv><neg><past>: neg, past; stripped 5; neg 0.7.  алмала: fut, stripped 1.  алма: none, stripped 3, noun.
ORACLES["guess_topk_softmax"] = """
WITH s(surface, raw, lemma_len, score) AS (VALUES ('алмалар', 'ал<v><tv><neg><past>', 2, 0.35 + 1.15 * 2 + 0.18 * 5 + 0.7), ('алмалар', 'алмала<v><tv><fut>', 6, 0.35 + 1.15 + 0.18),
 ('алмалар', 'алма<n><pl><nom>', 4, 0.35 + 0.18 * 3 + 0.75), ('алмалар', 'алмалар<n><nom>', 7, 0.35 + 0.75 - 1.0), ('алмаларымда', 'алма<n><pl><px1sg><loc>', 4, 0.35 + 1.15 * 2 + 0.18 * 7 + 0.75 + 2.4), ('алмаларымда', 'алмаларымда<n><nom>', 11, 0.35 + 0.75 - 1.0)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY surface ORDER BY score DESC, lemma_len, raw) AS INT) AS rank FROM s), k AS (SELECT * FROM r WHERE rank <= 2)
SELECT surface, rank, raw, round(exp(CAST(score AS DOUBLE)) / sum(exp(CAST(score AS DOUBLE))) OVER (PARTITION BY surface), 6) AS score FROM k"""


@expects("tok_idx INT, cand_idx INT, score DOUBLE, is_selected BOOLEAN, context_upos VARCHAR", [
    (0, 0, 0.000002, False, None), (0, 1, 0.999998, True, None), (1, 0, 0.5, True, None), (1, 1, 0.5, False, None), (2, 0, 1.0, True, "AUX"), (3, 0, None, False, None),
])
def neural_rerank(spark, sf):
    """Predictions re-rank: a clear win, an exact tie, an auxiliary, a span that nothing predicts."""
    f = "array<struct<k:string,v:string>>"
    r = rows(spark, [
        (1, 0, 0, 4, "word", 0, "ат", "NOUN", [("Case", "Nom")], None), (1, 0, 0, 4, "word", 1, "атта", "VERB", [("Mood", "Imp")], None), (1, 1, 5, 8, "word", 0, "көк", "ADJ", [], None), (1, 1, 5, 8, "word", 1, "көк", "ADJ", [], None),
        (1, 2, 9, 12, "word", 0, "жүр", "VERB", [], None), (1, 3, 13, 15, "word", 0, "ол", "PRON", [], None),
    ], f"doc_id long, tok_idx int, start int, end int, kind string, cand_idx int, lemma string, upos string, features {f}, score double")
    p = rows(spark, [(1, 0, 4, 0, "атта", "атта", "VERB", [("Mood", "Imp")]), (1, 5, 8, 1, "көк", "көк", "ADJ", []), (1, 9, 12, 2, "жүр", "жүр", "AUX", []), (1, 13, 14, 3, "ол", "ол", "PRON", [])], f"doc_id long, start int, end int, ord int, text string, lemma string, upos string, features {f}")
    return C.rerank(r, p).select("tok_idx", "cand_idx", F.round("score", 6).alias("score"), "is_selected", "context_upos")


# Token 0: 6 + 3 + 0.55 against 0: both without shared keys, so exp(-9.55) (lemma 'ат' is not the surface).
ORACLES["neural_rerank"] = """SELECT tok_idx, cand_idx, round(CAST(score AS DOUBLE), 6) AS score, is_selected, context_upos FROM (VALUES
(CAST(0 AS INT), CAST(0 AS INT), exp(-9.55::DOUBLE) / (1 + exp(-9.55::DOUBLE)), FALSE, NULL), (0, 1, 1 / (1 + exp(-9.55::DOUBLE)), TRUE, NULL), (1, 0, 0.5, TRUE, NULL), (1, 1, 0.5, FALSE, NULL), (2, 0, 1.0, TRUE, 'AUX'), (3, 0, NULL, FALSE, NULL)) t(tok_idx, cand_idx, score, is_selected, context_upos)"""


@expects("tok_idx INT, n INT, selected INT", [(0, 1, 1), (1, 1, 0), (2, 2, None)])
def rule_disambiguation(spark, sf):
    """SELECT and REMOVE rules in context; a last reading is never removed."""
    r = rows(spark, [(1, 0, 0, ["n", "nom"]), (1, 0, 1, ["v", "imp"]), (1, 1, 0, ["adj"]), (1, 2, 0, ["n"]), (1, 2, 1, ["np"])], "doc_id long, tok_idx int, cand_idx int, tags array<string>")
    return C.select_single(C.apply_rules(r, [("SELECT", "v", [(1, "adj")]), ("REMOVE", "adj", []), ("REMOVE", "np", [(-1, "v")])])).drop("doc_id")


GOLD = "﻿# sent_id = s1\n# text = Мен келдім.\n1\tМен\tмен\tpron\t_\tCase=Nom|Person=1\t2\tnsubj\t_\t_\n2\tкелдім\tкел\tVERB\t_\t_\t0\troot\t_\tSpaceAfter=No\n3\t.\t.\tPUNCT\t_\t_\t2\tpunct\t_\t_\n\n1-2\tекібол\t_\t_\t_\t_\t_\t_\t_\t_\n1\tекі\tекі\tNUM\t_\t_\t2\tx\t_\t_\n2\tбол\tбол\tAUX\t_\t_\t0\tx\t_\t_\n2.1\tx\t_\t_\t_\t_\t_\t_\t_\t_\n3\tбар\tбар\tADJ\t_\tb=1|a=2\t0\tx\t_\tSpaceAfter=No\n\nbad\trow\n"


@expects("sent_id VARCHAR, ordinal INT, tok_id INT, form VARCHAR, upos VARCHAR, features VARCHAR, text VARCHAR, used_text_comment BOOLEAN, empty_nodes BIGINT", [
    ("g#0", 0, 1, "Мен", "PRON", "Case=Nom|Person=1", "Мен келдім.", True, 0), ("g#0", 1, 2, "келдім", "VERB", "", "Мен келдім.", True, 0), ("g#0", 2, 3, ".", "PUNCT", "", "Мен келдім.", True, 0),
    ("g#1", 0, 1, "екі", "NUM", "", "екібол бар", False, 1), ("g#1", 1, 2, "бол", "AUX", "", "екібол бар", False, 1), ("g#1", 2, 3, "бар", "ADJ", "a=2|b=1", "екібол бар", False, 1),
])
def conllu_parse(spark, sf):
    """Gold with a comment, a multiword row, an empty node and a byte-order mark."""
    p = conllu.parse(rows(spark, [("g", GOLD)], "path string, text string"))
    return p["tokens"].join(p["sentences"], "sent_id").select("sent_id", "ordinal", "tok_id", "form", "upos", feats(F.col("features")).alias("features"), "text", "used_text_comment", "empty_nodes")


@expects("line_no INT, message VARCHAR", [(13, "expected 10 columns")])
def conllu_errors(spark, sf):
    """Malformed gold rows with their line."""
    return conllu.parse(rows(spark, [("g", GOLD)], "path string, text string"))["errors"].select("line_no", "message")


@expects("x VARCHAR, decoded VARCHAR", [("\\s", " "), ("a\\pb\\\\s", "a|b\\s"), ("\\n\\t", "\n\t")])
def conllu_spaces(spark, sf):
    """Escapes of white space in MISC."""
    return rows(spark, [("\\s",), ("a\\pb\\\\s",), ("\\n\\t",)], "x string").withColumn("decoded", conllu.spaces(F.col("x")))


@expects("lemma_correct BIGINT, lemma_total BIGINT, upos_correct BIGINT, upos_total BIGINT, features_correct BIGINT, features_total BIGINT, full_correct BIGINT, full_total BIGINT, gold_subset_correct BIGINT, candidate_subset_correct BIGINT", [(2, 3, 2, 4, 1, 4, 1, 3, 2, 2)])
def metric_set(spark, sf):
    """Recall over candidate sets: a hit, a richer one, an unknown, a gold token without lemma."""
    f = "array<struct<k:string,v:string>>"
    p = rows(spark, [
        ("ат", "NOUN", [("Case", "Nom")], [("Ат", "NOUN", [("Case", "Nom")], "lexicon")]), ("ат", "NOUN", [("Case", "Nom")], [("ат", "NOUN", [("Case", "Nom"), ("Number", "Plur")], "lexicon")]),
        ("бір", "NUM", [], [("бір", "NUM", [], "unknown")]), ("_", "VERB", [("Mood", "Imp")], [("x", "NOUN", [], "lexicon")]),
    ], f"gold_lemma string, gold_upos string, gold_features {f}, candidates array<struct<lemma:string,upos:string,features:{f},source:string>>")
    return E.metric_set(p).select("lemma_correct", "lemma_total", "upos_correct", "upos_total", "features_correct", "features_total", "full_correct", "full_total", "gold_subset_correct", "candidate_subset_correct")


@expects("gold_tokens BIGINT, unaligned BIGINT, no_candidate BIGINT, single BIGINT, ambiguous_selected BIGINT, unresolved BIGINT, coverage_aligned DOUBLE, coverage_end_to_end DOUBLE", [(4, 1, 0, 1, 1, 1, 0.666667, 0.5)])
def selection_stats(spark, sf):
    """Every gold token in one bucket of selection."""
    return E.selection_stats(rows(spark, [(False, 0, None), (True, 1, None), (True, 3, 2), (True, 2, None)], "aligned boolean, n_candidates int, selected int"))


@expects("start INT, reason VARCHAR", [(5, "selected_raw_analysis_absent"), (9, "no_identical_lattice_span")])
def raw_containment(spark, sf):
    """Chosen readings that the lattice lacks."""
    c = rows(spark, [(1, 0, 2, "ат", "ат<n>"), (1, 5, 7, "ат", "ат<v>"), (1, 9, 11, "ол", "ол<prn>")], "doc_id long, start int, end int, text string, raw string")
    lat = rows(spark, [(1, 0, 2, "ат", ["ат<n>"]), (1, 5, 7, "ат", ["ат<n>"]), (1, 9, 12, "олл", ["x"])], "doc_id long, start int, end int, text string, raws array<string>")
    return E.containment(c, lat).select("start", "reason")


PAIRS = [("a", ["Мен", "келдім", "."], ["Мен", "келдім", "."]), ("b", ["It’s", "ok"], ["It's", "ok"]), ("c", ["ек", "і"], ["екі"]), ("d", ["x", "y"], ["z", "y"])]


def _pairs(spark):
    gold = [(s, i, i + 1, f) for s, g, _ in PAIRS for i, f in enumerate(g)]
    pred = [(s, i, f) for s, _, p in PAIRS for i, f in enumerate(p)]
    return rows(spark, gold, "sent_id string, ordinal int, tok_id int, form string"), rows(spark, pred, "sent_id string, tok_idx int, text string")


@expects("sent_id VARCHAR, ordinal INT, tok_idx INT, match_kind VARCHAR", [("a", 0, 0, "exact"), ("a", 1, 1, "exact"), ("a", 2, 2, "exact"), ("b", 0, 0, "normalized"), ("b", 1, 1, "exact")])
def align_offsets(spark, sf):
    """One-to-one pairs by equal key offsets."""
    return A.by_offsets(*_pairs(spark))


@expects("sent_id VARCHAR, op_idx INT, kind VARCHAR, gold_start INT, gold_size INT, pred_start INT, pred_size INT, match_kind VARCHAR", [
    ("a", 0, "match", 0, 1, 0, 1, "exact"), ("a", 1, "match", 1, 1, 1, 1, "exact"), ("a", 2, "match", 2, 1, 2, 1, "exact"), ("b", 0, "match", 0, 1, 0, 1, "normalized"), ("b", 1, "match", 1, 1, 1, 1, "exact"), ("c", 0, "match", 0, 2, 0, 1, "group"),
    ("d", 0, "skip_predicted", 0, 0, 0, 1, ""), ("d", 1, "skip_gold", 0, 1, 1, 0, ""), ("d", 2, "match", 1, 1, 1, 1, "exact"),
])
def align_dp(spark, sf):
    """The whole alignment with groups and skips."""
    return A.align(*_pairs(spark))


@expects("sentences BIGINT, gold_tokens BIGINT, predicted_tokens BIGINT, one_to_one_exact BIGINT, one_to_one_normalized BIGINT, grouped_operations BIGINT, grouped_gold_tokens BIGINT, grouped_predicted_tokens BIGINT, unaligned_gold_tokens BIGINT, unaligned_predicted_tokens BIGINT", [(4, 9, 8, 5, 1, 1, 2, 1, 1, 1)])
def align_counts(spark, sf):
    """Counters of an alignment."""
    return A.counts(A.align(*_pairs(spark)))


ARCS = [(0, 1, "а", "а"), (1, 2, "т", "т"), (2, 3, "", "<n>"), (2, 4, "т", "<n><pl>"), (4, 5, "а", ""), (5, 3, "р", ""), (2, 6, "", "<v><imp>")]
FINALS = [(3,), (6,)]
FST = "arcs(src, dst, isym, osym) AS (VALUES " + ", ".join(map(str, ARCS)) + "), finals(state) AS (VALUES (3), (6)), words(word) AS (VALUES ('ат'), ('аттар'), ('ар'))"


def _fst(spark):
    return rows(spark, ARCS, "src int, dst int, isym string, osym string"), rows(spark, FINALS, "state int"), rows(spark, [("ат",), ("аттар",), ("ар",)], "word string")


@expects("word VARCHAR, cand_idx INT, output VARCHAR, status VARCHAR", [("ат", 0, "ат<n>", "ok"), ("ат", 1, "ат<v><imp>", "ok"), ("аттар", 0, "ат<n><pl>", "ok"), ("ар", None, None, "ok")])
def fst_lookup(spark, sf):
    """Ordered outputs of a transducer."""
    arcs, finals, words = _fst(spark)
    return D.lookup(words, arcs, finals)


def fst_lookup_recursive(spark, sf):
    """The same relation as a recursive query."""
    arcs, finals, words = _fst(spark)
    return D.lookup_sql(spark, words, arcs, finals)


QUERIES["fst_lookup_recursive"] = fst_lookup_recursive
ORACLES["fst_lookup_recursive"] = D.LOOKUP_SQL.replace("WITH RECURSIVE", "WITH RECURSIVE " + FST + ",").format(string="VARCHAR")


@expects("state INT", [(1,), (2,)])
def fst_epsilon_cycle(spark, sf):
    """States on reachable input-epsilon cycles; an unreachable cycle and a consuming one do not count."""
    from textlattice.plans.session import shared_folder

    shared_folder(spark)
    return D.epsilon_cycles(rows(spark, [(0, 1, "a", "a"), (1, 2, "", "x"), (2, 1, "", "y"), (2, 3, "b", ""), (3, 2, "c", ""), (8, 9, "", ""), (9, 8, "", "")], "src int, dst int, isym string, osym string"))


@expects("surface VARCHAR, raw VARCHAR, side VARCHAR", [("ат", "ат<v>", "left"), ("ол", "ол<prn>", "right")])
def relation_diff(spark, sf):
    """Two relations' differences both ways."""
    a = rows(spark, [("ат", "ат<n>"), ("ат", "ат<v>")], "surface string, raw string")
    return D.difference(a, rows(spark, [("ат", "ат<n>"), ("ол", "ол<prn>")], "surface string, raw string"))


@expects("query_id INT, ord INT, surface VARCHAR", [(1, 0, "сәлем"), (2, 0, "сөз")])
def generate_forms(spark, sf):
    """Surfaces of a lemma with tags through the inverse relation; a malformed query has none."""
    q = rows(spark, [(1, "сәлем", ["ij"]), (2, "сөз", ["<n>", "<nom>"]), (3, "б<ад", ["n"]), (4, "жоқ", ["n"])], "query_id int, lemma string, tags array<string>")
    return L.generate(lexicon(spark), q)


@expects("i INT, text VARCHAR, readings VARCHAR", [(0, "outside/slash ", ""), (1, "x", "x<n>|x<ij>"), (2, " a^b", ""), (3, "?", "?<sent>"), (4, "^open", "")])
def stream_units(spark, sf):
    """Units and gaps of a backend stream."""
    d = rows(spark, [("outside/slash ^x/x<n>//x<ij>$ a\\^b^?/?<sent>$^open",)], "s string")
    return d.select(F.posexplode(tables.stream_units(F.col("s"))).alias("i", "u")).select("i", "u.text", F.array_join("u.readings", "|").alias("readings"))


FIX = ["# comment", "", "СӨЗ\tсөз\tn,nom", '{"form": "сөз", "lemma": "сөз", "tags": ["v"]}', "Сөз\tСөз\t<np><nom>", '{"form": "ал", "lemma": "ал"}', "broken line", '{"form": "x"}', '{"form": ']


@expects("form_key VARCHAR, ord INT, raw VARCHAR", [("сөз", 0, "сөз<n><nom>"), ("сөз", 1, "сөз<v>"), ("сөз", 2, "Сөз<np><nom>"), ("ал", 0, "ал<x>")])
def fixlist_source(spark, sf):
    """Fixlist lines in both notations."""
    return tables.fixlist(rows(spark, list(enumerate(FIX, 1)), "line_no int, line string"))[0]


@expects("line_no INT, message VARCHAR", [(7, "expected 3 columns"), (8, "missing lemma"), (9, "missing form")])
def fixlist_errors(spark, sf):
    """Fixlist lines that are rejected."""
    return tables.fixlist(rows(spark, list(enumerate(FIX, 1)), "line_no int, line string"))[1]


@expects("src INT, dst INT, isym VARCHAR, osym VARCHAR", [(0, 1, "а", "а"), (1, 2, "", "<n>"), (1, 2, " ", "x")])
def transducer_source(spark, sf):
    """Arcs of transducer text."""
    return tables.transducer(_att(spark))["arcs"]


@expects("line_no INT, message VARCHAR", [(5, "weight is not zero"), (6, "expected 1, 2, 4 or 5 columns"), (7, "malformed state")])
def transducer_errors(spark, sf):
    """Lines of transducer text that are rejected."""
    return tables.transducer(_att(spark))["errors"]


def _att(spark):
    lines = ["0\t1\tа\tа", "1\t2\t@0@\t<n>\t0.0", "1\t2\t@_SPACE_@\tx", "2", "2\t3\ta\tb\t1.5", "1\t2\t3", "x\t1\ta\tb"]
    return rows(spark, list(enumerate(lines, 1)), "line_no int, line string")


@expects("src INT, first BIGINT, n BIGINT", [(0, 0, 1), (1, 1, 1), (2, 2, 3), (4, 5, 1), (5, 6, 1)])
def csr_offsets(spark, sf):
    """Row offsets of sorted arcs."""
    return D.csr(_fst(spark)[0])


COMPOSE = [("A\u0438\u0306B", "A\u0439B", "0,1,3,4"), ("X\u1100\u1161\u11a8Y", "X\uac01Y", "0,1,4,5"), ("\u0438\u0306 \u0301", "\u0439 \u0301", "0,2,3,4"), ("plain", "plain", "0,1,2,3,4,5")]


@expects("text VARCHAR, nfc VARCHAR, boundaries VARCHAR", COMPOSE)
def nfc_boundaries(spark, sf):
    """Composition with the map of boundaries to the original."""
    d = rows(spark, [x[:1] for x in COMPOSE], "text string").withColumn("n", X.nfc_with_boundaries(F.col("text")))
    return d.select("text", "n.nfc", F.concat_ws(",", F.col("n.boundaries").cast("array<string>")).alias("boundaries"))


@expects("x VARCHAR, folded VARCHAR", [("СӨЗ", "сөз"), ("Straße", "strasse"), ("ΑΣ", "ασ"), ("ẞ", "ss")])
def casefold_keys(spark, sf):
    """Full case folds."""
    return rows(spark, [("СӨЗ",), ("Straße",), ("ΑΣ",), ("ẞ",)], "x string").withColumn("folded", X.casefold(F.col("x")))


@expects("start INT, n INT", [(0, 12), (12, 31), (43, 4)])
def line_chunks(spark, sf):
    """Lines packed to 16 characters; a longer line stays whole."""
    d = rows(spark, [("abcdefg\nabc\n" + "x" * 30 + "\nlast",)], "t string")
    return d.select(F.explode(X.line_chunks(F.col("t"), 16)).alias("c")).select("c.start", F.length("c.text").alias("n"))


@expects("path VARCHAR, problem VARCHAR", [("b", "sha256"), ("c", "missing"), ("d", "unexpected"), ("e", "size")])
def manifest_check(spark, sf):
    """Files against a manifest."""
    found = rows(spark, [("a", 1, "x"), ("b", 2, "y"), ("d", 3, "z"), ("e", 4, "w")], "path string, size long, sha256 string")
    return files.verify_manifest(found, rows(spark, [("a", 1, "x"), ("b", 2, "q"), ("c", 3, "z"), ("e", 5, "w")], "path string, size long, sha256 string"))


@expects("name VARCHAR, initial BIGINT, final BIGINT, during_run BIGINT", [("hits", 1, 5, 4), ("misses", 0, 2, 2), ("old", 3, 0, -3)])
def counter_deltas(spark, sf):
    """Counters before, after and during a run."""
    return E.counter_delta(rows(spark, [("hits", 1), ("old", 3)], "name string, v long"), rows(spark, [("hits", 5), ("misses", 2)], "name string, v long"))


@expects("run_id VARCHAR, status VARCHAR", [("a", "complete"), ("b", "incomplete"), ("c", "not_applicable")])
def run_completeness(spark, sf):
    """Whether a run hit no bound."""
    return E.completeness(rows(spark, [("a", 0, 0, 0, 0, 0, True), ("b", 0, 1, 0, 0, 0, True), ("b", 0, 0, 0, 0, 0, True), ("c", 0, 0, 0, 0, 0, False)], "run_id string, caps int, timeouts int, failures int, cycles int, unsafe int, applicable boolean"))


@expects("surface VARCHAR, has_readings BOOLEAN, missing VARCHAR, tracked_present VARCHAR", [("сәлем", True, "сәлем<v>", "сәлем<ij>"), ("жоқ", False, "жоқ<n>", "")])
def probe_gate(spark, sf):
    """Probes against a lexicon."""
    p = rows(spark, [("сәлем", ["сәлем<n><nom>", "сәлем<v>"], ["сәлем<ij>", "x"]), ("жоқ", ["жоқ<n>"], ["y"])], "surface string, expected array<string>, tracked array<string>")
    g = tables.probe_gate(p, lexicon(spark))
    return g.select("surface", "has_readings", F.array_join("missing", "|").alias("missing"), F.array_join("tracked_present", "|").alias("tracked_present"))


@expects("lexical_tokens BIGINT, dictionary BIGINT, fixlist BIGINT, guesser BIGINT, rule BIGINT, base_guess BIGINT, unknown BIGINT, zero BIGINT, candidates BIGINT, mean_candidates DOUBLE, max_candidates INT", [(7, 1, 1, 1, 1, 1, 1, 1, 7, 1.0, 2)])
def coverage_origins(spark, sf):
    """One lexical token in each bucket of origin."""
    r = lambda raw, source, guessed: R.parse(F.lit(raw), source, guessed)
    none = L.empty()
    sets = [F.array(r("a<n>", "lexicon", False), r("a<v>", "rule", False)), F.array(r("a<n>", "fixlist", False)), F.array(r("a<n>", "guesser", True)), F.array(r("a<n>", "rule", True)), F.array(r("a<n><unk>", "lexicon", False)), F.array(r("a<n>", "unknown", True)), none]
    d = spark.range(1).select(F.explode(F.array(*sets)).alias("readings")).withColumn("kind", F.lit("word"))
    return E.coverage(d)


from textlattice.operators import cohorts as K  # noqa: E402


@expects("text VARCHAR, cohorts VARCHAR, atoms VARCHAR", [
    ("екі  сөз.", "0-8,8-9", "0-3,3-5,5-8,8-9"), ("а-ә", "0-1,1-2,2-3", "0-3"), ("-а", "0-2", "0-1,1-2"), ("51%-дан", "0-7", "0-7"), ("51%-дан", "0-2,2-3,3-7", "0-2,2-3,3-7"), ("x—y", "0-3", "0-1,1-2,2-3"), ("", "", ""),
])
def atomic_intervals(spark, sf):
    """Consuming atoms from cohorts: white space, dashes and hyphens decide."""
    data = [("екі  сөз.", [0, 8, 8, 9]), ("а-ә", [0, 1, 1, 2, 2, 3]), ("-а", [0, 2]), ("51%-дан", [0, 7]), ("51%-дан", [0, 2, 2, 3, 3, 7]), ("x—y", [0, 3]), ("", [])]
    d = rows(spark, data, "text string, b array<int>")
    show = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws("-", p["start"].cast("string"), p["end"].cast("string"))), ",")
    pairs = F.filter(F.transform("b", lambda x, i: F.when(i % 2 == 0, F.concat_ws("-", x.cast("string"), F.get("b", i + 1).cast("string")))), lambda x: x.isNotNull())
    return d.select("text", F.array_join(pairs, ",").alias("cohorts"), show(K.atomic_intervals(K.characters(F.col("text")), F.col("b"))).alias("atoms"))


SEGS = "array<struct<text:string,readings:array<string>>>"


@expects("text VARCHAR, segments VARCHAR, error VARCHAR", [("қош!", "0-3,3-4", None), ("қош", "0-3", None), ("қош", "0-2", "input is not covered"), ("қош", "", "not aligned at 0")])
def segment_alignment(spark, sf):
    """Cohorts against the text; control data goes, gaps are errors."""
    d = rows(spark, [("қош!", [("қош", ["қош<n>"]), ("!", ["!<sent>"]), (".", [".<sent>"])]), ("қош", [("қош", [])]), ("қош", [("қо", [])]), ("қош", [("ош", [])])], f"text string, s {SEGS}")
    a = K.align_segments(F.col("text"), F.col("s"))
    return d.select("text", F.array_join(F.transform(a["segments"], lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("segments"), a["error"].alias("error"))


@expects("start INT, readings VARCHAR, sentence_end BOOLEAN, exact BOOLEAN, crossing BOOLEAN", [(0, "а<n>", False, True, False), (1, "", False, True, False), (2, "", True, False, False), (5, "", False, False, True)])
def cohort_readings(spark, sf):
    """Readings per atom; several cohorts leave only sentence ends; crossing is told."""
    d = spark.sql(f"""SELECT array(named_struct('start', 0, 'end', 1), named_struct('start', 1, 'end', 2), named_struct('start', 2, 'end', 5), named_struct('start', 5, 'end', 7)) AS i,
      CAST(array(named_struct('text', 'а', 'readings', array('а<n>'), 'start', 0, 'end', 1), named_struct('text', ' ', 'readings', array(), 'start', 1, 'end', 2), named_struct('text', 'б', 'readings', array('б<n>'), 'start', 2, 'end', 3),
      named_struct('text', '-.', 'readings', array('.<sent>'), 'start', 3, 'end', 5), named_struct('text', 'вгд', 'readings', array('x<n>'), 'start', 5, 'end', 8)) AS array<{K.SEGMENT}>) AS s""")
    out = d.select(F.explode(K.interval_readings(F.col("i"), F.col("s"))).alias("r"))
    return out.select("r.start", F.array_join("r.readings", "|").alias("readings"), "r.sentence_end", "r.exact", "r.crossing")


@expects("pieces VARCHAR, exact_before BOOLEAN, exact_after BOOLEAN", [("0-1:!|1-2: |2-4:сө", False, True)])
def plain_split(spark, sf):
    """Gaps cut at the ends of atoms."""
    d = spark.sql(f"""SELECT array(named_struct('start', 0, 'end', 1), named_struct('start', 1, 'end', 2), named_struct('start', 2, 'end', 4)) AS i,
      CAST(array(named_struct('text', '! ', 'readings', array(), 'start', 0, 'end', 2), named_struct('text', 'сө', 'readings', array('x'), 'start', 2, 'end', 4)) AS array<{K.SEGMENT}>) AS s""").withColumn("p", K.split_plain(F.col("i"), F.col("s")))
    show = F.array_join(F.transform("p", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit(":"), s["text"])), "|")
    return d.select(show.alias("pieces"), K.is_exact_partition(F.col("i"), F.col("s")).alias("exact_before"), K.is_exact_partition(F.col("i"), F.col("p")).alias("exact_after"))


@expects("k INT, selected INT", [(0, 0), (1, 1), (2, None), (3, None), (4, None)])
def span_selection(spark, sf):
    """A span's choice by the one genuine contextual reading."""
    d = rows(spark, [(0, ["a"], None), (1, ["a", "b"], ["b", "*x"]), (2, ["a", "b"], ["a", "b"]), (3, ["a", "a"], ["a"]), (4, ["a", "b"], None)], "k int, r array<string>, c array<string>")
    return d.select("k", K.select_span(F.col("r"), F.col("c")).alias("selected"))


@expects("text VARCHAR, inner_hyphens VARCHAR, fenced VARCHAR", [("йа-а", "2", "2"), ("а-а", "1", ""), ("№-а", "", "1"), ("сөз-ау", "3", ""), ("а-а-а", "1,3", "1,3"), ("-А!", "", "0"), ("x", "", "")])
def hyphen_fences(spark, sf):
    """Hyphens inside chains, and those before the lossy suffix."""
    d = rows(spark, [(x,) for x in ("йа-а", "а-а", "№-а", "сөз-ау", "а-а-а", "-А!", "x")], "text string").withColumn("c", K.characters(F.col("text")))
    show = lambda c: F.concat_ws(",", c.cast("array<string>"))
    return d.select("text", show(K.hyphen_indexes(F.col("c"))).alias("inner_hyphens"), show(K.fenced_hyphens(F.col("c"))).alias("fenced"))


@expects("tok_idx INT, text VARCHAR", [(0, "("), (1, "51%-дан"), (2, " "), (3, "51"), (4, "%"), (5, ")"), (6, " "), (7, "а-ә")])
def whole_run_tokens(spark, sf):
    """Runs that the lexicon licenses stay whole."""
    lex = rows(spark, [("51%-дан", 0, "x<num>"), ("а-ә", 0, "y<n>")], "surface string, cand_idx int, raw string")
    return K.whole_runs(rows(spark, [(1, "(51%-дан 51%) а-ә")], "doc_id long, text string"), lex).select("tok_idx", "text")


@expects("at INT, tok_idx INT", [(0, 0), (3, 1), (4, 2), (6, 3), (99, 3)])
def asof_tokens(spark, sf):
    """The token that starts last at or before a place."""
    t = X.explode_tokens(rows(spark, [(1, "сөз, бар")], "doc_id long, text string"))
    return K.last_start(t, rows(spark, [(1, 0), (1, 3), (1, 4), (1, 6), (1, 99)], "doc_id long, at int")).select("at", "tok_idx")


@expects("surface VARCHAR, upos VARCHAR, raw VARCHAR, kind VARCHAR", [("*", "PUNCT", "\\*<punct>", "punct"), ("+", "SYM", "\\+<sym>", "symbol"), ("=", "SYM", "=<sym>", "symbol")])
def protected_characters(spark, sf):
    """Reserved single characters read as themselves."""
    r = L.surface_readings(rows(spark, [("*",), ("+",), ("=",)], "surface string"), rows(spark, [], "surface string, cand_idx int, raw string"))
    return r.select("surface", F.col("readings")[0]["upos"].alias("upos"), F.col("readings")[0]["raw"].alias("raw"), "kind")


@expects("gold_tokens BIGINT, gold_types BIGINT, compiled BIGINT, fixlist BIGINT, effective BIGINT, oov BIGINT, oov_types BIGINT, oov_with_guess BIGINT, unknown_placeholders BIGINT, max_candidates INT", [(5, 4, 1, 1, 2, 3, 2, 1, 1, 1)])
def gold_coverage(spark, sf):
    """Coverage of gold words by source."""
    r = lambda source, guessed: F.array(R.parse(F.lit("a<n>"), source, guessed))
    rows_ = [("a", r("lexicon", False)), ("b", r("fixlist", False)), ("c", r("guesser", True)), ("c", r("guesser", True)), ("d", r("unknown", True))]
    d = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.lit("NOUN").alias("gold_upos"), v.alias("readings")) for k, v in rows_])))
    return E.gold_coverage(d).select("gold_tokens", "gold_types", "compiled", "fixlist", "effective", "oov", "oov_types", "oov_with_guess", "unknown_placeholders", "max_candidates")


@expects("lexical_tokens BIGINT, predicted BIGINT, ambiguous BIGINT, resolved BIGINT, abstained BIGINT, resolution_rate DOUBLE", [(3, 2, 2, 1, 1, 0.5)])
def neural_resolution(spark, sf):
    """What re-ranking resolved."""
    return E.neural_resolution(rows(spark, [("word", 2, True, 1), ("word", 3, False, None), ("number", 1, True, 0), ("space", 0, False, None)], "kind string, n_candidates int, predicted boolean, selected int"))


@expects("run_id VARCHAR, differs VARCHAR", [("b", "tokens"), ("c", "tokens,provenance")])
def worker_consistency(spark, sf):
    """Runs whose workers do not agree."""
    d = rows(spark, [("a", 1, "x"), ("a", 1, "x"), ("b", 1, "x"), ("b", 2, "x"), ("c", 1, "x"), ("c", 2, "y")], "run_id string, tokens int, provenance string")
    return E.consistency(d).select("run_id", F.array_join("differs", ",").alias("differs"))


@expects("surface VARCHAR", [("b",), ("c",)])
def ledger_difference(spark, sf):
    """Surfaces whose ordered candidates differ."""
    a = rows(spark, [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x"), ("b", 1, "y")], "surface string, cand_idx int, raw string")
    b = rows(spark, [("a", 1, "y"), ("a", 0, "x"), ("b", 0, "y"), ("b", 1, "x"), ("c", 0, "z")], "surface string, cand_idx int, raw string")
    return E.ledger_difference(a, b).select("surface")


@expects("max_mib DOUBLE, mean_mib DOUBLE", [(30.0, 20.0)])
def memory_summary(spark, sf):
    """Memory samples."""
    return E.memory(rows(spark, [(10.0,), (20.0,), (30.0,)], "rss_mib double"))


@expects("run INT, text VARCHAR", [(1, "a\nb"), (2, "a\nb")])
def workload_text(spark, sf):
    """A joined, repeated, cut workload."""
    return files.workload(rows(spark, [(2, "bcd"), (1, "a"), (3, "")], "i int, text string"), spark, repeat=2, max_chars=3, order="i")


@expects("shape VARCHAR, direction VARCHAR, evidence VARCHAR, count BIGINT", [("2:1", "merge", "analyzer_multiword_fusion", 1), ("2:1", "merge", "ud_multiword_token_surface", 1), ("1:2", "split", "analyzer_punctuation_split", 1)])
def group_evidence(spark, sf):
    """What explains grouped alignments."""
    ops = rows(spark, [("a", 0, "match", 0, 2, 0, 1, "group"), ("b", 0, "match", 0, 2, 0, 1, "group"), ("c", 0, "match", 0, 1, 0, 2, "group")], A.OPS)
    return E.group_evidence(ops, rows(spark, [("b", 0, 2)], "sent_id string, gold_start int, gold_end int"), rows(spark, [("c", 1, "punct")], "sent_id string, tok_idx int, kind string"))
