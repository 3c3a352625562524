"""Fixed schemas of documents, tokens, readings, spans, gold and transducers, as DDL."""

VERSION = "textlattice.record.v1"
FEATURES = "array<struct<k: string, v: string>>"
MORPHEME = f"struct<lemma: string, tags: array<string>, upos: string, features: {FEATURES}>"
READING = (
    f"struct<lemma: string, upos: string, features: {FEATURES}, tags: array<string>, morphemes: array<{MORPHEME}>, raw: string, source: string, score: double, "
    f"guessed: boolean, orthographic_variant: boolean, context_upos: string, context_features: {FEATURES}>"
)
READINGS = f"array<{READING}>"
TOKEN = f"struct<tok_idx: int, text: string, start: int, end: int, kind: string, sentence_end: boolean, normalized: string, selected: int, readings: {READINGS}>"
SPAN = f"struct<span_idx: int, text: string, start: int, end: int, token_start: int, token_end: int, sentence_end: boolean, normalized: string, selected: int, readings: {READINGS}>"
LEXICON = "surface string, cand_idx int, raw string"
FIXLIST = "form_key string, ord int, raw string"
PREDICTIONS = f"doc_id long, start int, end int, ord int, text string, lemma string, upos string, features {FEATURES}"
ARCS = "src int, dst int, isym string, osym string"
GOLD = f"sent_id string, ordinal int, tok_id int, form string, lemma string, upos string, features {FEATURES}, misc {FEATURES}"
KINDS = ("space", "word", "number", "punct", "symbol")
PROFILES = ("universal", "ktb")


def check_profile(profile: str) -> str:
    if profile not in PROFILES:
        raise ValueError(f"unknown UD projection profile: {profile}")
    return profile
