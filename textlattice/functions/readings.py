"""Column functions on readings: the parser, fallbacks, identity, visibility, choice."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from textlattice.functions import tags as T
from textlattice.functions import text as X
from textlattice.schemas import FEATURES, READING, check_profile

TAGS = r"<([^<>]+)>"


def parse(raw: Column, source: Column | str = "lexicon", guessed: Column | bool = False, score: Column | None = None, profile: str = "universal") -> Column:
    """A reading from a raw analysis ``lemma<tag>...+lemma<tag>...``; null for empty and failed ones."""
    check_profile(profile)
    source = F.lit(source) if isinstance(source, str) else source
    guessed = F.lit(guessed) if isinstance(guessed, bool) else guessed

    def morpheme(part: Column) -> Column:
        tags = F.regexp_extract_all(part, F.lit(TAGS), F.lit(1))
        lemma = X.unescape(F.regexp_extract(part, r"^((?:\\.|[^<\\])*)", 1))
        return T.let(tags, lambda t: F.struct(lemma.alias("lemma"), t.alias("tags"), T.upos(t).alias("upos"), T.features(t, profile).alias("features")))

    def whole(parts: Column) -> Column:
        main = F.try_element_at(F.filter(parts, lambda m: (m["lemma"] != "") | (F.size(m["tags"]) > 0)), F.lit(1))
        lemma = F.coalesce(F.try_element_at(F.filter(parts, lambda m: m["lemma"] != ""), F.lit(1))["lemma"], raw)
        none = F.array().cast(FEATURES)
        all_tags = F.flatten(F.transform(parts, lambda m: m["tags"]))
        return F.struct(
            lemma.alias("lemma"), F.coalesce(main["upos"], F.lit("X")).alias("upos"), F.coalesce(main["features"], none).alias("features"), all_tags.alias("tags"), parts.alias("morphemes"),
            raw.alias("raw"), source.alias("source"), (F.lit(None).cast("double") if score is None else score).alias("score"),
            (guessed | F.array_contains(all_tags, "unk")).alias("guessed"), F.array_contains(all_tags, "err_orth").alias("orthographic_variant"),
            F.lit(None).cast("string").alias("context_upos"), none.alias("context_features"),
        )

    value = T.let(F.transform(X.split_unescaped(raw, "+"), morpheme), whole)
    bad = (raw == "") | raw.startswith("*") | raw.endswith("+?")
    return F.when(~bad, value.cast(READING))


def simple(lemma: Column, upos: str, tags: list[str], raw: Column, source: str, guessed: bool, feats: dict[str, str] | None = None) -> Column:
    """A one-morpheme reading."""
    f = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in sorted((feats or {}).items())]).cast(FEATURES)
    t = F.array(*map(F.lit, tags))
    part = F.struct(lemma.alias("lemma"), t.alias("tags"), F.lit(upos).alias("upos"), f.alias("features"))
    return F.struct(
        lemma.alias("lemma"), F.lit(upos).alias("upos"), f.alias("features"), t.alias("tags"), F.array(part).alias("morphemes"), raw.alias("raw"), F.lit(source).alias("source"),
        F.lit(None).cast("double").alias("score"), F.lit(guessed).alias("guessed"), F.lit(False).alias("orthographic_variant"), F.lit(None).cast("string").alias("context_upos"),
        F.array().cast(FEATURES).alias("context_features"),
    ).cast(READING)


def unknown(surface: Column) -> Column:
    folded = X.casefold(surface)
    return simple(folded, "X", ["unknown"], F.concat(folded, F.lit("<unknown>")), "unknown", True)


def number(surface: Column) -> Column:
    return simple(surface, "NUM", ["num"], F.concat(surface, F.lit("<num>")), "rule", True, {"NumType": "Card"})


def protected(surface: Column) -> Column:
    """Reading of a reserved character: punctuation or symbol by its category."""
    raw = X.escape_reserved(surface)
    return F.when(surface.rlike(r"^\p{P}$"), simple(surface, "PUNCT", ["punct"], F.concat(raw, F.lit("<punct>")), "rule", True)).otherwise(
        simple(surface, "SYM", ["sym"], F.concat(raw, F.lit("<sym>")), "rule", True)
    )


def identity(r: Column) -> Column:
    return F.struct(X.casefold(r["lemma"]).alias("lemma"), r["upos"].alias("upos"), r["features"].alias("features"), r["raw"].alias("raw"))


def distinct(readings: Column) -> Column:
    """Without later readings of an earlier one's identity."""
    return T.let(readings, lambda rs: T.let(F.transform(rs, identity), lambda keys: F.filter(rs, lambda r, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def aliases(readings: Column, surface: Column, profile: str = "universal") -> Column:
    """Readings that usage tags or a bare decimal surface license, to go after all originals."""
    decimal = surface.rlike(r"^\p{Nd}+$")

    def views(r: Column) -> Column:
        own = F.when(~r["guessed"] & (r["source"] == "lexicon"), T.alternatives(r["morphemes"][0]["tags"], decimal, profile))
        head = lambda a: r["morphemes"][0].withField("upos", a["upos"]).withField("features", a["features"])
        rest = F.slice(r["morphemes"], F.lit(2), F.size(r["morphemes"]))
        made = F.transform(
            own,
            lambda a: r.withField("upos", a["upos"]).withField("features", a["features"]).withField("morphemes", F.concat(F.array(head(a)), rest))
            .withField("source", F.lit("rule")).withField("score", F.lit(None).cast("double")),
        )
        return F.coalesce(made, F.array().cast(f"array<{READING}>"))

    return F.flatten(F.transform(readings, views))


def visible(readings: Column, filters: tuple[str, ...] = (), dictionary_only: bool = False) -> Column:
    """Readings whose tags, features (k=v) and UPOS, lexical or contextual, have all of ``filters``."""

    def seen(r: Column) -> Column:
        ok = ~r["guessed"] if dictionary_only else F.lit(True)
        if filters:
            said = lambda f: F.transform(f, lambda p: F.concat(p["k"], F.lit("="), p["v"]))
            there = F.concat(r["tags"], said(r["features"]), said(r["context_features"]), F.array(r["upos"], r["context_upos"]))
            ok = ok & (F.size(F.array_except(F.array(*map(F.lit, filters)), there)) == 0)
        return ok

    return F.filter(readings, seen)


def chosen(readings: Column, selected: Column) -> Column:
    """The selected reading if the index is in range, else the only one, else null."""
    return F.when((selected >= 0) & (selected < F.size(readings)), F.get(readings, selected)).when(F.size(readings) == 1, F.get(readings, F.lit(0)))


def is_dictionary_word(readings: Column) -> Column:
    return F.exists(readings, lambda r: ~r["guessed"])


def grammar(r: Column) -> Column:
    feats = F.when(F.size(r["context_features"]) > 0, r["context_features"]).otherwise(r["features"])
    return F.concat(F.coalesce(r["context_upos"], r["upos"]), F.when(F.size(feats) > 0, F.concat(F.lit(","), T.feature_text(feats, ","))).otherwise(""))


def lexical_form(lemma: Column, tags: Column) -> Column:
    """The query of generation: escaped lemma and tags in angle brackets; null if either is malformed."""
    cleaned = F.transform(tags, lambda t: F.regexp_replace(t, r'^[" <>]+|[" <>]+$', ""))
    ok = (lemma != "") & ~lemma.rlike("[<>\r\n]") & F.forall(cleaned, lambda t: t.rlike("^[A-Za-z0-9_:-]+$"))
    escaped = F.replace(F.replace(lemma, F.lit("\\"), F.lit("\\\\")), F.lit("+"), F.lit("\\+"))
    return F.when(ok, F.concat(escaped, F.array_join(F.transform(cleaned, lambda t: F.concat(F.lit("<"), t, F.lit(">"))), "")))


@lru_cache(maxsize=64)
def _built(gateway, what: str, columns: tuple[str, ...], options: tuple) -> Column:
    return {"parse": parse, "aliases": aliases, "unknown": unknown, "number": number, "protected": protected}[what](*map(F.col, columns), **dict(options))


def of(what: str, *columns: str, **options) -> Column:
    """``parse``, ``aliases``, ``unknown``, ``number`` or ``protected`` of named columns, built once: large expressions take seconds to put together."""
    return _built(SparkContext._gateway, what, columns, tuple(sorted(options.items())))
