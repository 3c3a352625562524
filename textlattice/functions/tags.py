"""From analyzer tags to Universal Dependencies: tables, and the expressions over them.

Tables are (tag, value) pairs that must agree with published correspondences; the first or last
tag of a reading that a table has decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlattice.schemas import check_profile

# Fixed values.
UPOS = (
    "n NOUN", "np PROPN", "adj ADJ", "adv ADV", "v VERB", "vaux AUX", "cop AUX", "prn PRON", "det DET", "num NUM", "post ADP", "postadv ADV",
    "cnjcoo CCONJ", "cnjsub SCONJ", "cnjadv SCONJ", "ij INTJ", "ideo X", "paren X", "qst PART", "mod PART", "mod_ass PART", "mod_emo PART",
    "emph PART", "sent PUNCT", "cm PUNCT", "apos PUNCT", "lquot PUNCT", "rquot PUNCT", "lpar PUNCT", "rpar PUNCT", "guio PUNCT", "punct PUNCT",
    "ltr SYM", "sym SYM", "abbr NOUN",
)
PRIMARY_CASE = ("nom Nom", "gen Gen", "dat Dat", "acc Acc", "loc Loc", "abl Abl", "ins Ins")
SECONDARY_CASE = ("abe Abe", "equ Equ", "sim Equ", "reas Cau")
VERB_FORM = (
    "ger Ger", "ger2 Ger", "ger_abs Ger", "ger_fut Ger", "ger_impf Ger", "ger_obs Ger", "ger_past Ger", "ger_perf Ger", "ger_ppot Ger",
    "gpr_fut Part", "gpr_impf Part", "gpr_past Part", "gpr_pot Part", "gpr_pot2 Part", "gpr_ppot Part",
    "gna_after Conv", "gna_cond Conv", "gna_impf Conv", "gna_perf Conv", "gna_until Conv",
    "prc_cond Inf", "prc_fplan Inf", "prc_impf Inf", "prc_irre Inf", "prc_perf Inf", "prc_plan Inf", "prc_vol Inf",
)
FINITE = ("imp", "opt", "pres", "aor", "past", "ifi", "ifi_evid", "fut", "fut_plan", "pih")
MOOD = ("imp Imp", "opt Opt", "prc_cond Cnd", "gna_cond Cnd", "prc_vol Des", "prc_fplan Des", "fut_plan Des", "prc_plan Prp", "gpr_pot Pot", "gpr_pot2 Pot", "gpr_ppot Pot", "ger_ppot Pot")
TENSE = (
    "past Past", "ifi Past", "ifi_evid Past", "pih Past", "gpr_past Past", "gpr_ppot Past", "ger_past Past", "ger_ppot Past", "pres Pres", "aor Pres",
    "fut Fut", "fut_plan Fut", "prc_fplan Fut", "gpr_fut Fut", "ger_fut Fut", "ger_obs Fut",
)
ASPECT = ("aor Hab", "pih Imp", "prc_impf Imp", "gna_impf Imp", "gpr_impf Imp", "ger_impf Imp", "prc_perf Perf", "gna_perf Perf", "ger_perf Perf")
PRON_TYPE = ("pers Prs", "recip Rcp", "itg Int", "qnt Tot", "ind Ind", "ref Prs")
NAME_TYPE = ("top Geo", "ant Giv", "cog Sur", "pat Pat", "org Com", "al Oth")
KTB_LEAVES_OUT = ("Abbr", "NameType", "PartType")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _table(pairs: tuple[str, ...]) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs for x in p.split(" ")])


def _mapped(tags: Column, pairs: tuple[str, ...], place: int) -> Column:
    table = _table(pairs)
    known = F.filter(F.transform(tags, lambda t: F.try_element_at(table, t)), lambda v: v.isNotNull())
    return F.try_element_at(known, F.lit(place))


def first_of(tags: Column, pairs: tuple[str, ...]) -> Column:
    return _mapped(tags, pairs, 1)


def last_of(tags: Column, pairs: tuple[str, ...]) -> Column:
    return _mapped(tags, pairs, -1)


def upos(tags: Column) -> Column:
    return F.coalesce(first_of(tags, UPOS), F.lit("X"))


def features(tags: Column, profile: str = "universal") -> Column:
    """Array of (k, v) sorted by key."""
    ktb = check_profile(profile) == "ktb"
    return let(tags, lambda t: let(upos(t), lambda pos: _features(t, pos, ktb)))


def _features(tags: Column, pos: Column, ktb: bool) -> Column:
    has = lambda *names: F.arrays_overlap(tags, F.array(*map(F.lit, names)))
    is_ = lambda *names: pos.isin(*names)
    case = F.coalesce(last_of(tags, PRIMARY_CASE), last_of(tags, SECONDARY_CASE), F.when(has("attr"), "Nom"))
    form = first_of(tags, VERB_FORM)
    finite = form.isNull() & is_("VERB", "AUX") & has(*FINITE)
    voices = F.array_compact(F.array(
        F.when(has("caus"), "Cau"), F.when(has("pass"), "Pass"), F.when(has("coop") | has("recip") & is_("VERB"), "Rcp"), F.when(has("ref") & is_("VERB"), "Rfl"),
    ))
    possessor = F.try_element_at(F.filter(tags, lambda t: t.startswith("px") & (F.length(t) >= 4)), F.lit(1))
    person = F.try_element_at(F.filter(tags, lambda t: t.isin("p1", "p2", "p3")), F.lit(1))
    pron = F.when(has("dem"), "Dem").when(is_("PRON", "DET", "ADV") & first_of(tags, PRON_TYPE).isNotNull(), first_of(tags, PRON_TYPE)).when(has("neg") & is_("PRON", "DET"), "Neg")
    values = {
        "Case": case,
        "VerbForm": F.coalesce(form, F.when(finite, "Fin")),
        "Mood": F.coalesce(first_of(tags, MOOD), F.when(finite, "Ind")),
        "Tense": first_of(tags, TENSE),
        "Aspect": first_of(tags, ASPECT),
        "Polarity": F.when(has("neg") & is_("VERB", "AUX"), "Neg"),
        "Degree": F.when(has("comp"), "Cmp"),
        "Voice": F.when(F.size(voices) > 0, F.array_join(voices, ",")),
        "Evident": F.when(has("evid", "ifi_evid"), "Fh" if ktb else "Nfh"),
        "Polite": F.when(has("frm"), "Form"),
        "Person": F.substring(person, 2, 1),
        "Number": F.when(has("pl") & is_("VERB", "AUX", "PRON", "NOUN", "PROPN", "ADJ"), "Plur").when(has("sg") & is_("VERB", "AUX", "PRON"), "Sing"),
        "Person[psor]": F.when(F.substring(possessor, 3, 1).isin("1", "2", "3"), F.substring(possessor, 3, 1)),
        "Number[psor]": F.when(possessor.endswith("pl"), "Plur").when(possessor.endswith("sg"), "Sing").when(possessor.endswith("sp"), "Plur,Sing"),
        "PronType": pron,
        "Reflex": F.when(has("ref") & is_("PRON", "DET"), "Yes"),
        "NumType": F.when(has("ord"), "Ord").when(has("coll"), "Coll" if ktb else "Sets").when(has("dist"), "Dist").when(is_("NUM"), "Card"),
        "NameType": first_of(tags, NAME_TYPE),
        "Gender": F.when(is_("PROPN") & has("m"), "Masc").when(is_("PROPN") & has("f"), "Fem"),
        "Abbr": F.when(has("abbr"), "Yes"),
        "PartType": F.when(has("qst"), "Int").when(has("emph"), "Emp").when(has("mod", "mod_ass", "mod_emo"), "Mod"),
        "Foreign": F.when(has("unk"), "Yes"),
        "Typo": F.when(has("err_orth"), "Yes"),
    }
    if ktb:
        values = {k: v for k, v in values.items() if k not in KTB_LEAVES_OUT}
        values["Case"] = F.when(case != "Equ", case)
    pairs = [F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in sorted(values.items())]
    return F.filter(F.array(*pairs), lambda p: p["v"].isNotNull())


def with_value(feats: Column, key: str, value: str) -> Column:
    """Features with one key set, still sorted."""
    rest = F.filter(feats, lambda p: p["k"] != key)
    return F.sort_array(F.concat(rest, F.array(F.struct(F.lit(key).alias("k"), F.lit(value).alias("v")))))


def alternatives(tags: Column, bare_decimal: Column, profile: str = "universal") -> Column:
    """Further (upos, features) views that explicit usage tags or a bare decimal license, in order."""
    ktb = check_profile(profile) == "ktb"
    return let(tags, lambda t: let(F.struct(upos(t).alias("upos"), features(t, profile).alias("features")), lambda own: _alternatives(t, own["upos"], own["features"], bare_decimal, ktb)))


def _alternatives(tags: Column, pos: Column, feats: Column, bare_decimal: Column, ktb: bool) -> Column:
    has = lambda *names: F.arrays_overlap(tags, F.array(*map(F.lit, names)))
    view = lambda u, f: F.struct(u.alias("upos"), f.alias("features"))
    number = bare_decimal & (pos == "NUM") & has("num") & ~has("ord", "coll", "dist")
    found = [F.when(number, view(pos, with_value(feats, "NumType", "Ord")))]
    if ktb:
        found.append(F.when(number, view(pos, with_value(feats, "NumType", "Card,Ord"))))
    found += [F.when((pos == a) & has(t), view(F.lit(b), feats)) for a, t, b in (("ADJ", "subst", "NOUN"), ("NOUN", "attr", "ADJ"), ("ADJ", "advl", "ADV"))]
    return F.array_distinct(F.array_compact(F.array(*found)))


def project(df: DataFrame, tags_col: str = "tags", profile: str = "universal") -> DataFrame:
    """Adds ``upos, features``, computed once for each distinct tag tuple (far fewer than readings) and joined back."""
    kinds = df.select(tags_col).distinct()
    kinds = kinds.select(tags_col, upos(F.col(tags_col)).alias("upos"), features(F.col(tags_col), profile).alias("features"))
    return df.join(kinds, tags_col, "left")


def feature_text(feats: Column, between: str = "|") -> Column:
    return F.array_join(F.transform(feats, lambda p: F.concat(p["k"], F.lit("="), p["v"])), between)
