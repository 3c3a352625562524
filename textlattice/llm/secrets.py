"""Secret scans: stated patterns, and character Markov models of random strings and identifiers.

The strings that the patterns find are labelled random, other long strings ordinary.  Each label
has a first-order Markov model of characters; a string outside the patterns' matches is taken for
a secret if the logarithm of the ratio of its likelihoods exceeds the prior odds.  All work is
expressions and joins; the models have a row for each pair of characters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW, id_key, scratch, stored

#: The kinds in their order, their patterns (the last group is the secret) and the least length of it.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{16,})"  # of 20 or more characters; a run has one match at most, from its first AKIA
HEX = r"([0-9a-f]{24,})"
KINDS = (("assign", ASSIGN, 6), ("access", ACCESS, 20), ("hex", HEX, 24))
#: Kind of the spans that the models add.
LEARNT = "random"
#: Characters of the strings that the models judge, as a class and their number; the models fold case, as prose may be shouted.
CLASS, LETTERS = "[A-Za-z0-9+/_=-]", 41
#: Shortest string that the models judge.
SHORTEST = 12
#: Taken from the count of each pair and given to the characters' own frequencies, whose counts get SMOOTH more:
#: pairs seen once say nothing of their label, so unlabelled secrets don't teach the ordinary model themselves.
DISCOUNT, SMOOTH = 1, 0.5
#: Rounds in which strings that the models take for random no longer train the ordinary one.
ROUNDS = 2
#: Codes of characters are below this; 0 stands for the start.
CODES = 128


def _pieces(text: Column, pattern: str) -> Column:
    """Array of gap (code points), hit (whole match) and value (its last group), left to right; the last has no hit."""
    whole = F.lit(f"((?s:.*?))(?:({pattern})|\\z)")
    gaps, hits, values = (F.regexp_extract_all(text, whole, F.lit(i)) for i in (1, 2, 3))
    return F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))


def _measured(pieces: Column, least: int) -> Column:
    """Lengths in place of strings; the value stays where it is long enough, else it is null."""
    return F.transform(pieces, lambda z: F.struct(
        F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("size"), F.when(F.length(z["value"]) >= least, z["value"]).alias("value")
    ))


def _blanked(text: Column, pattern: str, least: int) -> Column:
    """The text with blanks, as many as there were characters, for each match that counts."""
    blank = lambda z: F.when(F.length(z["value"]) >= least, F.repeat(F.lit(" "), F.length(z["hit"]))).otherwise(z["hit"])
    return F.when(text.rlike(pattern), F.array_join(F.transform(_pieces(text, pattern), lambda z: F.concat(z["gap"], blank(z))), "")).otherwise(text)


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of every row its id, keys, and the pieces of each kind (null without a match); ``k3`` has the strings to judge."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), id_key(docs, id_col).alias("key"), F.xxhash64(text).alias("tag"), text.alias("text"))
    bare = F.col("text")
    for _, pattern, least in reversed(KINDS):
        bare = _blanked(bare, pattern, least)
    read = read.select("*", F.when(F.col("text").rlike("|".join(p for _, p, _ in KINDS)), bare).otherwise(F.col("text")).alias("bare"))
    judged = f"({CLASS}{{{SHORTEST},}})"
    kinds = [*((F.col("text"), p, least) for _, p, least in KINDS), (F.col("bare"), judged, SHORTEST)]
    return read.select("id", "key", "tag", *(F.when(t.rlike(p), _measured(_pieces(t, p), least)).alias(f"k{i}") for i, (t, p, least) in enumerate(kinds)))


def labelled(found: DataFrame) -> DataFrame:
    """``(value, secret)``: every distinct string with 1 if a pattern found it anywhere, else 0."""
    def valued(i: int) -> Column:
        return F.transform(F.coalesce(F.col(f"k{i}"), F.array()), lambda z: F.struct(z["value"].alias("value"), F.lit(int(i < len(KINDS))).alias("secret")))

    values = F.concat(*map(valued, range(len(KINDS) + 1)))
    return found.select(F.inline(values)).filter(F.col("value").isNotNull()).groupBy("value").agg(F.max("secret").alias("secret"))


def transitions(samples: DataFrame) -> DataFrame:
    """``(secret, a, b, n)``: how often code ``b`` follows code ``a`` in the values of each label; 0 is the start."""
    codes = F.transform(F.split(F.lower("value"), ""), lambda c: F.least(F.ascii(c), F.lit(CODES - 1)))
    marked = samples.select("secret", codes.alias("codes"))
    pairs = F.arrays_zip(F.concat(F.array(F.lit(0)), F.col("codes")).alias("a"), F.col("codes").alias("b"))
    return marked.select("secret", F.inline(pairs)).filter("b is not null").groupBy("secret", "a", "b").agg(F.count("*").alias("n"))


class Ratio:
    """Logarithms of the ratio of the two models' probabilities, from counts of ``transitions``."""

    def __init__(self, counts: DataFrame):
        n, after, alone, kinds = ([{}, {}] for _ in range(4))
        # A row for each pair of characters and label: at most 2 * CODES ** 2, whatever the corpus.
        for secret, a, b, times in counts.select("secret", "a", "b", "n").collect():
            n[secret][a, b] = times
            after[secret][a] = after[secret].get(a, 0) + times
            alone[secret][b] = alone[secret].get(b, 0) + times
            kinds[secret][a] = kinds[secret].get(a, 0) + 1
        self.strings = [after[s].get(0, 0) for s in (0, 1)]
        every = [sum(alone[s].values()) + SMOOTH * LETTERS for s in (0, 1)]

        def log(s: int, a: int, b: int) -> float:
            own = (alone[s].get(b, 0) + SMOOTH) / every[s]
            if a not in after[s]:
                return math.log(own)
            return math.log((max(n[s].get((a, b), 0) - DISCOUNT, 0) + DISCOUNT * kinds[s][a] * own) / after[s][a])

        self.weights = [log(1, a, b) - log(0, a, b) for a in range(CODES) for b in range(CODES)]

    @property
    def odds(self) -> float | None:
        """Logarithm of ordinary strings for each random one; None while a label has no strings."""
        return math.log(self.strings[0] / self.strings[1]) if min(self.strings) else None

    def score(self, value: Column) -> Column:
        """The ratio of a string, in one walk over its characters."""
        table = F.split(F.lit(",".join(map(repr, self.weights))), ",").cast("array<double>")
        start = F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("sum"))

        def step(x: Column, c: Column) -> Column:
            code = F.least(F.ascii(c), F.lit(CODES - 1))
            return F.struct(code.alias("a"), (x["sum"] + F.get(table, x["a"] * CODES + code)).alias("sum"))

        return F.aggregate(F.split(F.lower(value), ""), start, step, lambda x: x["sum"])


def fitted(samples: DataFrame) -> Ratio:
    """The models of labelled strings, without the ordinary ones that look random: among what no
    pattern finds are secrets too."""
    ratio = Ratio(transitions(samples))
    for _ in range(ROUNDS):
        if ratio.odds is None:
            break
        ratio = Ratio(transitions(samples.filter((F.col("secret") == 1) | (ratio.score(F.col("value")) <= ratio.odds))))
    return ratio


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: DataFrame | None = None, margin: float | None = None) -> DataFrame:
    """``id_col``, ``text_hash`` and ``spans`` (array of start, kind number, kind, end and score, in that order) of every row.

    Kinds are KINDS and LEARNT.  A span is a whole match, in code points, its end exclusive;
    matches of a kind are the leftmost that don't overlap, and those whose secret is too short are
    dropped.  LEARNT spans are strings of CLASS of SHORTEST characters or more outside the matches
    (where matches overlap in part, outside those found in the order of KINDS from the last)
    whose score exceeds ``margin``, the log of the prior odds by default.  The models learn from
    ``samples(value, secret)``, by default from every distinct such string of ``docs``; without
    strings of both labels nothing is added.

    A null text is empty; an empty text has no spans; texts are read whole at any length; ids of
    any type, nulls too, are carried; rows that repeat get the same spans each (of rows with equal
    ids and texts one is placed); other columns are not read, whatever their names; an empty table
    gives none.
    """
    folder = scratch(docs.sparkSession)
    found = stored(_found(docs, id_col, text_col), folder, "found")
    if samples is None:
        samples = stored(labelled(found), folder, "samples")
    ratio = fitted(samples.select("value", F.col("secret").cast("int").alias("secret")))
    limit = ratio.odds if margin is None else margin
    if ratio.odds is None:
        scored = F.lit(None).cast("array<struct<gap:int,size:int,value:string,score:double>>")
    else:
        scored = F.transform("k3", lambda z: F.struct(z["gap"].alias("gap"), z["size"].alias("size"), z["value"].alias("value"), ratio.score(z["value"]).alias("score")))
        scored = F.when(F.exists(scored, lambda z: z["score"] > limit), scored)

    def part(i: int) -> Column:
        """The pieces of a kind, numbered, with whether they count."""
        learnt = i == len(KINDS)

        def one(z: Column, j: Column) -> Column:
            ok = z["value"].isNotNull() & (z["score"] > limit) if learnt else z["value"].isNotNull()
            score = z["score"] if learnt else F.lit(None).cast("double")
            return F.struct(F.lit(i).alias("kind"), j.alias("j"), z["gap"].alias("gap"), z["size"].alias("size"), ok.alias("ok"), score.alias("score"))

        return F.transform(F.coalesce(F.col("scored" if learnt else f"k{i}"), F.array()), one)

    some = found.select("key", "tag", "k0", "k1", "k2", scored.alias("scored")).filter("k0 is not null or k1 is not null or k2 is not null or scored is not null")
    placed = some.dropDuplicates(["key", "tag"]).select("key", "tag", F.inline(F.concat(*map(part, range(len(KINDS) + 1)))))
    order = Window.partitionBy("key", "tag", "kind").orderBy("j")
    placed = placed.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order)).filter("ok")
    name = F.element_at(F.array(*(F.lit(k) for k in (*(k for k, _, _ in KINDS), LEARNT))), F.col("kind") + 1)
    span = F.struct((F.col("end") - F.col("size")).alias("start"), F.col("kind").alias("order"), name.alias("kind"), F.col("end"), F.col("score"))
    spans = stored(placed.groupBy("key", "tag").agg(F.sort_array(F.collect_list(span)).alias("spans")), folder, "spans")
    if (spans.agg(F.sum(F.size("spans") + 1)).first()[0] or 0) <= FEW:
        spans = F.broadcast(spans)
    empty = F.array().cast(spans.schema["spans"].dataType)
    return found.select("id", "key", "tag").join(spans, ["key", "tag"], "left").select(F.col("id").alias(id_col), F.col("tag").alias("text_hash"), F.coalesce("spans", empty).alias("spans"))
