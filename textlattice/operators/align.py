"""Alignment of gold and predicted tokens of a sentence.

``by_offsets`` is native and settles sentences whose alignment-key streams are equal and that have
no multiword rows; ``align`` searches for the cheapest way through both sides of a sentence.
"""

from __future__ import annotations

import heapq
import operator
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlattice.functions import text as X

#: Folds of the alignment key.
FOLD = str.maketrans({**dict.fromkeys("‘’ʼʻ", "'"), **dict.fromkeys("‐‑‒–—−", "-")})
MAX_GROUP = 4
OPS = "sent_id string, op_idx int, kind string, gold_start int, gold_size int, pred_start int, pred_size int, match_kind string"


def key(form: str) -> str:
    return "".join(unicodedata.normalize("NFC", form).casefold().translate(FOLD).split())


class Sentence:
    """Both sides of a sentence as units of alignment key, and the steps between boundaries ``(i, j)``.

    A multiword row gives its first token the key of its form and the others none; a boundary
    inside it is closed to matches.
    """

    def __init__(self, gold: list[tuple[int, str]], pred: list[str], multiword, max_group: int):
        self.max_group = max_group
        self.forms = [unicodedata.normalize("NFC", f) for _, f in gold], [unicodedata.normalize("NFC", f) for f in pred]
        self.units = [key(f) for _, f in gold], [key(f) for f in pred]
        at = {tok: i for i, (tok, _) in enumerate(gold)}
        rows = {at[first]: (at[last], form) for first, last, form in multiword if first in at and last in at and at[first] <= at[last]}
        self.closed = {i for first, (last, _) in rows.items() for i in range(first + 1, last + 1)}
        done = 0
        for first in sorted(rows):
            if first >= done:
                done = rows[first][0] + 1
                self.units[0][first:done] = [key(rows[first][1])] + [""] * (done - first - 1)

    def step(self, a: int, b: int, c: int, d: int) -> tuple[tuple[int, ...], str, str] | None:
        """Cost, kind and match kind of the step from ``(a, b)`` to ``(c, d)``, if there is one."""
        g, p = c - a, d - b
        if (g, p) == (1, 0):
            return (1, 0, 0, 0), "skip_gold", ""
        if (g, p) == (0, 1):
            return (1, 0, 0, 0), "skip_predicted", ""
        if not (0 < g <= self.max_group and 0 < p <= self.max_group) or a in self.closed or c in self.closed:
            return None
        left = "".join(self.units[0][a:c])
        if not left or left != "".join(self.units[1][b:d]):
            return None
        if g == p == 1:
            same = self.forms[0][a] == self.forms[1][b]
            return (0, 0, 0, 1 - same), "match", "exact" if same else "normalized"
        return (0, g + p, (g - 1) * (p - 1), 0), "match", "group"

    def around(self, i: int, j: int, way: int):
        """Boundaries a step away, ahead or behind (``way`` 1 or -1), in order of their places."""
        n, m = len(self.units[0]), len(self.units[1])
        near = [(i + way * g, j + way * p) for g in range(self.max_group + 1) for p in range(self.max_group + 1) if g + p == 1 or g and p]
        return sorted((x, y) for x, y in near if 0 <= x <= n and 0 <= y <= m)

    def least(self) -> dict[tuple[int, int], tuple[int, ...]]:
        """Least costs from the start, cheapest boundary first, up to the end of both sides."""
        end = len(self.units[0]), len(self.units[1])
        settled: dict[tuple[int, int], tuple[int, ...]] = {}
        open_ = [((0, 0, 0, 0), (0, 0))]
        while open_:
            so_far, here = heapq.heappop(open_)
            if here in settled:
                continue
            if end in settled and so_far > settled[end]:
                break  # boundaries of the same cost as the end can still be on the way to it
            settled[here] = so_far
            for to in self.around(*here, 1):
                if to not in settled and (found := self.step(*here, *to)):
                    heapq.heappush(open_, (tuple(map(operator.add, so_far, found[0])), to))
        return settled


def align_sentence(gold: list[tuple[int, str]], pred: list[str], multiword: list[tuple[int, int, str]] = (), max_group: int = MAX_GROUP) -> list[tuple[str, int, int, int, int, str]]:
    """Operations ``(kind, gold start, gold size, predicted start, predicted size, match kind)`` of least cost.

    Cost, compared in this order: tokens left out, tokens in groups, (g - 1)(p - 1) of groups,
    pairs equal only after folding.  Of equal costs the last operation starts as early as can be,
    on the gold side first; then the one before it, and so on.
    """
    sentence = Sentence(gold, pred, multiword, max_group)
    cost = sentence.least()
    here, out = (len(gold), len(pred)), []
    while here != (0, 0):
        for was in sentence.around(*here, -1):
            found = sentence.step(*was, *here) if was in cost else None
            if found and tuple(map(operator.add, cost[was], found[0])) == cost[here]:
                out.append((found[1], was[0], here[0] - was[0], was[1], here[1] - was[1], found[2]))
                here = was
                break
    return out[::-1]


def align(gold: DataFrame, pred: DataFrame, multiword: DataFrame | None = None, max_group: int = MAX_GROUP) -> DataFrame:
    """Operations of every sentence of ``gold(sent_id, ordinal, tok_id, form)`` and ``pred(sent_id, tok_idx, text)``.

    Sentences are packed to one row a side (arrays bounded by sentence length) and joined, so the
    search runs inside one Arrow map.
    """
    ordered = lambda df, *cols: F.sort_array(F.collect_list(F.struct(*cols)))
    g = gold.groupBy("sent_id").agg(ordered(gold, "ordinal", "tok_id", "form").alias("g"))
    p = pred.groupBy("sent_id").agg(ordered(pred, "tok_idx", "text").alias("p"))
    both = g.join(p, "sent_id", "full")
    if multiword is not None:
        both = both.join(multiword.groupBy("sent_id").agg(F.collect_list(F.struct("start_id", "end_id", "form")).alias("m")), "sent_id", "left")
    else:
        both = both.withColumn("m", F.lit(None).cast("array<struct<start_id:int,end_id:int,form:string>>"))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                get = lambda x: [] if x is None else list(x)
                ops = align_sentence([(t["tok_id"], t["form"]) for t in get(r.g)], [t["text"] for t in get(r.p)], [(t["start_id"], t["end_id"], t["form"]) for t in get(r.m)], max_group)
                out += [(r.sent_id, i, *op) for i, op in enumerate(ops)]
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in OPS.split(", ")])

    return both.mapInPandas(run, OPS)


def by_offsets(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """``(sent_id, ordinal, tok_idx, match_kind)`` of 1:1 pairs in sentences whose key streams are equal."""
    def keyed(df, at, form):
        w = Window.partitionBy("sent_id").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        k = X.alignment_key(F.col(form))
        df = df.select("sent_id", at, F.col(form), k.alias("k")).withColumn("end", F.sum(F.length("k")).over(w))
        return df.withColumn("start", F.col("end") - F.length("k"))

    whole = lambda df, at, name: df.groupBy("sent_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, "k"))), lambda x: x["k"]), "").alias(name))
    g, p = keyed(gold, "ordinal", "form"), keyed(pred, "tok_idx", "text")
    same = whole(g, "ordinal", "gk").join(whole(p, "tok_idx", "pk"), "sent_id").filter("gk = pk").select("sent_id")
    hit = g.join(same, "sent_id").filter("k <> ''").join(p, ["sent_id", "start", "end", "k"])
    return hit.select("sent_id", "ordinal", "tok_idx", F.when(F.col("form") == F.col("text"), "exact").otherwise("normalized").alias("match_kind"))


def counts(ops: DataFrame) -> DataFrame:
    one = (F.col("gold_size") == 1) & (F.col("pred_size") == 1)
    n = lambda c, what=F.lit(1): F.coalesce(F.sum(F.when(c, what)), F.lit(0)).cast("long")
    group = F.col("match_kind") == "group"
    return ops.agg(
        F.count_distinct("sent_id").alias("sentences"), F.coalesce(F.sum("gold_size"), F.lit(0)).cast("long").alias("gold_tokens"), F.coalesce(F.sum("pred_size"), F.lit(0)).cast("long").alias("predicted_tokens"),
        n(one & (F.col("match_kind") == "exact")).alias("one_to_one_exact"), n(one & (F.col("match_kind") == "normalized")).alias("one_to_one_normalized"), n(group).alias("grouped_operations"),
        n(group, F.col("gold_size")).alias("grouped_gold_tokens"), n(group, F.col("pred_size")).alias("grouped_predicted_tokens"),
        n(F.col("kind") == "skip_gold").alias("unaligned_gold_tokens"), n(F.col("kind") == "skip_predicted").alias("unaligned_predicted_tokens"),
    )
