"""Measures: coverage, recall and accuracy, selection, containment, latency, throughput.

Each is one conditional aggregation, so partial sums leave every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlattice.functions import text as X

ORIGINS = ("dictionary", "fixlist", "guesser", "rule", "base_guess", "unknown", "zero")


def ratio(correct: Column, total: Column, name: str) -> Column:
    """Struct of counts and their quotient, null for none."""
    return F.struct(correct.alias("correct"), total.alias("total"), F.try_divide(correct, total).alias("value")).alias(name)


def origin(readings: Column) -> Column:
    """The one bucket of a lexical token, by priority of what licensed it."""
    some = lambda source, guessed=None: F.exists(readings, lambda r: (r["source"] == source) & (F.lit(True) if guessed is None else (r["guessed"] == guessed)))
    return (
        F.when(F.size(readings) == 0, "zero").when(some("lexicon", False), "dictionary").when(some("fixlist"), "fixlist").when(some("guesser"), "guesser")
        .when(some("rule"), "rule").when(some("lexicon", True), "base_guess").otherwise("unknown")
    )


def coverage(tokens: DataFrame) -> DataFrame:
    """One row over ``tokens(kind, readings)``: lexical tokens by origin, candidates in sum, mean and maximum."""
    lexical = tokens.filter(F.col("kind").isin("word", "number")).select(origin(F.col("readings")).alias("o"), F.size("readings").alias("n"))
    return lexical.agg(
        F.count("*").alias("lexical_tokens"), *[F.count_if(F.col("o") == o).alias(o) for o in ORIGINS],
        F.sum("n").alias("candidates"), F.round(F.avg("n"), 6).alias("mean_candidates"), F.max("n").alias("max_candidates"),
    )


def metric_set(pairs: DataFrame, *by: str) -> DataFrame:
    """Nine measures over gold tokens with candidates.

    ``pairs(gold_lemma, gold_upos, gold_features, candidates)``; a null or empty array of
    candidates (``lemma, upos, features, source``) is a miss.  Readings of source ``unknown`` never
    score.  Empty or ``_`` lemmas and UPOS leave their denominators; features always count.
    """
    cands = F.filter(F.coalesce("candidates", F.expr("filter(candidates, x -> false)")), lambda c: c["source"] != "unknown")
    has_lemma = ~F.coalesce("gold_lemma", F.lit("_")).isin("", "_")
    has_upos = ~F.coalesce("gold_upos", F.lit("_")).isin("", "_")
    lemma = lambda c: X.casefold(c["lemma"]) == X.casefold(F.col("gold_lemma"))
    upos = lambda c: c["upos"] == F.col("gold_upos")
    equal = lambda c: c["features"] == F.col("gold_features")
    gold_in = lambda c: F.size(F.array_except("gold_features", c["features"])) == 0
    in_gold = lambda c: F.size(F.array_except(c["features"], F.col("gold_features"))) == 0
    both = has_lemma & has_upos
    measures = {
        "lemma": (has_lemma, lemma), "upos": (has_upos, upos), "features": (F.lit(True), equal), "lemma_upos": (both, lambda c: lemma(c) & upos(c)),
        "full": (both, lambda c: lemma(c) & upos(c) & equal(c)), "gold_subset": (F.lit(True), gold_in), "candidate_subset": (F.lit(True), in_gold),
        "full_gold_subset": (both, lambda c: lemma(c) & upos(c) & gold_in(c)), "full_candidate_subset": (both, lambda c: lemma(c) & upos(c) & in_gold(c)),
    }
    df = pairs.withColumn("_c", cands)
    exprs = []
    for name, (counted, hit) in measures.items():
        exprs += [F.count_if(counted & F.coalesce(F.exists("_c", hit), F.lit(False))).alias(f"{name}_correct"), F.count_if(counted).alias(f"{name}_total")]
    return df.groupBy(*by).agg(*exprs) if by else df.agg(*exprs)


#: Which gold tokens count: all (one without a partner is a miss), those with one, those whose partner has a choice.
SCOPES = ("end_to_end", "aligned_only", "selected_only")


def scoped(gold: DataFrame, tokens: DataFrame, ops: DataFrame) -> DataFrame:
    """Gold tokens once for each scope they count in: ``scope`` and what ``metric_set`` reads.

    ``gold(sent_id, ordinal, lemma, upos, features)``, ``tokens(sent_id, tok_idx, readings,
    selected)``; partners are the one-to-one matches of ``ops`` (``align.OPS``).  One join and one
    generator; ``metric_set(..., "scope")`` then is one aggregation.
    """
    one = ops.filter("kind = 'match' and gold_size = 1 and pred_size = 1").select("sent_id", F.col("gold_start").alias("ordinal"), F.col("pred_start").alias("tok_idx"))
    j = gold.join(one, ["sent_id", "ordinal"], "left").join(tokens.select("sent_id", "tok_idx", "readings", "selected"), ["sent_id", "tok_idx"], "left")
    bare = lambda rs: F.transform(rs, lambda r: F.struct(*(r[c].alias(c) for c in ("lemma", "upos", "features", "source"))))
    none = F.expr("cast(array() as array<struct<lemma: string, upos: string, features: array<struct<k: string, v: string>>, source: string>>)")
    every = F.coalesce(bare(F.col("readings")), none)
    best = F.when(F.size("readings") == 1, F.get("readings", F.lit(0))).otherwise(F.get("readings", F.col("selected")))
    chosen = F.when(best.isNotNull() & (best["source"] != "unknown"), bare(F.array(best)))
    counts = F.array_compact(F.array(
        F.struct(F.lit(SCOPES[0]).alias("scope"), every.alias("candidates")), F.when(F.col("tok_idx").isNotNull(), F.struct(F.lit(SCOPES[1]).alias("scope"), every.alias("candidates"))),
        F.when(chosen.isNotNull(), F.struct(F.lit(SCOPES[2]).alias("scope"), chosen.alias("candidates"))),
    ))
    return j.select(F.col("lemma").alias("gold_lemma"), F.col("upos").alias("gold_upos"), F.col("features").alias("gold_features"), F.inline(counts))


def selection_stats(tokens: DataFrame) -> DataFrame:
    """``tokens(aligned, n_candidates, selected)``: every gold token in one bucket."""
    b = (
        F.when(~F.col("aligned"), "unaligned").when(F.col("n_candidates") == 0, "no_candidate").when(F.col("n_candidates") == 1, "single")
        .when(F.col("selected").isNotNull(), "ambiguous_selected").otherwise("unresolved")
    )
    t = tokens.select(b.alias("b"))
    n = lambda *names: F.count_if(F.col("b").isin(*names))
    done = n("single", "ambiguous_selected")
    return t.agg(
        F.count("*").alias("gold_tokens"), *[n(x).alias(x) for x in ("unaligned", "no_candidate", "single", "ambiguous_selected", "unresolved")],
        F.round(F.try_divide(done, F.count_if(F.col("b") != "unaligned")), 6).alias("coverage_aligned"), F.round(F.try_divide(done, F.count("*")), 6).alias("coverage_end_to_end"),
    )


def containment(chosen: DataFrame, lattice: DataFrame, samples: int = 20) -> DataFrame:
    """Chosen readings ``(doc_id, start, end, text, raw)`` that the lattice ``(..., raws)`` lacks, with the reason; up to ``samples``."""
    j = chosen.join(lattice.select("doc_id", "start", "end", "text", "raws"), ["doc_id", "start", "end", "text"], "left")
    reason = F.when(F.col("raws").isNull(), "no_identical_lattice_span").when(~F.array_contains("raws", F.col("raw")), "selected_raw_analysis_absent")
    return j.withColumn("reason", reason).filter("reason is not null").select("doc_id", "start", "end", "text", "raw", "reason").orderBy("doc_id", "start", "end", "text", "raw").limit(samples)


def latency(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, minimum, p50, p95, p99 (linear interpolation), maximum, mean, sample deviation (0 for one value)."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.min(v).alias("min"), *[F.percentile(v, p).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))],
        F.max(v).alias("max"), F.avg(v).alias("mean"), F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v)).alias("stdev"),
    )


def throughput(df: DataFrame, elapsed: str, calls: str, tokens: str, chars: str, bytes_: str) -> DataFrame:
    """Rates per second; null if no time elapsed."""
    rate = lambda c: F.when(F.col(elapsed) > 0, F.round(F.col(c) / F.col(elapsed), 6))
    return df.select("*", rate(calls).alias("calls_per_s"), rate(tokens).alias("tokens_per_s"), rate(chars).alias("chars_per_s"), rate(bytes_).alias("bytes_per_s"))


def group_evidence(ops: DataFrame, multiword: DataFrame, pred_kinds: DataFrame) -> DataFrame:
    """Grouped alignments by shape, direction and what explains them."""
    g = ops.filter("match_kind = 'group'")
    direction = F.when(F.col("gold_size") > F.col("pred_size"), "merge").when(F.col("gold_size") < F.col("pred_size"), "split").otherwise("many_to_many")
    m = multiword.select("sent_id", "gold_start", "gold_end")
    g = g.join(m, (g["sent_id"] == m["sent_id"]) & (m["gold_start"] >= g["gold_start"]) & (m["gold_end"] <= g["gold_start"] + g["gold_size"]), "left_semi").withColumn("mwt", F.lit(True)).unionByName(
        g.join(m, (g["sent_id"] == m["sent_id"]) & (m["gold_start"] >= g["gold_start"]) & (m["gold_end"] <= g["gold_start"] + g["gold_size"]), "left_anti").withColumn("mwt", F.lit(False))
    )
    p = pred_kinds.filter("kind = 'punct'").select("sent_id", F.col("tok_idx").alias("t"))
    j = g.join(p, (g["sent_id"] == p["sent_id"]) & (p["t"] >= g["pred_start"]) & (p["t"] < g["pred_start"] + g["pred_size"]), "left").groupBy(g["sent_id"], "op_idx", "gold_size", "pred_size", "mwt").agg(F.count("t").alias("puncts"))
    cause = F.when(F.col("mwt"), "ud_multiword_token_surface").when(F.col("pred_size") == 1, "analyzer_multiword_fusion").when(F.col("puncts") > 0, "analyzer_punctuation_split").otherwise("other")
    return j.groupBy(F.concat_ws(":", "gold_size", "pred_size").alias("shape"), direction.alias("direction"), cause.alias("evidence")).count()


def counter_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Named counters of two snapshots and what a run added."""
    a, b = before.toDF("name", "initial"), after.toDF("name", "final")
    j = a.join(b, "name", "full").select("name", F.coalesce("initial", F.lit(0)).alias("initial"), F.coalesce("final", F.lit(0)).alias("final"))
    return j.withColumn("during_run", F.col("final") - F.col("initial"))


def completeness(events: DataFrame) -> DataFrame:
    """``events(run_id, caps, timeouts, failures, cycles, unsafe, applicable)``: complete, incomplete or not applicable."""
    bad = F.sum(F.col("caps") + F.col("timeouts") + F.col("failures") + F.col("cycles") + F.col("unsafe"))
    return events.groupBy("run_id").agg(F.when(~F.bool_or("applicable"), "not_applicable").when(bad == 0, "complete").otherwise("incomplete").alias("status"))


def reports(tokens: DataFrame) -> DataFrame:
    """Token counts by every grouping of language and kind."""
    return tokens.cube("lang", "kind").agg(F.count("*").alias("n"))


def sentence_ids(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds ``sent_no`` (from 0) and ``sent_tok`` (from 1), which restart after ``sentence_end``."""
    w = Window.partitionBy(id_col).orderBy("tok_idx")
    t = tokens.withColumn("_before", F.coalesce(F.lag(F.col("sentence_end").cast("int")).over(w), F.lit(0)))
    t = t.withColumn("sent_no", F.sum("_before").over(w)).drop("_before")
    return t.withColumn("sent_tok", F.row_number().over(Window.partitionBy(id_col, "sent_no").orderBy("tok_idx")))


def gold_coverage(tokens: DataFrame) -> DataFrame:
    """``tokens(key, gold_upos, readings)`` of gold words, punctuation left out: what the lattice knows of them, by token and by type."""
    t = tokens.filter(F.coalesce("gold_upos", F.lit("")) != "PUNCT").withColumn("r", F.coalesce("readings", F.expr("filter(readings, x -> false)")))
    some = lambda f: F.exists("r", f)
    compiled = some(lambda r: (r["source"] == "lexicon") & ~r["guessed"])
    fix = some(lambda r: r["source"] == "fixlist")
    effective = compiled | fix
    with_guess = effective | some(lambda r: r["source"] == "guesser")
    n = F.count_if
    types = lambda c: F.count_distinct(F.when(c, F.col("key")))
    return t.agg(
        F.count("*").alias("gold_tokens"), F.count_distinct("key").alias("gold_types"), n(F.size("r") > 0).alias("with_analysis"), n(compiled).alias("compiled"), n(fix).alias("fixlist"), n(effective).alias("effective"),
        n(some(lambda r: r["source"] == "rule")).alias("with_rule"), n(some(lambda r: (r["source"] == "lexicon") & r["guessed"])).alias("base_unknown"), n(~effective).alias("oov"), types(~effective).alias("oov_types"),
        n(~with_guess).alias("oov_with_guess"), n(some(lambda r: r["source"] == "unknown")).alias("unknown_placeholders"), F.round(F.avg(F.size("r")), 6).alias("mean_candidates"), F.max(F.size("r")).alias("max_candidates"),
    )


def neural_resolution(tokens: DataFrame) -> DataFrame:
    """``tokens(kind, n_candidates, predicted, selected)``: what re-ranking resolved of lexical tokens."""
    t = tokens.filter(F.col("kind").isin("word", "number"))
    many = F.col("n_candidates") > 1
    n = F.count_if
    return t.agg(
        F.count("*").alias("lexical_tokens"), n("predicted").alias("predicted"), n(many).alias("ambiguous"), n(many & F.col("selected").isNotNull()).alias("resolved"), n(many & F.col("selected").isNull()).alias("abstained"),
        F.round(F.try_divide(n(many & F.col("selected").isNotNull()), n(many)), 6).alias("resolution_rate"),
    )


def memory(samples: DataFrame) -> DataFrame:
    """Largest and mean of ``samples(rss_mib)``."""
    return samples.agg(F.max("rss_mib").alias("max_mib"), F.round(F.avg("rss_mib"), 6).alias("mean_mib"))


def consistency(workers: DataFrame) -> DataFrame:
    """Columns of ``workers(run_id, tokens, provenance)`` in which a run's workers do not agree."""
    g = workers.groupBy("run_id").agg(F.count_distinct("tokens").alias("t"), F.count_distinct("provenance").alias("p"))
    return g.select("run_id", F.array_compact(F.array(F.when(F.col("t") != 1, "tokens"), F.when(F.col("p") != 1, "provenance"))).alias("differs")).filter(F.size("differs") > 0)


def ledger_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Surfaces of two ledgers ``(surface, cand_idx, raw)`` whose ordered candidates differ."""
    pack = lambda d, n: d.groupBy("surface").agg(F.transform(F.sort_array(F.collect_list(F.struct("cand_idx", "raw"))), lambda x: x["raw"]).alias(n))
    j = pack(a, "left_raws").join(pack(b, "right_raws"), "surface", "full")
    return j.filter(~F.col("left_raws").eqNullSafe(F.col("right_raws")))
