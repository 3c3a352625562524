"""Quality rules: robust multivariate outliers per language and source, in DataFrame operations only.

Word and line statistics of every whole text are transformed to a vector of fixed-point numbers.
For each (language, source) a minimum-covariance-determinant estimate is found by concentration
steps: rows are ranked by Mahalanobis distance from the present centre, the nearest ``share`` of
them give the next centre and covariance.  Two starts (marginal medians, all rows) run side by
side and the smaller determinant wins.  Rows beyond a chi-square cut-off of the distance are
rejected, if a statistic that marks junk lies above the centre.

Each concentration step is one salted join (a group's parameters are a row for each salt) and one
aggregation with partial sums; sums are of longs, so that they do not depend on the order of
tasks.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, scratch, stored

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UNIT = 1000
#: Salts of a group's parameters; levels of the ranked distance per power of two.
SALTS, LEVELS = 16, 32
#: Name, and least standard deviation (a share of the rows has none at all), of each transformed statistic.
FEATURES = (("length", 0.5), ("wordlen", 0.5), ("symbols", 0.7), ("lines", 0.9), ("repeats", 0.7))
#: The 0.9999 quantile of chi-square with five degrees of freedom, and the factor that makes the
#: covariance of the nearest three quarters of a normal sample in five dimensions consistent.
CUT, CONSISTENCY, SHARE = 25.74, 1.49, 0.75


def statistics(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Word and line counts of every whole text; ``keep`` columns pass through."""
    d = docs.select(*[F.col(k) for k in keep], F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select("*", F.array_remove(F.split("text", WORD_BREAK), "").alias("words"))
    d = d.select(
        *keep, "id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.when(
            F.size("words") >= 3,
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), F.size("words") - 3),
                    lambda i: F.struct(F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("w"), i.alias("i")),
                )
            ),
        ).alias("windows"),
    )
    same = lambda x, j: F.get("windows", j)["w"] == x["w"]
    d = d.select(
        *keep, "id", "n_words", "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.filter("windows", lambda x, j: (F.coalesce(same(x, j + 1), F.lit(False))) | ((j > 0) & same(x, F.greatest(j - 1, F.lit(0))))).alias("twice"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("twice", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return d.select(
        *keep, "id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.when(F.col("twice").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
    )


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda a, b: F.log1p(100 * F.col(a) / b)
    raw = (F.log1p(F.col("n_words")), F.col("word_chars") / words, share("n_symbols", words), share("n_dup_lines", F.greatest("n_lines", F.lit(1))), share("n_repeat_words", words))
    # A mean word length over 1,000 counts as 1,000: the fixed-point squares then sum without overflow over 10^6 such texts a group.
    return [F.round(UNIT * F.least(x, F.lit(1000.0))).cast("long").alias(n) for (n, _), x in zip(FEATURES, raw)]


def _cholesky(params: DataFrame) -> DataFrame:
    """Adds the factor ``l_ij`` of the covariance ``c_ij`` and its log-determinant, one column a step."""
    p = len(FEATURES)
    for j in range(p):
        inner = sum((F.col(f"l_{j}{k}") * F.col(f"l_{j}{k}") for k in range(j)), F.lit(0.0))
        params = params.withColumn(f"l_{j}{j}", F.sqrt(F.greatest(F.col(f"c_{j}{j}") - inner, F.lit(1e-9))))
        below = {}
        for i in range(j + 1, p):
            inner = sum((F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}") for k in range(j)), F.lit(0.0))
            below[f"l_{i}{j}"] = (F.col(f"c_{i}{j}") - inner) / F.col(f"l_{j}{j}")
        if below:
            params = params.withColumns(below)
    det = sum((2 * F.log(F.col(f"l_{i}{i}")) for i in range(p)), F.lit(0.0))
    return params.withColumn("logdet", det)


FACTOR = [f"l_{i}{j}" for i in range(len(FEATURES)) for j in range(i + 1)]
PARAMS = [*(f"m_{i}" for i in range(len(FEATURES))), *FACTOR, "logdet"]


def _with_distance(rows: DataFrame) -> DataFrame:
    """Forward substitution: ``d2`` of each row from its joined parameters."""
    for i, (name, _) in enumerate(FEATURES):
        inner = sum((F.col(f"l_{i}{k}") * F.col(f"y_{k}") for k in range(i)), F.lit(0.0))
        rows = rows.withColumn(f"y_{i}", (F.col(name) / UNIT - F.col(f"m_{i}") - inner) / F.col(f"l_{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(len(FEATURES))), F.lit(0.0)))


def _sums() -> list[Column]:
    p = len(FEATURES)
    out = [F.count("*").alias("n")]
    out += [F.sum(FEATURES[i][0]).alias(f"s_{i}") for i in range(p)]
    out += [F.sum(F.col(FEATURES[i][0]) * F.col(FEATURES[j][0])).alias(f"q_{i}{j}") for i in range(p) for j in range(i + 1)]
    return out


def _moments(sums: DataFrame, scale: float, *keys: str) -> DataFrame:
    """Means and floored covariances from sums of fixed-point numbers."""
    p = len(FEATURES)
    n = F.col("n").cast("double")
    mean = {f"m_{i}": F.col(f"s_{i}") / n / UNIT for i in range(p)}
    out = sums.withColumns(mean)
    cov = {}
    for i in range(p):
        for j in range(i + 1):
            c = scale * (F.col(f"q_{i}{j}") / n / (UNIT * UNIT) - F.col(f"m_{i}") * F.col(f"m_{j}"))
            cov[f"c_{i}{j}"] = F.greatest(c, F.lit(FEATURES[i][1] ** 2)) if i == j else c
    return _cholesky(out.withColumns(cov)).select(*keys, *PARAMS)


def _salted(rows: DataFrame, params: DataFrame, how: str = "inner") -> DataFrame:
    spread = params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(spread, ["g1", "g2", "salt"], how)


def judge(stats: DataFrame, folder: str, steps: int = 4, cut: float = CUT) -> DataFrame:
    """Adds ``d2`` and ``outlier`` to stored ``statistics`` with group columns ``g1``, ``g2``."""
    p = len(FEATURES)
    vec = stats.select("*", F.pmod(F.xxhash64("id", "n_words", "word_chars"), F.lit(SALTS)).cast("int").alias("salt"), *_vector())
    usable = vec.filter("not base_failed")
    whole = stored(usable.groupBy("g1", "g2", "salt").agg(*_sums()), folder, "whole")
    whole = whole.groupBy("g1", "g2").agg(*[F.sum(c).alias(c) for c in whole.columns if c not in ("g1", "g2", "salt")])
    # Fixed-point values of a statistic are few, so the exact percentile keeps few counts.
    mid = usable.groupBy("g1", "g2").agg(*[F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(n) for n, _ in FEATURES])
    names = [n for n, _ in FEATURES]
    cov = {f"c_{i}{j}": F.greatest(F.pow((F.col(names[i])[2] - F.col(names[i])[0]) / UNIT / 1.349, 2), F.lit(FEATURES[i][1] ** 2)) if i == j else F.lit(0.0) for i in range(p) for j in range(i + 1)}
    mid = mid.withColumns({f"m_{i}": F.col(names[i])[1] / UNIT for i in range(p)} | cov)
    start = [_cholesky(mid).select("g1", "g2", F.lit(0).alias("start"), *PARAMS), _moments(whole, 1.0, "g1", "g2").select("g1", "g2", F.lit(1).alias("start"), *PARAMS)]
    params = stored(start[0].unionByName(start[1]), folder, "p0")
    for k in range(1, steps + 1):
        near = _with_distance(_salted(usable, params))
        near = near.withColumn("level", F.floor(LEVELS * F.log2(1 + F.col("d2"))).cast("int"))
        level = near.groupBy("g1", "g2", "start", "level").agg(*_sums())
        grow = Window.partitionBy("g1", "g2", "start").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
        every = Window.partitionBy("g1", "g2", "start")
        inside = level.withColumns({"before": F.coalesce(F.sum("n").over(grow), F.lit(0)), "all": F.sum("n").over(every)}).filter(F.col("before") < SHARE * F.col("all"))
        sums = inside.groupBy("g1", "g2", "start").agg(*[F.sum(c).alias(c) for c in level.columns if c not in ("g1", "g2", "start", "level")])
        nxt = stored(_moments(sums, CONSISTENCY, "g1", "g2", "start"), folder, f"p{k}")
        forget(stats.sparkSession, folder, f"p{k - 1}")
        params = nxt
    best = params.groupBy("g1", "g2").agg(F.min_by(F.struct(*PARAMS), F.struct("logdet", "start")).alias("b")).select("g1", "g2", "b.*")
    out = _with_distance(_salted(vec, best, "left"))
    above = lambda i: F.col(names[i]) / UNIT > F.col(f"m_{i}")
    junk = above(2) | above(3) | above(4) | (F.abs(F.col("wordlen") / UNIT - F.col("m_1")) > 3)
    return out.select(*stats.columns, "d2", F.coalesce((F.col("d2") > cut) & junk, F.lit(False)).alias("outlier"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cut: float = CUT) -> DataFrame:
    """``(id, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, d2, kept)`` of every row.

    A null text has no words and fails the base rules; null languages and sources are groups of
    their own; a group whose rows all fail the base rules judges none (``kept`` is false for all
    of them); constant statistics get a least deviation, so no covariance is singular; repeated
    rows are judged alike; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = scratch(spark)
    clear = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    named = docs.select(id_col, text_col, clear(lang_col).alias("g1"), clear(source_col).alias("g2"), F.xxhash64(text_col).alias("text_hash"))
    stats = statistics(named, id_col, text_col, ("g1", "g2", "text_hash"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stored(stats.withColumn("base_failed", failed), folder, "stats")
    out = judge(stats, folder, cut=cut)
    return out.select(
        F.col("id").alias(id_col), "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2",
        (~F.col("base_failed") & ~F.col("outlier")).alias("kept"),
    )
