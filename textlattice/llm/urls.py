"""URL filters: host and path rules, then a tree of path templates per host, in DataFrame operations only.

1.  Path segments that are variable by their shape (digits, long hex, very long) become ``*`` in
    the row; deeper levels than ``DEPTH`` become ``**``.  Rows are then counted per host and template.
2.  On these counts, a level at a time, a segment under one parent is generalised to ``*`` too if
    the parent has many segments and it holds a small share of them.
3.  Siblings of one parent and like shape whose shares of blocked URLs do not differ by a
    two-proportion test are merged into one branch.
4.  A branch is rejected by its smoothed purity: the share of its URLs that rules block, drawn to
    the share of the template over all hosts, and that to the share over all labelled URLs.

The labels are the rules' verdicts.  The verdict of a branch then holds for the URLs that no rule
fits.  Rows meet the tree in one salted join, so that a host with a third of all rows is no one
task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stored

DEPTH = 6
#: A segment is variable if its parent has over MANY segments and it holds under SMALL of the parent's URLs.
MANY, SMALL = 16, 0.02
#: Two branches differ if |z| is over this; pseudo-counts of each prior; share from which a branch is blocked.
Z, PULL, BLOCKED = 1.96, 4.0, 0.5
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VARIABLE = r"^(?:[^0-9]*[0-9][^.]*|[0-9a-fA-F-]{16,}|[^.]{40,})(\.[A-Za-z0-9]{1,5})?$"

#: (verdict, host and path): a rule fits its host and all subdomains, under its path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _ruled(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits (a stated, short list: one branch each)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _template(path: Column) -> Column:
    parts = F.array_remove(F.split(path, "/"), "")
    named = F.transform(F.slice(parts, 1, DEPTH), lambda s: F.when(s.rlike(VARIABLE), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z0-9]{1,5})$", 1))).otherwise(s))
    return F.when(F.size(parts) > DEPTH, F.concat(named, F.array(F.lit("**")))).otherwise(named)


def judge_urls(pages: DataFrame, rules=RULES, url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns, ``host, path, rule, template, verdict`` of every row.

    A null URL or one without ``://`` has an empty host and path and meets the tree as any other;
    repeated rows get the same verdict; hosts without labelled URLs follow the template's share
    over other hosts, without that the share of all; with no labels at all everything is allowed;
    other columns are not read; an empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = scratch(spark)
    host, path = host_and_path(F.col(url_col))
    kept = [F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep)]
    base = pages.select(*kept, host.alias("host"), path.alias("path"))
    rule, verdict = _ruled(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), verdict.alias("ruled"), _template(F.col("path")).alias("t0"))
    seen = base.groupBy("host", "t0").agg(F.count("*").alias("n"), F.count("ruled").alias("l"), F.count(F.when(F.col("ruled") == "block", 1)).alias("b"))
    seen = stored(seen, folder, "templates")
    tree = seen.withColumn("t", F.slice("t0", 1, 0))
    for level in range(1, DEPTH + 1):
        seg = F.get("t0", F.lit(level - 1))
        step = tree.withColumn("seg", seg)
        share = step.filter("seg is not null").groupBy("host", "t", "seg").agg(F.sum("n").alias("n_seg"))
        parent = share.groupBy("host", "t").agg(F.count("*").alias("n_kinds"), F.sum("n_seg").alias("n_all"))
        wild = share.join(parent, ["host", "t"]).filter((F.col("n_kinds") > MANY) & (F.col("n_seg") < SMALL * F.col("n_all"))).select("host", "t", "seg", F.lit(True).alias("wild"))
        step = step.join(wild, ["host", "t", "seg"], "left")
        name = F.when(F.col("wild"), F.lit("*")).otherwise(F.col("seg"))
        tree = step.select("host", "t0", "n", "l", "b", F.when(F.col("seg").isNull(), F.col("t")).otherwise(F.concat("t", F.array(name))).alias("t"))
        # Each level is a table of its own: one plan over all of them would be the driver's load.
        tree = stored(tree, folder, f"level{level}")
    tree = tree.select("host", "t0", "n", "l", "b", F.when(F.size("t0") > DEPTH, F.concat("t", F.array(F.lit("**")))).otherwise(F.col("t")).alias("t"))
    tree = stored(tree, folder, "tree")
    branch = tree.groupBy("host", "t").agg(F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("b").alias("b"))
    # Siblings: equal parents and equal tails below the segment in which they differ, the first that has no wildcard.
    branch = stored(branch, folder, "shares")
    over = branch.groupBy("t").agg(F.sum("l").alias("tl"), F.sum("b").alias("tb"))
    labelled, blocked = branch.agg(F.coalesce(F.sum("l"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    level = F.greatest(F.size("t") - F.when(F.element_at(F.concat(F.array(F.lit("")), "t"), -1).startswith("*"), 2).otherwise(1), F.lit(0))
    branch = branch.select("*", F.slice("t", F.lit(1), level).alias("above"), F.slice("t", level + 2, F.lit(DEPTH + 1)).alias("below"))
    order = Window.partitionBy("host", "above", "below").orderBy(F.try_divide("b", "l"), "t")
    p = lambda b, n: (b + 1.0) / (n + 2.0)
    last_b, last_l = F.lag("b").over(order), F.lag("l").over(order)
    mid = p(F.col("b") + F.col("pb"), F.col("l") + F.col("pl"))
    gap = F.abs(p(F.col("b"), F.col("l")) - p(F.col("pb"), F.col("pl"))) / F.sqrt(mid * (1 - mid) * (1 / (F.col("l") + 2.0) + 1 / (F.col("pl") + 2.0)))
    branch = branch.select("*", last_b.alias("pb"), last_l.alias("pl")).withColumn("new", F.when(F.col("pl").isNull(), 0).otherwise((gap > Z).cast("int")))
    branch = stored(branch.withColumn("merged", F.sum("new").over(order)), folder, "branches")
    joint = branch.groupBy("host", "above", "below", "merged").agg(F.sum("l").alias("ml"), F.sum("b").alias("mb"))
    whole = branch.join(joint, ["host", "above", "below", "merged"]).join(over, "t")
    prior = F.lit(blocked / max(labelled, 1))
    prior = (F.col("tb") + PULL * prior) / (F.col("tl") + PULL)
    purity = (F.col("mb") + PULL * prior) / (F.col("ml") + PULL)
    verdicts = whole.select("host", "t", F.when(purity >= BLOCKED, "block").otherwise("allow").alias("said"))
    lookup = stored(tree.join(verdicts, ["host", "t"]).select("host", "t0", "t", "said"), folder, "verdicts")
    salted = lookup.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = base.withColumn("salt", F.pmod(F.xxhash64("path", *[f"keep_{i}" for i in range(len(keep))]), F.lit(SALTS)).cast("int"))
    out = dealt.join(salted, ["host", "t0", "salt"], "left")
    return out.select(
        *[F.col(f"keep_{i}").alias(k) for i, k in enumerate(keep)], "host", "path", "rule",
        F.concat(F.lit("/"), F.array_join("t", "/")).alias("template"), F.coalesce("ruled", "said").alias("verdict"),
    )
