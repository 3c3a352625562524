import random
import re

from textlattice.llm import divergence as D
from textlattice.llm.divergence import source_divergence


def brute(rows, least, top):
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = {}
        for _, _, terms in mine:
            for t in set(terms):
                seen[t] = seen.get(t, 0) + 1
        kept = [t for t, n in seen.items() if n >= least]
        sources = sorted({d[1] for d in mine})

        def shares(own):
            n = {t: 0 for t in kept}
            for d in mine:
                if own is None or d[1] == own:
                    for t in d[2]:
                        if t in n:
                            n[t] += 1
            total = sum(n.values()) + 2 * len(kept)
            return n, {t: 1 + 1_000_000_000 * (n[t] + 2) // total for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        whole = shares(None)[1]
        of = {s: shares(s) for s in sources}
        for s in sources:
            n, p = of[s]
            parts = {
                "pair": [(sum(f(p[t], of[o][1][t]) for t in kept), o) for o in sources if o != s],
                "term": [(f(p[t], whole[t]), t) for t in kept if n[t] and p[t] > whole[t]],
            }
            for part, found in parts.items():
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(ranked, 1) if part == "pair" or r <= top]
    return sorted(out)


def corpus(pick):
    words = ["Aé", "bB", "c", "été", "日本", "Z", "rare", "x'y", "q9w", "ÄÖ"] + [f"w{'abcdefghij'[i % 10]}{'abc'[i // 10]}" for i in range(30)]
    rows = []
    for i in range(400):
        s = pick.randrange(7)
        pool = words[: 5 + s * 4] if s else words
        rows.append((pick.choice(["en", "en", "de", None]), f"s{s}" if s < 6 else None, " ".join(pick.choice(pool) for _ in range(pick.randrange(30)))))
    rows += [("fr", "only", "nothing kept"), ("it", "a", "x"), ("it", "b", None), ("it", "", ""), ("en", "empty", None), ("en", "long", "bB c " * 30_000)]
    return rows + rows[:20]


def test_equals_brute_force(spark, monkeypatch):
    rows = corpus(random.Random(9))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, item int, value int").repartition(5)
    for held, part, least, top in ((300_000, 1 << 20, 10, 10), (3, 64, 2, 1), (40, 1000, 25, 3)):
        monkeypatch.setattr(D, "HELD", held)
        monkeypatch.setattr(D, "PART", part)
        got = sorted(tuple(r) for r in source_divergence(df, least, top).collect())
        assert got == brute(rows, least, top)
    assert source_divergence(df.limit(0)).collect() == []


def test_shuffled_sides_give_the_same(spark, monkeypatch):
    rows = corpus(random.Random(3))
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    monkeypatch.setattr(D, "few", lambda x: x)
    assert sorted(tuple(r) for r in source_divergence(df).collect()) == brute(rows, 10, 10)


def test_counts_beyond_a_long(spark):
    from pyspark.sql import functions as F

    n, total = 12_345_678_901_234_567, 98_765_432_109_876_543
    got = spark.range(1).select(F.lit(n).alias("n"), F.lit(total).alias("t"), F.lit(7).cast("long").alias("v")).select(D._share("n", "t", "v")).first()[0]
    assert got == 1 + 1_000_000_000 * (n + 2) // (total + 14)
