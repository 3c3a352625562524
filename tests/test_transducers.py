import random

from pyspark.sql import functions as F

from textlattice.operators import numbering, transducer as D


def test_numbers_and_sums_over_ranges(spark):
    pick = random.Random(1)
    rows = [(f"k{pick.randrange(10**6)}", i, pick.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i int, v long").repartition(7)
    got = {(r.k, r.i): (r.n, r.s) for r in numbering.running_sum(numbering.numbered(df, ["k", "i"], "n"), ["k", "i"], "v", "s").collect()}
    total = 0
    for n, (k, i, v) in enumerate(sorted(rows)):
        assert got[k, i] == (n, total)
        total += v


def random_fst(pick, states=12, arcs=40):
    rows = set()
    for _ in range(arcs):
        s = pick.randrange(states)
        eps = pick.random() < 0.2
        # Epsilon arcs lead upwards, so they form no cycles.
        d = pick.randrange(s + 1, states + 1) if eps else pick.randrange(states + 1)
        rows.add((s, d, "" if eps else pick.choice("abc"), pick.choice(["", "a", "b", "<n>", "x"])))
    return sorted(rows), [(states,), (pick.randrange(states),)]


def test_joined_lookup_equals_the_search(spark, monkeypatch):
    pick = random.Random(2)
    for turn in (0, 2):
        arcs, finals = random_fst(pick)
        a, f = spark.createDataFrame(arcs, "src int, dst int, isym string, osym string"), spark.createDataFrame(sorted(set(finals)), "state int")
        words = ["".join(pick.choice("abc") for _ in range(pick.randrange(5))) for _ in range(25)] + ["abz", "a" * 300]
        w = spark.createDataFrame([(x,) for x in words], "word string")
        if turn == 2:
            monkeypatch.setattr(D, "STEPS", 30)
            monkeypatch.setattr(D, "CANDIDATES", 4)
        relation = D.Relation(arcs, [x for x, in finals])
        one, two = {x: relation.lookup(x)[1] for x in words}, {r.word: r.status for r in D.lookup_joined(w, a, f).collect()}
        assert one.keys() == two.keys()
        if turn < 2:
            assert sorted(map(tuple, D.lookup(w, a, f).collect()), key=str) == sorted(map(tuple, D.lookup_joined(w, a, f).collect()), key=str)
        else:  # a search that two bounds stop is told by the first it meets
            assert {x: s == "ok" for x, s in one.items()} == {x: s == "ok" for x, s in two.items()}


def test_large_transducers_are_joined(spark, monkeypatch):
    monkeypatch.setattr(D, "FEW_ARCS", 0)
    words = spark.createDataFrame([("ab", "<n>"), ("abc", "<v>"), ("ab", "<x>")], "word string, tail string")
    arcs, finals = D.compile_words(words)
    got = sorted((r.word, r.cand_idx, r.output) for r in D.lookup(spark.createDataFrame([("ab",), ("abc",), ("a",)], "word string"), arcs, finals).collect() if r.output)
    assert got == [("ab", 0, "ab<n>"), ("ab", 1, "ab<x>"), ("abc", 0, "abc<v>")]
    back = D.lookup(spark.createDataFrame([("abc",)], "word string"), arcs.withColumn("osym", F.when(F.length("osym") == 1, F.col("osym")).otherwise("")), finals, invert=True)
    assert "abc" in {r.output for r in back.collect()}


def test_coded_arcs(spark):
    arcs, _ = D.compile_words(spark.createDataFrame([("ba", "<n>"), ("b", "<v>")], "word string, tail string"))
    out, symbols = D.coded(arcs)
    assert sorted((r.side, r.id, r.symbol) for r in symbols.collect()) == [("i", 0, ""), ("i", 1, "a"), ("i", 2, "b"), ("o", 0, ""), ("o", 1, "<n>"), ("o", 2, "<v>"), ("o", 3, "a"), ("o", 4, "b")]
    assert sorted((r.arc, r.src, r.in_id, r.out_id) for r in out.collect()) == [(0, 0, 2, 4), (1, 1, 0, 2), (2, 1, 1, 3), (3, 2, 0, 1)]
    assert sorted(map(tuple, D.csr(arcs).collect())) == [(0, 0, 1), (1, 1, 2), (2, 3, 1)]


def on_cycles(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = set(), list(near.get(a, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near.get(x, ())
        return seen

    return sorted(x for x in near if x in reach(x))


def test_epsilon_cycles_equal_brute_force(spark, monkeypatch):
    pick = random.Random(7)
    # Two cycles and a way between them, which is on neither.
    fixed = [(0, 1), (1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (6, 6), (0, 6), (0, 7)]
    for edges in (fixed, [(0, i) for i in range(1, 12)] + [(pick.randrange(12), pick.randrange(12)) for _ in range(11)]):
        arcs = spark.createDataFrame([(a, b, "", "x") for a, b in edges] + [(1, 0, "a", "a")], "src int, dst int, isym string, osym string")
        monkeypatch.setattr(D, "FEW_ARCS", 1_000_000)
        assert sorted(r.state for r in D.epsilon_cycles(arcs).collect()) == on_cycles(edges)
    monkeypatch.setattr(D, "FEW_ARCS", 0)
    assert sorted(r.state for r in D.epsilon_cycles(spark.createDataFrame([(a, b, "", "x") for a, b in fixed], "src int, dst int, isym string, osym string")).collect()) == on_cycles(fixed)


def test_deep_chains_end_at_once(spark):
    n = 100_000
    chain = spark.range(n).select(F.col("id").cast("int").alias("src"), (F.col("id") + 1).cast("int").alias("dst"), F.lit("").alias("isym"), F.lit("").alias("osym"))
    assert D.epsilon_cycles(chain).count() == 0
    closed = chain.unionByName(spark.createDataFrame([(n, n - 2, "", "")], "src int, dst int, isym string, osym string"))
    assert sorted(r.state for r in D.epsilon_cycles(closed).collect()) == [n - 2, n - 1, n]
