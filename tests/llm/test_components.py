import random

import pytest

from textlattice.llm import common


def brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("local", [1 << 18, 40])
def test_components_equal_brute_force(spark, monkeypatch, tmp_path, local):
    """Whole graphs in one share, and shares so small that rounds over the whole graph must follow."""
    monkeypatch.setattr(common, "LOCAL", local)
    pick = random.Random(local)
    names = [pick.getrandbits(62) - (1 << 61) for _ in range(300)]
    path = list(zip(names[:200], names[1:200]))
    edges = path + [(names[210], x) for x in names[211:240]] + [(names[250], names[250])] + [(pick.choice(names[260:]), pick.choice(names[260:])) for _ in range(25)]
    edges += edges[:5]
    pick.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got = {r.node: r.root for r in common.components(df, f"{tmp_path}/x", "t").collect()}
    assert got == brute(edges)
    pairs = df.selectExpr("struct(a % 7 as h1, a as h2) a", "struct(b % 7 as h1, b as h2) b")
    wide = [tuple(((abs(x) % 7) * (1 if x > 0 else -1), x) for x in e) for e in edges]
    got = {tuple(r.node): tuple(r.root) for r in common.components(pairs, f"{tmp_path}/y", "t").collect()}
    assert got == brute(wide)
    assert common.components(df.limit(0), f"{tmp_path}/z", "t").collect() == []
