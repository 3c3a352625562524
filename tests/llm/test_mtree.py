import math
import random

from pyspark.sql import functions as F

from textlattice.llm import mtree
from textlattice.llm.mtree import exact_top_k


def brute(rows, k, every):
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found, out = {}, []
    for q, a in ints:
        if q % every == 0:
            found.setdefault(q, []).extend((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q)
    for q, best in found.items():
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(best)[:k])]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    pick = random.Random(2)
    centers = [[pick.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = [(i, [c + pick.gauss(0, 0.3) for c in centers[i % 6]]) for i in range(1500)]
    rows += [(2000 + i, list(centers[0])) for i in range(300)] + [(3000, None), (3050, [1.0, None] + [0.0] * 10), (3100, [float("nan")] * 12), (3150, [float("inf")] * 12)]
    rows += [(None, [1.0] * 12), (3200, []), (3250, [2.0, 1.0])]
    # Ids of several rows, with like and other vectors.
    rows += [(7, [9.0] * 12), (7, [-9.0] * 12), (8, rows[8][1]), (100, [3.0] * 12)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    for tree, page in ((4096, 64), (200, 8)):
        monkeypatch.setattr(mtree, "TREE", tree)
        monkeypatch.setattr(mtree, "PAGE", page)
        monkeypatch.setattr(mtree, "CHUNK", 3)
        got = sorted(tuple(r) for r in exact_top_k(df, 5, F.col("vec_id") % 50 == 0).collect())
        assert got == brute(rows, 5, 50)
    assert exact_top_k(df.limit(0), 5, F.lit(True)).collect() == []
    assert sorted(tuple(r) for r in exact_top_k(df.filter("vec_id in (0, 1, 50)"), 5, F.col("vec_id") % 50 == 0).collect()) == brute([r for r in rows if r[0] in (0, 1, 50)], 5, 50)
