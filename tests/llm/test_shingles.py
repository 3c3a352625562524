import random

import corpus_pipeline as CP

from .test_pipeline import SCHEMA, corpus


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def test_near_stage_equals_brute_force_jaccard(spark):
    pick = random.Random(5)
    rows = corpus()
    for i in range(60):
        words = rows[60 + i][1].split()
        for _ in range(pick.choice([1, 2, 4, 8, 16])):
            words[pick.randrange(len(words))] = pick.choice(["other", "changed"])
        rows.append((2000 + i, " ".join(words), "en", "s1", 0))
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = sorted(str(r[0]) for i, r in enumerate(rows) if least.get(find(i)) == r[0])
    got = CP.near_stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(str(r.doc_id) for r in got.collect()) == want
    near = sum(1 for i, r in enumerate(rows) if r[0] is not None and least[find(i)] != r[0] and r[0] >= 600)
    assert near >= 20
