import random

import xxhash

from textlattice.llm import simhash
from textlattice.llm.simhash import near_duplicates


def brute(rows, d, width):
    fps = []
    for _, text in rows:
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))]
        sh = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= d:
                root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            groups[find(i)] = min(groups.get(find(i), k), k)
    return sorted(((k, f, groups.get(find(i))) for i, ((k, _), f) in enumerate(zip(rows, fps))), key=str)


def test_components_equal_brute_force(spark):
    pick = random.Random(3)
    words = [f"w{i}É" for i in range(40)]
    rows, base = [], [" ".join(pick.choice(words) for _ in range(80)) for _ in range(25)]
    for i in range(260):
        t = pick.choice(base).split()
        for _ in range(pick.choice([0, 0, 1, 1, 2, 5])):
            t[pick.randrange(len(t))] = pick.choice(words)
        rows.append((i, " ".join(t)))
    rows += [(1000, None), (1001, ""), (1002, "  \n"), (1003, "Ab\x1ccd e"), (1003, "Ab\x1ccd e"), (None, "solitary text"), (1005, "x y z " * 20000)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, component int")
    for d in (4, 3):
        got = sorted(((r.doc_id, r.fp % (1 << 64), r[3]) for r in near_duplicates(df, d, 4).collect()), key=str)
        assert got == brute(rows, d, 4)
    assert near_duplicates(df.limit(0)).collect() == []


def test_the_index_is_not_broadcast(spark, monkeypatch):
    plans, join = {}, simhash.components

    def seen(edges, folder, tag):
        plans[tag] = edges._jdf.queryExecution().executedPlan().toString()
        return join(edges, folder, tag)

    monkeypatch.setattr(simhash, "components", seen)
    assert near_duplicates(spark.createDataFrame([(1, "a b c d e"), (2, "f g h i j")], "doc_id long, text string")).count() == 2
    assert "SortMergeJoin" in plans["rest"] and "Broadcast" not in plans["rest"]
