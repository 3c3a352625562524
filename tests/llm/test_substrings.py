import random

from textlattice.llm.substrings import remove_repeats


def brute(rows, w):
    texts = [(k, (t or "").encode()) for k, t in rows]
    least = {}
    for k, b in texts:
        if k is not None:
            for i in range(len(b) - w + 1):
                s = b[i : i + w]
                least[s] = min(least.get(s, k), k)
    out = []
    for k, b in texts:
        gone = bytearray(len(b))
        if k is not None:
            for i in range(len(b) - w + 1):
                if least[b[i : i + w]] < k:
                    gone[i : i + w] = b"\1" * w
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((k, bytes(c for c, g in zip(b, gone) if not g), spans))
    return sorted(out, key=str)


def test_equals_brute_force(spark, monkeypatch):
    pick = random.Random(5)
    word = lambda: "".join(pick.choice("abcdeé") for _ in range(pick.randint(1, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(pick.randint(8, 40)) for _ in range(12)]
    rows = []
    for i in range(200):
        parts = [line(pick.randint(0, 30)) for _ in range(3)] + [pick.choice(shared)[pick.randint(0, 20) :] for _ in range(pick.randint(0, 2))]
        pick.shuffle(parts)
        rows.append((i, pick.choice(["", " "]).join(parts)))
    rows += [(300 + i, rows[i][1]) for i in range(20)] + [(400, None), (401, ""), (402, "a" * 3000), (403, "x" + "a" * 700), (404, "ab" * 900), (405, "ab" * 300 + "c" + "ba" * 300)]
    rows += [(5, "other " + shared[0]), (500, rows[3][1]), (500, rows[3][1]), (None, rows[0][1]), (None, None), (600, line(30000)), (-3, shared[1] * 2)]
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, tag int").repartition(5)
    for w in (50, 21, 64):
        got = sorted(((r.doc_id, bytes(r.kept), len(r.spans)) for r in remove_repeats(df, w).collect()), key=str)
        assert got == brute(rows, w), w
    assert remove_repeats(df.limit(0)).collect() == []
