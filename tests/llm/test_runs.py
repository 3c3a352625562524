import random

import numpy as np
import pytest

from textlattice.llm import runs as R
from textlattice.llm.runs import collapse_runs, periodic_runs


def brute(w, least, power):
    n, out = len(w), set()
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, power * q) and not any(all(w[k] == w[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                out.add((i, length, q))
            i = j
    return sorted(out)


def drawn(pick):
    n = pick.randrange(1, 260)
    w = [pick.randrange(pick.choice([1, 2, 3, 8, 200])) for _ in range(n)]
    for _ in range(pick.randrange(4)):
        a, p = pick.randrange(n), pick.randrange(1, 40)
        for i in range(a + p, min(n, a + p * pick.randrange(2, 9) + pick.randrange(p))):
            w[i] = w[i - p]
    return w


@pytest.mark.parametrize("region", [1 << 13, 16])
def test_equals_brute_force(monkeypatch, region):
    monkeypatch.setattr(R, "REGION", region)
    pick = random.Random(11)
    for _ in range(700):
        w, (least, power) = drawn(pick), pick.choice([(6, 4), (6, 4), (1, 3), (20, 5)])
        assert periodic_runs(np.array(w), least, power) == brute(w, least, power), w


def test_nested_and_neighbouring_periods():
    assert periodic_runs(np.zeros(1000, int), 6, 4) == [(0, 1000, 1)]
    fibonacci = "a"
    last = "b"
    for _ in range(12):
        fibonacci, last = fibonacci + last, fibonacci
    for s in (fibonacci, "ab" * 9 + "aab" * 9, ("a" * 9 + "b") * 7, ("aaaab" * 5 + "c") * 6, ("a" * 30 + "x" + "a" * 31 + "y") * 5):
        w = [ord(c) for c in s]
        assert periodic_runs(np.array(w), 6, 4) == brute(w, 6, 4)


def test_long_text_of_one_word_and_of_a_long_period():
    pick = random.Random(1)
    unit = [pick.randrange(5) for _ in range(9000)]
    w = np.array(unit * 5 + unit[:17])
    assert (0, 45017, 9000) in periodic_runs(w, 6, 4)
    assert periodic_runs(np.zeros(60_000, int), 6, 4) == [(0, 60_000, 1)]


def test_documents(spark):
    pick = random.Random(4)
    rows = [(i, " ".join(f"wé{x}" for x in drawn(pick))) for i in range(120)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "x " * 50_000), (903, "x " * 50_000), (None, "a b " * 9), (904, "a\x1cb a\x1cb  a\x1cb\va\x1cb\fa\x1cb\ra\x1cb")]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, runs int")
    want = []
    for k, t in rows:
        words = __import__("re").findall(r"[^\x20\x09-\x0d]+", t or "")
        if len(words) > 1000:
            found = [(0, len(words), 1)]
        else:
            found = brute(words, 6, 4)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        want.append((k, len(words), found, " ".join(w for i, w in enumerate(words) if i not in gone)))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in collapse_runs(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert collapse_runs(df.limit(0)).collect() == []
    named = spark.createDataFrame([("k", "a b a b a b a b")], "doc_id string, text string")
    assert [(r.doc_id, r.collapsed) for r in collapse_runs(named).collect()] == [("k", "a b")]


def test_query_plants_and_reports(spark, tmp_path):
    import hashlib
    import zlib

    from textlattice.llm.queries import QUERIES

    pick = random.Random(5)
    rows = [(i, " ".join(pick.choice("abcdefghij") for _ in range(pick.choice([0, 1, 2, 5, 40, 90])))) for i in range(300)] + [(5000, None), (None, "a a a a a a a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for k, t in rows:
        w = (t or "").split()
        n = len(w)
        if k is not None:
            h = zlib.crc32(str(k).encode())
            g = h // 10
            if h % 10 == 0 and n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute(w, 6, 4)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None,) * 3
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((k, len(found), *best, best[1] * 1000 // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(kept)))
    got = [tuple(r) for r in QUERIES["op12_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[1] for r in want)
