import random

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline as CP
from textlattice.llm import quality as Q
from textlattice.llm.quality import quality_rules

from .test_lines import brute as brute_lines
from .test_quality import brute as brute_stats
from .test_simhash import brute as brute_near


def corpus():
    pick = random.Random(11)
    vocabulary = ["w" + "".join(pick.choice("abcdefghé") for _ in range(pick.randint(1, 9))) for _ in range(900)]
    prose = lambda n: "\n".join(" ".join(pick.choice(vocabulary) for _ in range(14)) for _ in range(n // 14))
    rows = [(i, prose(pick.choice([40, 100, 300, 900])), pick.choice(["en", "fr"]), f"s{i % 3}", 0) for i in range(260)]
    rows += [(500 + i, rows[i][1], "en", "s0", 0) for i in range(12)]
    for i in range(12):
        words = rows[20 + i][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((600 + i, " ".join(words), "en", "s1", 0))
    rows += [(700 + i, " ".join(w + "%%%" for w in prose(200).split()), "en", "s0", 0) for i in range(6)]
    rows += [(800, None, "en", "s0", None), (801, "", None, None, 0), (None, prose(100), "en", "s2", 0), (802, prose(20000), "en", "s2", 0)]
    return [(k, t, lang, s, len(t) if t is not None else None) for k, t, lang, s, _ in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_outliers(rows):
    """The determinant estimates in NumPy, row by row."""
    vec, groups = {}, {}
    for at, (k, text, lang, source, _) in enumerate(rows):
        n, chars, symbols, dup, rep, failed = brute_stats(text)
        lines = sum(1 for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c"))
        m = max(n, 1)
        x = (np.log1p(n), chars / m, np.log1p(100 * symbols / m), np.log1p(100 * dup / max(lines, 1)), np.log1p(100 * rep / m))
        vec[at] = np.floor(np.array(x) * 1000 + 0.5) / 1000
        if not failed:
            groups.setdefault((lang, source), []).append(at)
    def floored(c):
        c = np.array(c, float)
        np.fill_diagonal(c, np.maximum(np.diag(c), [s * s for _, s in Q.FEATURES]))
        return c

    d2 = lambda x, m, c: float((x - m) @ np.linalg.solve(c, x - m))
    out = set()
    for key, at in groups.items():
        x = np.array([vec[i] for i in at])
        quart = np.percentile(x, [25, 50, 75], axis=0)
        starts = [(quart[1], floored(np.diag(((quart[2] - quart[0]) / 1.349) ** 2))), (x.mean(0), floored(np.cov(x.T, bias=True).reshape(5, 5)))]
        ends = []
        for m, c in starts:
            for _ in range(4):
                level = np.array([np.floor(Q.LEVELS * np.log2(1 + d2(v, m, c))) for v in x])
                cut = np.sort(level)[int(np.ceil(Q.SHARE * len(x))) - 1]
                near = x[level <= cut]
                m, c = near.mean(0), floored(Q.CONSISTENCY * np.cov(near.T, bias=True).reshape(5, 5))
            ends.append((np.linalg.slogdet(c)[1], len(ends), m, c))
        _, _, m, c = min(ends)
        for i, v in zip(at, x):
            if d2(v, m, c) > Q.CUT and (any(v[j] > m[j] for j in (2, 3, 4)) or abs(v[1] - m[1]) > 3):
                out.add(i)
    return out


def test_quality_stage_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    gone = brute_outliers(rows)
    want = sorted((r for i, r in enumerate(rows) if i not in gone and not brute_stats(r[1])[5]), key=str)
    got = CP.quality_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert len(gone) >= 6 and quality_rules(docs).count() == len(rows)


def test_line_stage_equals_brute_force(spark):
    rows = corpus()[::3]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = CP.line_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute_lines([r[:2] for r in rows])
    assert all(r.n_chars == len(r.text) for r in got.collect() if r.text is not None)


def test_near_stage_is_simhash(spark):
    rows = corpus()[:40] + corpus()[260:]
    # Two words in a hundred: five-word shingle sets of similarity 0.8 or more, fingerprints more than four bits apart.
    pick = random.Random(5)
    for i in range(8):
        words = [f"v{pick.randrange(5000)}" for _ in range(104)]
        near = ["new" if k in (30, 70) else w for k, w in enumerate(words)]
        rows += [(900 + 2 * i + k, " ".join(w), "en", "s0", 0) for k, w in enumerate((words, near))]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = CP.near_stage(spark, docs, "")
    component = {k: c for k, _, c in brute_near([r[:2] for r in rows], 4, 4)}
    want = {r[0] for r in rows if component[r[0]] is None or component[r[0]] == r[0]}
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == want and len(want) < len(rows) - 8
    assert sum(900 + 2 * i + 1 in want for i in range(8)) >= 4


def test_mixing_stage(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = CP.mixing_stage(spark, docs, "")
    assert got.columns == docs.columns
    kept, every = {str(tuple(r)) for r in got.collect()}, {str(r) for r in rows}
    assert kept < every and len(kept) > 0.3 * len(every)


def test_encoding_stage_equals_the_library(spark):
    rows = corpus()[:60]
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.ids, r.n_tokens) for r in CP.encoding_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    for k, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[k] == (ids, len(ids))


def test_empty_and_whole(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    for _, stage in CP.STAGES:
        assert stage(spark, docs.limit(0), "").collect() == []
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = CP.run(spark, str(tmp_path)).collect()
    assert out and all(r.n_tokens == len(r.ids) for r in out)
