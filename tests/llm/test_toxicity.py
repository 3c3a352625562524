import random

import numpy as np
from pyspark.sql import functions as F

from textlattice.llm.toxicity import Examples, _vocabulary, toxicity


def test_block_max_equals_brute_force():
    pick = random.Random(1)
    vectors = []
    for _ in range(700):
        raw = {t: pick.random() for t in pick.sample(range(30), pick.randint(0, 5))}
        size = sum(w * w for w in raw.values()) ** 0.5
        vectors.append({t: w / size for t, w in raw.items()})
    index = Examples(list(range(700)), vectors, [0] * 700)
    for v in vectors[:60]:
        want = sorted((-round(sum(w * vectors[i].get(t, 0) for t, w in v.items()), 9), at) for at, i in enumerate(index.ids))
        got = index.nearest(v, 9)
        assert [(-round(c, 9), i) for c, i in got] == [x for x in want if x[0] < 0][:9]


def test_scores(spark):
    pick = random.Random(2)
    plain, bad = [f"word{i}" for i in range(300)], ["idiotx", "scumx", "moronx"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 9 == 0
        words = [pick.choice(plain) for _ in range(60)] + (pick.sample(bad, 2) if toxic else [])
        pick.shuffle(words)
        rows.append((i, " ".join(words), 1))
        labels.append((i, int(toxic), 0))
    rows += [(5000, None, 1), (5001, "", 1), (5001, "", 1), (None, "scumx moronx", 1), (5002, "w " * 100000, 1)]
    labels += [(5, 1, 0), (None, 1, 0), (7, None, 0), (9999, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    out = toxicity(docs, marks, F.col("doc_id") % 5 != 0).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    for r in out:
        want = r.doc_id is None or r.doc_id < 900 and r.doc_id % 9 == 0
        assert (r.score >= 0.5) == want, r
        assert r.evidence_ids or not want
    assert toxicity(docs.limit(0), marks, F.lit(True)).collect() == []
    bare = toxicity(docs, marks.limit(0), F.lit(True)).collect()
    assert len({r.score for r in bare}) == 1 and np.isclose(bare[0].score, 0.5)


def test_terms_of_low_ratio_are_kept(spark):
    rows = [(1, f"only{i} " + ("half" if i % 2 else "")) for i in range(200)] + [(0, f"other{i} " + ("" if i % 4 else "half")) for i in range(400)]
    assert _vocabulary(spark.createDataFrame(rows, "label int, text string")) .keys() == {"half"}
