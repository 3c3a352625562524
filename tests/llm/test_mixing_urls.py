import hashlib

import duckdb
import pytest

from textlattice.llm.mixing import mix
from textlattice.llm.queries import ORACLES, QUERIES
from textlattice.llm.urls import judge_urls


def rows_of(df):
    return sorted((tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    at = [columns.index(c) for c in sorted(columns)]
    assert rows_of(got) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


def test_mix_edges(spark):
    rows = [(i, "word wordyword another longerword" * (1 + i % 5), "en" if i % 3 else None, None if i % 7 == 0 else f"s{i % 2}", "x") for i in range(300)]
    rows += [(1000, None, "en", "s0", "x"), (1001, "", None, None, "x"), (1001, "", None, None, "x"), (None, "some text", "en", "s0", "x"), (1002, "longwords " * 50000, "en", "s1", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    out = mix(df)
    got = out.collect()
    assert len(got) == len(rows) and set(df.columns) <= set(out.columns)
    by = {r.doc_id: r for r in got}
    assert by[1000]._sampled and by[1001]._sampled and by[1001]._topic == "none"
    total = sum(r._tokens for r in got)
    assert abs(sum(r._p * r._tokens for r in got) / total - 0.5) < 1e-6
    for r in got:
        u = int(hashlib.md5(f"{r.doc_id}:17".encode() if r.doc_id is not None else b"17").hexdigest()[:8], 16) / 2**32
        assert r._sampled == (u < r._p)
    assert mix(df.limit(0)).collect() == []
    salted = mix(df, broadcast_cells=0)
    assert sorted((str(r.doc_id), r._p) for r in salted.collect()) == sorted((str(r.doc_id), r._p) for r in got)


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/1", "https://a.org", "https://a.org?x=/", "http://b.com/de/x#y", "http://xorg/", "http://org/", "x://y://z/w", "http://é.com/fr/ü\n/z", "http://b.com/" + "a/" * 5000]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls + urls[4:5])], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df).collect()}
    assert len(got) == len(urls) + 1
    assert got[0][:3] == got[1][:3] == got[2][:3] == got[3][:3] == ("", "", None)
    assert got[4] == got[len(urls)] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[5][:3] == ("a.org", "", None) and got[6][:3] == ("a.org", "", None)
    assert got[7] == ("b.com", "/de/x", "com/de/", "block") and got[8][:3] == ("xorg", "/", None) and got[9] == ("org", "/", "org/", "allow")
    assert got[10][:2] == ("y:", "//z/w") and got[11] == ("é.com", "/fr/ü\n/z", "com/fr/", "allow")
    assert all(v[3] in ("allow", "block") for v in got.values())
    assert judge_urls(df.limit(0)).collect() == []


def test_targets_and_clashing_names(spark):
    rows = [(i, "alpha beta gamma delta epsilon " * 4, "web" if i % 3 else "books", "en" if i % 4 else "de", i % 2, 1, 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, theme int, _source int, _salt int")
    out = mix(docs, targets={"lang": {"en": 1.0}, "topic": {"0": 0.25, "1": 0.75}}, topic_col="theme")
    assert set(out.columns) == {*docs.columns, "_tokens", "_topic", "_weight", "_p", "_sampled"}
    got = out.collect()
    assert all(r._source == 1 and r._salt == 2 and (r._p == 0) == (r.lang == "de") for r in got)
    # What the draw is expected to keep has the marginals asked for.
    kept = lambda f: sum(r._p * r._tokens for r in got if f(r))
    assert abs(kept(lambda r: r.theme == 1) / kept(lambda r: True) - 0.75) < 0.12 or max(r._p for r in got) == 1
    mass = lambda f: sum(r._weight * r._tokens for r in got if f(r))
    assert abs(mass(lambda r: r.theme == 1) / mass(lambda r: True) - 0.75) < 1e-6
