"""Case fold of every code point, sentinels of odd texts, messages on what XML forbids."""

import pytest
from pyspark.sql import functions as F

from textlattice.functions import text as X
from textlattice.operators import align, guess


def test_fold_of_all_code_points(spark):
    points = spark.range(1, 0x20000).filter("id < 55296 or id >= 57344").selectExpr("cast(id as int) id")
    # Neighbours, so that place decides nothing but for sigma.
    x = F.decode(F.encode(F.decode(F.to_binary(F.lpad(F.hex("id"), 8, "0"), F.lit("hex")), "UTF-32"), "UTF-8"), "UTF-8")
    rows = points.select(x.alias("x"), X.casefold(x).alias("f")).collect()
    wrong = [r for r in rows if r.f != r.x.casefold()]
    # Pairs that the JVM knows and this Python's tables do not have yet.
    assert all(r.x.casefold() == r.x == r.x.lower() and r.f == r.f.casefold() for r in wrong) and len(wrong) < 100
    assert len(rows) > 120_000


@pytest.mark.parametrize("word", ["Straße", "ΑΣ", "ΑΣΑΣ ΣΑΣ", "ﬁx", "ǰ", "ΐ", "ᾈ", "Ꭰꭰ", "ϐ", "İi", "ŉx", "ẞß", ""])
def test_fold_of_words(spark, word):
    got = spark.createDataFrame([(word,)], "x string").select(X.casefold(F.col("x")).alias("f"), X.alignment_key(F.col("x")).alias("k")).first()
    assert got.f == word.casefold()
    assert got.k == align.key(word)


def test_sentinels(spark):
    texts = ["", None, "plain", X.PROTECTED, "a\0b\rc<d>", X.PRIVATE[0] + "<" + X.PRIVATE[5] + "\0" + X.PRIVATE[0], "".join(X.PRIVATE) + "<", "".join(X.PRIVATE[: -len(X.PROTECTED)]) + X.PROTECTED]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").withColumn("h", X.hide(F.col("x")))
    rows = d.select("i", "x", "h", X.reveal(F.col("h")).alias("back")).orderBy("i").collect()
    for r in rows:
        if r.x is None or r.i == 6:  # null, and no sentinel is free
            assert r.h is None and r.back is None
        else:
            assert r.back == r.x
            assert not set(X.PROTECTED) & set(r.h.text) and len(set(r.h.code)) == len(X.PROTECTED) and not set(r.h.code) & set(r.x)
    with pytest.raises(ValueError):
        X.hide(F.col("x"), "aa")


def test_xml_messages(spark):
    rows = [("ok", None), ("a\x01b", "f: U+0001 at 1 cannot be in XML 1.0"), ("￾", "f: U+FFFE at 0 cannot be in XML 1.0"), ("😀\x1f", "f: U+001F at 1 cannot be in XML 1.0"), (None, None), ("", None)]
    got = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "i int, x string").select("i", X.xml_error(F.col("x"), "f").alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == [m for _, m in rows]
    assert X.xml_declaration("UTF-8") == '<?xml version="1.0" encoding="UTF-8"?>'
    for name in ("", "8bit", "a b", 'a"'):
        with pytest.raises(ValueError):
            X.xml_declaration(name)


def test_outcomes(spark):
    s = spark.createDataFrame([("алма",), ("алма",), ("hello",), ("бала",), (None,)], "surface string")
    rel = spark.createDataFrame([("алма", "алма<n><nom>"), ("алма", "алма<n><nom>"), ("алма", "ал<v><tv><imp><p2><sg>"), ("бала", "к<n><nom>")], "surface string, raw string")
    got = {r.surface: (r.outcome, r.n_raw, r.n_guesses) for r in guess.outcomes(s, rel).collect()}
    assert got["алма"] == ("guessed", 2, 2) and got["hello"] == ("not eligible", 0, 0) and got["бала"] == ("rejected", 1, 0)
