import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from textlattice import cli
from textlattice.engine import Engine, register
from textlattice.functions import text as X
from textlattice.operators import align, lattice, transducer
from textlattice.operators.python_tokens import token_rows
from textlattice.plans import fixtures
from textlattice.sources import files
from textlattice.streaming import lattice as stream


def test_partition_is_lossless(spark):
    pick = random.Random(20)
    parts = ["сөз", "ab-cd", "a-1", "-x-", "‐", "–", " ", "\t\r\n", "\x1c", "\x85", "　", "é", "😀", "^$/<>{}[]@#*+\\", "12", "١٢", "\0", "—", "..", "ñ-ü-a", "́"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 25))) for _ in range(600)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = X.explode_tokens(docs)
    assert lattice.check_partition(t, docs).collect() == []
    rows = {}
    for r in t.orderBy("doc_id", "tok_idx").collect():
        rows.setdefault(r.doc_id, []).append((r.tok_idx, r.text, r.start, r.end))
    for i, x in enumerate(texts):
        assert rows.get(i, []) == list(token_rows(x or "")), repr(x)
    nested = docs.filter("text is not null").select("doc_id", X.with_offsets(X.tokens(F.col("text"))).alias("t"))
    for r in nested.limit(50).collect():
        assert [tuple(x) for x in r.t] == rows.get(r.doc_id, [])


def test_kinds(spark):
    want = {" \n": "space", "a1": "word", "12": "number", "…": "punct", "+": "symbol", "́": "symbol", "😀": "symbol", "½": "number"}
    d = spark.createDataFrame([(x,) for x in want], "s string").select("s", X.kind(F.col("s")).alias("k"))
    assert {r.s: r.k for r in d.collect()} == want


def test_bounds_are_checked(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for call in (lambda: X.whole_line_prefix(d, -1), lambda: X.line_chunks(F.col("text"), 0), lambda: lattice.generate(d, d, 0), lambda: files.sample(d, 0, "doc_id"), lambda: files.check_codec("base64_codec")):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(ValueError):
        Engine(spark, fixtures.lexicon(spark), ud_profile="other")
    with pytest.raises(ValueError):
        Engine(spark, fixtures.lexicon(spark), rules=[("SELECT", "n", [])], predictions=d)


def test_engine(spark):
    rel = spark.createDataFrame([("белгісіз", "белгі<n><nom>"), ("белгісіз", "белгісіз<adj>")], "surface string, raw string")
    docs = spark.createDataFrame([(1, "сәлем сөз белгісіз"), (2, ""), (3, None)], "doc_id long, text string")
    e = Engine(spark, fixtures.lexicon(spark), relation=rel, rules=[("SELECT", "ij", [])])
    t = {r.text: r for r in e.tokens(docs).collect()}
    assert t["сәлем"].selected == 1 and t["сөз"].selected is None
    assert [x.source for x in t["белгісіз"].readings] == ["guesser", "guesser"] and abs(sum(x.score for x in t["белгісіз"].readings) - 1) < 1e-9
    whole = e.documents(docs).collect()
    assert [len(r.tokens) for r in whole] == [5]
    register(spark)
    assert [r.text for r in spark.sql("SELECT text FROM tokenize('a b-c.') ORDER BY tok_idx").collect()] == ["a", " ", "b-c", "."]


def test_transducer_equals_recursive(spark):
    arcs, finals, words = fixtures._fst(spark)
    a = {(r.word, r.output) for r in transducer.lookup(words, arcs, finals).collect() if r.output is not None}
    assert a == {(r.word, r.outp) for r in transducer.lookup_sql(spark, words, arcs, finals).collect()}
    back = transducer.lookup(spark.createDataFrame([("ат",)], "word string"), arcs.withColumn("osym", F.when(F.length("osym") > 1, "").otherwise(F.col("osym"))), finals, invert=True)
    assert {r.output for r in back.collect()} >= {"ат"}


def test_alignment_cases():
    g = [(1, "екібол"), (2, "x")]
    assert align.align_sentence([(1, "екі"), (2, "бол")], ["екібол"], [(1, 2, "екібол")]) == [("match", 0, 2, 0, 1, "group")]
    assert [o[0] for o in align.align_sentence([(1, "екі"), (2, "бол")], ["екі", "бол"], [(1, 2, "екібол")])].count("match") == 1
    assert align.align_sentence(g, []) == [("skip_gold", 0, 1, 0, 0, ""), ("skip_gold", 1, 1, 0, 0, "")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("а\r\nб\rв\n".encode("cp1251"))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.txt").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.whole_texts(spark, str(tmp_path), "cp1251", "*.txt").collect()}
    assert got == {"a.txt": "а\r\nб\rв\n", "b.txt": "x"}
    assert {r.path: r.size for r in files.manifest(spark, str(tmp_path)).collect()} == {"a.txt": 7, "sub/b.txt": 1}
    d = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    assert files.version(d) == files.version(d.orderBy(F.desc("i"))) != files.version(d.limit(1))
    assert [r.surface for r in files.surface_inventory(spark.createDataFrame([("a b a",)], "text string")).orderBy("surface").collect()] == ["a", "b"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a b."), (2, "12")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    q = stream.token_kinds(stream.read_documents(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("kinds").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.doc_id, r.kind) for r in spark.table("kinds").collect()) == [(1, "punct"), (1, "space"), (1, "word"), (1, "word"), (2, "number")]


def test_cli_flags():
    for bad in (["-s"], ["-g"], ["--guess-limit", "0"], ["-e", "base64_codec"], ["-c", "-s", "--format", "json"]):
        with pytest.raises(SystemExit) as e:
            args = cli.parser().parse_args(bad)
            cli.check(args, cli.parser().error)
        assert e.value.code == 2


def test_library_imports_without_llm():
    code = "import sys; sys.modules['textlattice.llm'] = None; import textlattice.engine, textlattice.plans.corpus, textlattice.cli, textlattice.streaming.lattice"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_chunks_are_carried_between_batches(spark, tmp_path):
    src = str(tmp_path / "chunks")
    schema = "doc_id long, chunk_no int, text string, last boolean"
    spark.createDataFrame([(1, 0, "a", False), (2, 0, "x", True)], schema).coalesce(1).write.parquet(src)
    spark.createDataFrame([(1, 1, "b", True)], schema).coalesce(1).write.mode("append").parquet(src)
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream.carry_chunks(df).writeStream.format("memory").queryName("carried").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    assert q.awaitTermination(90)
    assert sorted((r.doc_id, r.text) for r in spark.table("carried").collect()) == [(1, "ab"), (2, "x")]


def test_publish(spark, tmp_path):
    d = spark.createDataFrame([(1, "a")], "i int, s string")
    digest = files.publish(d, str(tmp_path), "lexicon")
    assert (tmp_path / "lexicon.current").read_bytes() == digest.encode() and spark.read.parquet(str(tmp_path / digest)).collect() == d.collect()


def test_offsets_of_text_that_is_not_composed(spark):
    text = "a \u0438\u0306 b"
    docs = spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")
    rows = Engine(spark, fixtures.lexicon(spark)).tokens(docs).orderBy("doc_id", "tok_idx").collect()
    one = [r for r in rows if r.doc_id == 1]
    assert [(r.text, r.start, r.end) for r in one] == [("a", 0, 1), (" ", 1, 2), ("\u0438\u0306", 2, 4), (" ", 4, 5), ("b", 5, 6)]
    assert "".join(r.text for r in one) == text and [r.normalized for r in one] == [None, None, "\u0439", None, None]
    assert all(r.normalized is None for r in rows if r.doc_id == 2)


def test_multiword_alignment():
    from textlattice.operators.align import align_sentence

    gold = [(1, "x"), (2, "де"), (3, "не"), (4, "y")]
    assert align_sentence(gold, ["x", "деНЕ", "y"], [(2, 3, "дене")]) == [("match", 0, 1, 0, 1, "exact"), ("match", 1, 2, 1, 1, "group"), ("match", 3, 1, 2, 1, "exact")]
    assert align_sentence(gold, ["x", "де", "не", "y"], [(2, 3, "дене")])[1:3] == [("match", 1, 2, 1, 2, "group"), ("match", 3, 1, 3, 1, "exact")]
    cut = align_sentence(gold, ["x", "де", "z", "y"], [(2, 3, "дене")])
    assert sorted(op[0] for op in cut) == ["match", "match", "skip_gold", "skip_gold", "skip_predicted", "skip_predicted"]


def test_private_use_characters_and_output_bound(spark):
    from textlattice.functions import text as X
    from textlattice.operators import transducer as T
    from textlattice.sources import conllu as C

    df = spark.createDataFrame([("a\ue000|b\\|c\\\\|d",), ("x\\",), ("",), ("|",), ("\ue001\\s\\\\n",)], "x string")
    got = df.select(X.split_unescaped(F.col("x"), "|").alias("p"), C.spaces(F.col("x")).alias("s")).collect()
    assert [r.p for r in got] == [["a\ue000", "b\\|c\\\\", "d"], ["x\\"], [""], ["", ""], ["\ue001\\s\\\\n"]]
    assert [r.s for r in got] == ["a\ue000|b\\|c\\|d", "x\\", "", "|", "\ue001 \\n"]
    arcs = [(0, 0, "a", "b" * (T.OUTPUT // 2))]
    assert [T.Relation(arcs, [0]).lookup("a" * n)[1] for n in (2, 3)] == ["ok", "output bound"]


def test_documents_are_their_tokens_in_order(spark, monkeypatch):
    """Only distinct surfaces of a row meet their readings; before, every token did, and was gathered again."""
    e = Engine(spark, spark.createDataFrame([("the", 0, "the<det>"), ("café", 0, "café<n><nom>"), ("café", 1, "café<np>")], "surface string, cand_idx int, raw string"))
    docs = spark.createDataFrame([(1, "The the café, the café. 12 12"), (None, "a the"), (None, "a the"), (3, ""), (4, None)], "doc_id long, text string")
    rows = {}
    for r in e.tokens(docs).collect():
        rows.setdefault((r.doc_id, r.row_id), []).append((r.tok_idx, r.text, r.start, r.end, r.kind, r.sentence_end, r.normalized, r.selected, r.readings))
    seen, read = [], lattice.read_tokens
    monkeypatch.setattr(lattice, "read_tokens", lambda t, *a: (seen.append(t.count()), read(t, *a))[1])
    out = e.documents(docs)
    assert sorted((str(r.doc_id), [tuple(t) for t in r.tokens]) for r in out.collect()) == sorted((str(k), sorted(v)) for (k, _), v in rows.items())
    assert seen == [7 + 3 + 3]
