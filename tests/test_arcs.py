import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from textlattice.operators import transducer as D
from textlattice.sources import arcs as S


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    words = [(f"w{i}ж", "<n>") for i in range(300)] + [("w1", "<v>")]
    a, f = D.compile_words(spark.createDataFrame(words, "word string, tail string"))
    path = str(tmp_path_factory.mktemp("arcs") / "resource")
    S.write(a, f, path)
    return a, f, path


def test_round_trip(spark, made):
    a, f, path = made
    back, finals = S.read(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, a.select("src", "dst", "isym", "osym").collect())) and finals.collect() == f.collect()
    assert back.rdd.getNumPartitions() == len(S.header(path)["blocks"]) >= 1
    found = D.lookup(spark.createDataFrame([("w7ж",), ("w1",), ("w",)], "word string"), back, finals)
    assert sorted((r.word, r.output) for r in found.collect() if r.output) == [("w1", "w1<v>"), ("w7ж", "w7ж<n>")]
    with pytest.raises(S.BadResource):
        S.write(a, f, path)


def damaged(path, tmp_path, name):
    folder = str(tmp_path / name)
    shutil.copytree(path, folder)
    return folder


HEADERS = {
    "field": lambda h: h.pop("start"), "more": lambda h: h.update(extra=1), "schema": lambda h: h.update(schema="x"), "states": lambda h: h.update(states=0), "start": lambda h: h.update(start=10**9), "bool": lambda h: h.update(arcs=True),
    "epsilon": lambda h: h["inputs"].__setitem__(0, "a"), "twice": lambda h: h["outputs"].append(h["outputs"][1]), "long": lambda h: h["inputs"].append("ab"), "cycle": lambda h: h.update(epsilon_cycles=True),
    "final": lambda h: h.update(finals=[10**9]), "order": lambda h: h.update(finals=[2, 1]), "count": lambda h: h.update(arcs=h["arcs"] + 1), "block": lambda h: h["blocks"][0].pop("sha256"), "place": lambda h: h["blocks"][0].update(first_arc=5),
    "name": lambda h: h["blocks"][0].update(name="../x"), "bytes": lambda h: h["blocks"][0].update(bytes=7),
}


@pytest.mark.parametrize("name", HEADERS)
def test_damaged_headers_are_rejected(spark, made, tmp_path, name):
    folder = damaged(made[2], tmp_path, name)
    h = json.load(open(f"{folder}/{S.HEADER}"))
    HEADERS[name](h)
    json.dump(h, open(f"{folder}/{S.HEADER}", "w"))
    with pytest.raises(S.BadResource):
        S.read(spark, folder)


@pytest.mark.parametrize("name", ["cut", "long", "byte", "gone", "json"])
def test_damaged_blocks_give_no_rows(spark, made, tmp_path, name):
    folder = damaged(made[2], tmp_path, name)
    block = f"{folder}/{S.header(folder)['blocks'][0]['name']}"
    data = open(block, "rb").read()
    if name == "json":
        open(f"{folder}/{S.HEADER}", "w").write("{")
    elif name == "gone":
        os.unlink(f"{folder}/{S.HEADER}")
    else:
        open(block, "wb").write({"cut": data[:-1], "long": data + b"x", "byte": data[:20] + bytes([data[20] ^ 1]) + data[21:]}[name])
    with pytest.raises(Exception, match="cut off|digest|header"):
        S.read(spark, folder)[0].collect()


def test_bounds_are_checked_behind_a_right_digest(spark, made, tmp_path):
    import hashlib

    folder = damaged(made[2], tmp_path, "bounds")
    h = S.header(folder)
    b = h["blocks"][0]
    data = bytearray(open(f"{folder}/{b['name']}", "rb").read())
    at = len(S.MAGIC) + 4 * b["arcs"]
    data[at : at + 4] = b"\xff\xff\xff\x7f"
    open(f"{folder}/{b['name']}", "wb").write(data)
    b["sha256"] = hashlib.sha256(data).hexdigest()
    json.dump(h, open(f"{folder}/{S.HEADER}", "w"))
    with pytest.raises(Exception, match="out of bounds"):
        S.read(spark, folder)[0].collect()


def test_cycles_are_refused_and_a_failed_write_leaves_no_header(spark, tmp_path):
    arcs = spark.createDataFrame([(0, 1, "", "x"), (1, 0, "", "y")], S.ROW)
    with pytest.raises(S.BadResource):
        S.write(arcs, spark.createDataFrame([(1,)], "state int"), str(tmp_path / "c"))
    bad = spark.range(4).select(F.col("id").alias("arc"), F.raise_error(F.lit("task fails")).cast("int").alias("src"), F.lit(0).alias("dst"), F.lit(0).alias("in_id"), F.lit(0).alias("out_id"))
    spark.dataSource.register(S.ArcSource)
    with pytest.raises(Exception, match="task fails"):
        bad.write.format(S.NAME).mode("append").option("path", str(tmp_path / "d")).option("facts", "{}").save()
    assert not os.path.exists(tmp_path / "d" / S.HEADER)
