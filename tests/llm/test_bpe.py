import hashlib
import random

import public_tokenizers as P
from tokenizers import Tokenizer

from textlattice.llm.bpe import PrefixBpe, encode_documents

PATH = P.path("word_bpe_49k.json")


def test_ids_equal_the_library():
    own, lib = PrefixBpe(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)
    pick = random.Random(7)
    pool = "aaabthein' s'tn't.,!?0123 ½ÀéßΣςİıẞ한국글 áṇ̃́  \x1c\x85<|>/w😀中文日本​﻿\n\t"
    texts = ["".join(pick.choice(pool) for _ in range(pick.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(pick.choice("abaaatheing") for _ in range(pick.randint(1, 40))) for _ in range(3000)]
    texts += ["<|endoftext|>a<|startoftext|>b <|endoftext|", "ΑΣ ΑΣ.", "</w> <</w>>", "a" * 5000, "ab" * 3000, "hahaha" * 50, ""]
    for text in texts:
        ids, said = own.encode(text)
        want = lib.encode(text, add_special_tokens=False).ids
        assert list(ids) == want
        assert said == lib.decode(want, skip_special_tokens=False) == own.decode(ids)


def test_documents(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "the cat\nsat", "z"), (3, "the cat\nsat", "z"), (None, "a", "z"), (4, "thing " * 30000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("key", df_null())
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in encode_documents(df, PATH).collect()), key=lambda r: (r[0] or 0))
    lib = Tokenizer.from_file(PATH)
    assert len(got) == 6
    for (_, ids, said), text in zip(got, ["a", "", "", "the cat\nsat", "the cat\nsat", "thing " * 30000]):
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids == want and said == lib.decode(want, skip_special_tokens=False)
    assert encode_documents(df.limit(0), PATH).collect() == []


def df_null():
    from pyspark.sql import functions as F

    return F.lit(1)


def test_query(spark):
    from textlattice.llm.queries import op1_bpe

    lib = Tokenizer.from_file(PATH)
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        e = lib.encode(r.text or "", add_special_tokens=False)
        said = lib.decode(e.ids, skip_special_tokens=False)
        want[r.doc_id] = (len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in op1_bpe(spark, sf).collect()} == want
