"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, encoding.

Every stage takes all its predecessor kept, and all but the last return the columns of
``documents``.  A stage's decisions are keyed by id and a hash of the text, so rows that repeat
with the same text share them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlattice.llm.bpe import encode_documents
from textlattice.llm.common import scratch, stored, without
from textlattice.llm.lines import line_dedup
from textlattice.llm.mixing import mix
from textlattice.llm.quality import quality_rules
from textlattice.llm.simhash import near_duplicates

#: Near-duplicates of the pipeline, as of op4: SimHash of four-word shingles, links at four bits or fewer.
SHINGLE, DISTANCE = 4, 4


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    verdict = quality_rules(docs)
    return without(docs, verdict.filter(~F.col("kept")).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("tag")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line keeps one occurrence; ``n_chars`` follows the text."""
    out = line_dedup(docs)
    return out.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text"))).select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of SimHash near-duplicates the document with the smallest id stays."""
    found = stored(near_duplicates(docs, DISTANCE, SHINGLE), scratch(spark), "near")
    return without(docs, found.filter(F.col("doc_id").isNull() & F.col("component").isNotNull() | (F.col("doc_id") != F.col("component"))).select(F.col("doc_id").alias("id"), "tag"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the raked marginals."""
    return mix(docs).filter("_sampled").select(docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    import public_tokenizers

    out = encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: SQL says neither components of near copies nor BPE; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else stored(out, folder, f"stage{k}")
    return docs
