"""The same column functions over streams: one row a document, so tokenizing keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlattice.functions import text as X


def read_documents(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Parquet documents as they arrive."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def token_kinds(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Token rows of a stream, with kind."""
    t = docs.select("doc_id", F.posexplode(X.tokens(F.col(text_col))).alias("tok_idx", "text"))
    return t.withColumn("kind", X.kind(F.col("text")))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window with a watermark (beyond the base feature set)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").count()


def carry_chunks(chunks: DataFrame) -> DataFrame:
    """Documents from ``chunks(doc_id, chunk_no, text, last)`` that may come in several batches: joined when the last has come."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, frames, state: GroupState):
        parts, ends = list(state.get) if state.exists else ([], [False])
        parts = list(parts)
        for f in frames:
            for r in f.itertuples():
                parts.append(f"{r.chunk_no:012d}{r.text}")
                ends = [ends[0] or bool(r.last)]
        if ends[0]:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"doc_id": [key[0]], "text": ["".join(p[12:] for p in sorted(parts))]})
        else:
            state.update((parts, ends))

    return chunks.groupBy("doc_id").applyInPandasWithState(run, "doc_id long, text string", "parts array<string>, ends array<boolean>", "append", GroupStateTimeout.NoTimeout)
