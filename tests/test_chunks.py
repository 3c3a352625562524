"""Chunks of bytes over a stream: order, characters over borders, caps, errors, cancellation, restarts."""

from textlattice.streaming.chunks import EVENT, join_chunks, with_states

CHUNK = "id string, chunk_no long, content binary, last boolean, cancel boolean"


def drive(spark, tmp, batches, **options):
    """The events after each batch; each batch is a run of its own from the checkpoint."""
    for b in batches:
        spark.createDataFrame(b, CHUNK).coalesce(1).write.mode("append").parquet(f"{tmp}/in")
        with with_states(spark):
            q = join_chunks(spark.readStream.schema(CHUNK).parquet(f"{tmp}/in"), **options)
            q.writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/state").trigger(availableNow=True).start().awaitTermination()
        yield {(r.id, r.event, r.chunk_no, r.text or r.message) for r in spark.read.parquet(f"{tmp}/out").collect()}


def test_restart_and_order(spark, tmp_path):
    word = "сөз 😀".encode()
    a, b, c = word[:3], word[3:9], word[9:]
    runs = list(drive(spark, tmp_path, [
        [("x", 2, c, True, None), ("x", 0, a, None, False), (None, 0, a, True, None), ("e", 0, None, True, None)],
        [("x", 0, a, None, None), ("x", 1, b, None, None)],
        [("x", 1, b, None, None)],
    ]))
    assert runs[0] == {("x", "acknowledged", 0, None), ("e", "acknowledged", 0, None), ("e", "text", None, None)}
    assert runs[1] - runs[0] == {("x", "repeated", 0, None), ("x", "acknowledged", 1, None), ("x", "acknowledged", 2, None), ("x", "text", None, word.decode())}
    assert runs[2] - runs[1] == {("x", "late", 1, None)}


def test_errors_caps_and_cancel(spark, tmp_path):
    runs = list(drive(spark, tmp_path, [
        [("cut", 0, "ж".encode()[:1], True, None), ("bad", 0, b"a\xff", None, None), ("big", 0, "😀😀".encode(), None, None), ("gone", 0, b"a", None, None)],
        [("big", 1, b"xy", None, None), ("gone", 1, b"b", True, True), ("bad", 1, b"b", True, None)],
    ], most=5))
    events = {(i, e) for i, e, _, _ in runs[1]}
    assert events == {("cut", "error"), ("bad", "error"), ("bad", "late"), ("big", "acknowledged"), ("big", "error"), ("gone", "acknowledged"), ("gone", "cancelled")}
    assert ("big", "error", 1, "over 5 units") in runs[1]


def test_open_texts_expire(spark, tmp_path):
    import time

    spark.createDataFrame([("slow", 0, b"a", None, None), ("done", 0, b"b", True, None)], CHUNK).coalesce(1).write.parquet(f"{tmp_path}/in")
    with with_states(spark):
        events = join_chunks(spark.readStream.schema(CHUNK).parquet(f"{tmp_path}/in"), patience_ms=500)
        # Timers ask for batches without data, so such a query is stopped and does not end by itself.
        q = events.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    seen, until = set(), time.time() + 40
    try:
        while ("slow", "expired") not in seen and time.time() < until:
            time.sleep(1)
            if q.lastProgress is not None:
                seen = {(r.id, r.event) for r in spark.read.schema(EVENT).parquet(f"{tmp_path}/out").collect()}
    finally:
        q.stop()
    assert seen == {("slow", "acknowledged"), ("slow", "expired"), ("done", "acknowledged"), ("done", "text")}
