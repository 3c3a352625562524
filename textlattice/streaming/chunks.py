"""Texts that arrive as chunks of bytes: put in order, decoded strictly, acknowledged, capped, cancelled.

Chunks of one text may come in any order and in any batch.  State is a text's decoded parts as a
list, so a chunk is appended and not rewritten; chunks that came early wait in a map.  The state
store must have list and map state (RocksDB); see ``with_states``.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: UTF-16 units of a text.
MOST_IN = 4 << 20
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "id string, event string, chunk_no long, units long, text string, message string"
COLUMNS = [c.split()[0] for c in EVENT.split(", ")]
OPEN, DONE = "open", "done"


@contextmanager
def with_states(spark: SparkSession) -> Iterator[None]:
    """The state store that ``join_chunks`` needs, set while a query starts."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) + sum(c > "￿" for c in text)


class Joiner(StatefulProcessor):
    """State of one text: what is next, its parts, the bytes of a character that is not whole, chunks that came early."""

    def __init__(self, most: int, patience_ms: int | None):
        self.most, self.patience_ms = most, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "status string, next long, units long, rest binary")
        self.parts = handle.getListState("parts", "text string")
        self.early = handle.getMapState("early", "chunk_no long", "content binary, last boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.at.get() if self.at.exists() else (OPEN, 0, 0, b"")
        status, expected, n, rest = at[0], int(at[1]), int(at[2]), bytes(at[3] or b"")
        out: list[tuple] = []
        say = lambda event, no=None, text=None, message=None: out.append((key[0], event, no, n, text, message))
        for frame in rows:
            for r in frame.sort_values("chunk_no").itertuples():
                no = int(r.chunk_no)
                if status == DONE:
                    say("late", no)
                elif r.cancel is True or r.cancel == 1:
                    say("cancelled", no)
                    status = DONE
                elif no < expected or self.early.containsKey((no,)):
                    say("repeated", no)
                else:
                    self.early.updateValue((no,), (bytes(r.content or b""), bool(r.last)))
        while status == OPEN and self.early.containsKey((expected,)):
            content, last = self.early.getValue((expected,))
            self.early.removeKey((expected,))
            decoder = codecs.getincrementaldecoder("utf-8")("strict")
            try:
                text = decoder.decode(rest + bytes(content), bool(last))
            except UnicodeDecodeError as e:
                say("error", expected, message=f"not UTF-8: {e.reason}")
                status = DONE
                break
            rest = decoder.getstate()[0]
            n += units(text)
            if n > self.most:
                say("error", expected, message=f"over {self.most} units")
                status = DONE
                break
            if text:
                self.parts.appendValue((text,))
            say("acknowledged", expected)
            expected += 1
            if last:
                say("text", text="".join(p[0] for p in self.parts.get()) if self.parts.exists() else "")
                status = DONE
        self._keep(status, expected, n, rest, timerValues)
        if out:
            yield pd.DataFrame(out, columns=COLUMNS).astype({"chunk_no": "Int64", "units": "int64"})

    def _keep(self, status: str, expected: int, n: int, rest: bytes, timerValues) -> None:
        if status == DONE:  # a word stays, so that what comes late is known for it
            self.parts.clear()
            self.early.clear()
            rest = b""
        self.at.update((status, expected, n, rest))
        if self.patience_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(int(t[0]) if isinstance(t, tuple) else int(t))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing came in time: an open text is given up, the word of a finished one is forgotten."""
        at = self.at.get() if self.at.exists() else None
        for s in (self.at, self.parts, self.early):
            s.clear()
        if at is not None and at[0] == OPEN:
            yield pd.DataFrame([(key[0], "expired", None, int(at[2]), None, None)], columns=COLUMNS).astype({"chunk_no": "Int64", "units": "int64"})

    def close(self) -> None:
        pass


def join_chunks(chunks: DataFrame, most: int = MOST_IN, patience_ms: int | None = None) -> DataFrame:
    """Events of ``chunks(id, chunk_no, content binary, last, cancel)``, a stream; chunks count from 0.

    ``acknowledged`` for every chunk that is decoded, in order; ``text`` with the whole text after the
    one marked ``last``; ``error`` (bytes that are not UTF-8, over ``most`` UTF-16 units),
    ``cancelled`` and ``expired`` (nothing for ``patience_ms``) end a text.  A chunk that is there
    already is ``repeated``, one of a text that has ended ``late``; neither changes anything, so a
    sender may send again.  Rows with a null id or number are left out; null content is empty, null
    flags are false.  Without ``patience_ms`` a word for each text that has ended stays in the state.
    """
    rows = chunks.filter("id is not null and chunk_no is not null").selectExpr(
        "cast(id as string) id", "cast(chunk_no as long) chunk_no", "content", "coalesce(last, false) last", "coalesce(cancel, false) cancel"
    )
    mode = "None" if patience_ms is None else "ProcessingTime"
    return rows.groupBy("id").transformWithStateInPandas(statefulProcessor=Joiner(most, patience_ms), outputStructType=EVENT, outputMode="Append", timeMode=mode)
