"""Periodic runs of words: stretches that repeat themselves at least a few times.

A run of period ``q`` that is long enough holds an aligned block of ``2 ** k`` words and the same
block ``q`` words on, for the one scale ``k`` that fits ``q``.  So at every scale the aligned
blocks are searched through the text at once, occurrences at the scale's distances are seeds, and
a seed is extended word by word to both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FLUSH_BYTES

#: Words whose blocks one automaton holds (more at scales beyond it).
REGION = 1 << 13


def _least_factor(q: int) -> int:
    return next((d for d in range(2, int(q**0.5) + 1) if q % d == 0), q)


def _smallest(w: np.ndarray, start: int, q: int) -> bool:
    """Whether the ``q`` words from ``start`` are not themselves a repetition."""
    left = q
    while left > 1:
        r = _least_factor(left)
        while left % r == 0:
            left //= r
        d = q // r
        if np.array_equal(w[start : start + q - d], w[start + d : start + q]):
            return False
    return True


def _onward(w: np.ndarray, i: int, q: int) -> int:
    """The first place from ``i`` on whose word isn't that ``q`` words on."""
    step, last = 16, len(w) - q
    while i < last:
        m = min(step, last - i)
        odd = w[i : i + m] != w[i + q : i + q + m]
        if odd.any():
            return i + int(odd.argmax())
        i, step = i + m, step * 4
    return i


def _back(w: np.ndarray, i: int, q: int) -> int:
    """The first place of the words before ``i`` that all are the same ``q`` words on."""
    step = 16
    while i > 0:
        m = min(step, i)
        odd = (w[i - m : i] != w[i - m + q : i + q])[::-1]
        if odd.any():
            return i - int(odd.argmax())
        i, step = i - m, step * 4
    return i


def periodic_runs(w: np.ndarray, least: int, power: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every maximal stretch of ``w`` (non-negative whole numbers) that is
    ``least`` numbers or more and ``power`` (3 or more) or more times its smallest period, by start and period."""
    n, found = len(w), {}
    if n < max(least, power):
        return []
    # A run has each of its words `power` times.
    common = np.bincount(w)[w] >= power
    if not common.any():
        return []
    upto = np.append(0, np.cumsum(common))
    reach = np.zeros(n, np.int64)  # the furthest end of a run of a smaller scale over each place
    b = 1
    while True:
        near, far = -(-(2 * b - 1) // (power - 1)), -(-(4 * b - 1) // (power - 1)) - 1
        if power * near > n:
            break
        if near <= far:
            fresh = []
            held: dict[int, tuple[int, int]] = {}  # the last stretch of each distance
            size = max(REGION, 8 * b)
            for begin in range(0, n - b - near + 1, size):
                end = min(begin + size, n - b - near + 1)
                names: dict[tuple, int] = {}
                of_block: dict[int, int] = {}
                machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
                starts = np.arange(begin, end, b)  # `begin` is a multiple of b: both are powers of two
                for x in starts[upto[starts + b] - upto[starts] == b].tolist():
                    block = tuple(w[x : x + b].tolist())
                    name = names.get(block)
                    if name is None:
                        name = names[block] = len(names)
                        machine.add_word(block, name)
                    of_block[x] = name
                if not names:
                    continue
                machine.make_automaton()
                low, high = begin + near, min(n, end + far + b)
                for last, name in machine.iter(tuple(w[low:high].tolist())):
                    y = low + last - b + 1
                    for x in range(-(-max(y - far, begin) // b) * b, min(y - near, end - 1) + 1, b):
                        if of_block.get(x) != name:
                            continue
                        q = y - x
                        if reach[x] >= y + b:  # inside a run of a period that divides q
                            continue
                        was = held.get(q)
                        if was and was[0] <= x and y + b <= was[1]:
                            continue
                        first, stop = _back(w, x, q), _onward(w, x + b, q) + q
                        held[q] = first, stop
                        if stop - first >= max(least, power * q) and _smallest(w, first, q):
                            fresh.append((first, stop, q))
            for first, stop, q in fresh:
                found[first, q] = stop - first
                np.maximum(reach[first:stop], stop, out=reach[first:stop])
        b *= 2
    return sorted((s, length, q) for (s, q), length in found.items())


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period."""
    if not runs:
        return b" ".join(words)
    stay, at = [], 0
    for a, e in sorted((s + q, s + length) for s, length, q in runs):
        if a > at:
            stay.extend(words[at:a])
        at = max(at, e)
    return b" ".join(stay + words[at:])


def _scan(least: int, power: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            keys, texts, at = batch.column(0), batch.column(1), 0
            while at < batch.num_rows:
                start, n_words, runs, kept, size = at, [], [], [], 0
                while at < batch.num_rows and size < FLUSH_BYTES:
                    words = (texts[at].as_py() or b"").split()
                    name: dict[bytes, int] = {}
                    ids = np.fromiter((name.setdefault(x, len(name)) for x in words), np.int64, len(words))
                    found = periodic_runs(ids, least, power)
                    n_words.append(len(words))
                    runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                    kept.append(_collapsed(words, found))
                    size += len(kept[-1])
                    at += 1
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(start, at - start), pa.array(n_words, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], names=["key", "n_words", "runs", "kept"]
                )

    return run


def collapse_runs(docs: DataFrame, least: int = 6, power: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words``, ``runs`` (array of start, length and period, by start and period) and
    ``collapsed`` (the words that stay, joined by a space) of every whole text; no shuffle.

    Words are parted by ASCII white space.  A run is a stretch with smallest period ``q``, of at
    least ``least`` and ``power * q`` words (``power`` of 3 or more), that no word beside it
    extends; a word goes if a run holds it after the run's first ``q`` words.  A null or empty
    text has no words and no runs; rows that repeat are judged each; ids of any type, nulls
    too, are carried; other columns are not read, whatever their names; an empty table gives
    none.  Memory follows the longest text: its numbers, and an automaton of a region of it.
    """
    if power < 3:
        raise ValueError("power is 3 or more")
    narrow = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = narrow.mapInArrow(_scan(least, power), f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, kept binary")
    return out.select(F.col("key").alias(id_col), "n_words", "runs", F.col("kept").cast("string").alias("collapsed"))
