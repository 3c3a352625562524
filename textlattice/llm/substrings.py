"""Removal of byte strings that repeat across documents, exact at any position.

A column-wise construction of a collection's Burrows-Wheeler transform inserts one symbol of
every document each round and rewrites the whole transform, so its rounds are as many as the
longest document has bytes (over 10^5 here).  That does not end in any useful time on whole
documents, so another method is used (see README): strings of ``width`` bytes are dealt out by
their minimizer, and every bucket is settled exactly for itself.

1.  Every window of ``width`` bytes has a minimizer, the least hash of the ``GRAM``-byte strings
    in it.  Consecutive windows with one minimizer are a run.  A scan sends, packed per bucket,
    the minimizers of each document (5 bytes of hash); those seen in one document only are done.
2.  The runs of the others are cut out, strings equal within a batch are settled at once and sent
    once, and each bucket gives every window the least document id that has it.
3.  The spans come back to their documents by id.

Equal windows have equal minimizers, so each meets all its equals in one bucket.  What a passage
that stands in every document costs is one string a batch and bucket, not one a document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, stored, tasks

GRAM = 20
#: Bytes of text that are worked on at once, and of input for each bucket.
BATCH_BYTES, BUCKET_BYTES = 2 << 20, 2 << 20
#: Most windows of a run.  Longer runs (periodic text) are cut.
RUN = 256
#: Stands for "several documents of this batch".
MANY = np.uint32(0xFFFFFFFF)

_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def gram_hashes(data: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A polynomial hash of every ``width``-byte string, put together from powers of two."""
    base, part, size, out, done = _BASE[which], _BYTES[which][data], 1, None, 0
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    while True:
        if width & size:
            piece = part[done : done + n]
            out = piece.copy() if out is None else out * _power(base, size) + piece
            done += size
        if done == width:
            break
        part = part[:-size] * _power(base, size) + part[size:]
        size *= 2
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, size = len(x) - width + 1, 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def runs(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, minimizer and document of each run; ``ends`` are the ends of the documents in ``data``."""
    empty = np.empty(0, np.int64)
    if len(data) < width:
        return empty, empty, np.empty(0, np.uint64), empty
    least = sliding_min(gram_hashes(data, GRAM), width - GRAM + 1)
    at = np.arange(len(least))
    doc = np.searchsorted(ends, at, "right")
    inside = at + width <= ends[doc]
    first = np.empty(len(least), bool)
    first[0] = True
    first[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(first & inside)
    if not len(starts):
        return empty, empty, np.empty(0, np.uint64), empty
    stop = np.flatnonzero(first | ~inside)
    last = np.append(stop, len(least))[np.searchsorted(stop, starts, "right")]
    size = last - starts
    if size.max() > RUN:
        starts, size = _cut(starts, size)
    return starts, size, least[starts], doc[starts]


def _cut(starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs over RUN windows in pieces; every window keeps its run's minimizer, so any cut is right."""
    a, b = [], []
    for s, n in zip(starts.tolist(), size.tolist()):
        for x in range(0, n, RUN):
            a.append(s + x)
            b.append(min(RUN, n - x))
    return np.array(a), np.array(b)


def _batches(batches: Iterator[pa.RecordBatch], use=lambda row: True) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Rows under ``use``, about BATCH_BYTES at a time: their records without text, all bytes, the documents' ends."""
    keep, parts, size = [], [], 0

    def done():
        return keep, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts], dtype=np.int64)

    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            for row in batch.slice(i, 64).to_pylist():
                if not use(row):
                    continue
                text = (row.pop("text") or "").encode("utf-8", "replace")
                keep.append(row)
                parts.append(text)
                size += len(text)
                if size >= BATCH_BYTES:
                    yield done()
                    keep, parts, size = [], [], 0
    if keep:
        yield done()


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte planes apart so that sorted values compress."""
    planes = [c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(widths), [], 0
    for k, w in zip(kinds, widths):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).reshape(-1).view(k))
        at += n * w
    return out


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(bucket[part[0]]), part


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


SENT = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("batch", pa.string()), ("blob", pa.binary())])
FLAGS = pa.schema([("batch", pa.string()), ("kind", pa.int32()), ("blob", pa.binary())])
WANTED = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("wanted", pa.binary())])
CUT = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("id", pa.int64()), ("tag", pa.int64()), ("blob", pa.binary())])
SPANS = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("blob", pa.binary())])
LOW = np.uint64((1 << 40) - 1)


def _send_minimizers(width: int, n_buckets: int):
    """Kind 0: a bucket's (hash, document of the batch); 1: pairs known to repeat within the batch; 2: the batch's documents.

    Kinds 1 and 2 take any bucket and pass through it.  A batch is named by its task and turn,
    which a repeated task gives again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn = TaskContext.get().partitionId(), 0
        for keep, data, ends in _batches(batches):
            _, _, least, doc = runs(data, ends, width)
            turn += 1
            if not len(least):
                continue
            name, out = f"{task}-{turn}", []
            through = zlib.crc32(name.encode()) % n_buckets
            order = np.lexsort((doc, least))
            least, doc = least[order], doc[order]
            new = np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]
            least, doc = least[new], doc[new].astype(np.uint32)
            head = np.r_[True, least[1:] != least[:-1]]
            group = np.cumsum(head) - 1
            many = np.bincount(group)[group] > 1
            if many.any():
                out.append((1, through, name, _pack(doc[many], least[many] & LOW)))
            sent, who = least[head], np.where(many[head], MANY, doc[head])
            low = sent & LOW
            for bucket, part in _by_bucket((sent >> np.uint64(40)) % np.uint64(n_buckets)):
                part = part[np.argsort(low[part])]
                out.append((0, bucket, name, _pack(who[part], low[part])))
            ids = np.array([(r["id"], r["tag"]) for r in keep], np.int64)
            out.append((2, through, name, _pack(ids[:, 0].copy(), ids[:, 1].copy())))
            yield _table(out, SENT)

    return run


def _repeated(group: pa.Table) -> pa.Table:
    """For a bucket: each batch's documents with the minimizers that another document has too."""
    every = list(zip(*(group.column(n).to_pylist() for n in ("kind", "batch", "blob"))))
    through = [(name, kind, blob) for kind, name, blob in every if kind]
    names = [name for kind, name, _ in every if not kind]
    parts = [_unpack(blob, "u4", "u8") for kind, _, blob in every if not kind]
    if not parts:
        return pa.Table.from_batches([_table(through, FLAGS)])
    doc = np.concatenate([p[0] for p in parts])
    least = np.concatenate([p[1] for p in parts])
    src = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.argsort(least, kind="stable")
    doc, least, src = doc[order], least[order], src[order]
    group_of = np.cumsum(np.r_[True, least[1:] != least[:-1]]) - 1
    twice = (np.bincount(group_of, weights=np.where(doc == MANY, 2, 1))[group_of] > 1) & (doc != MANY)
    doc, least, src = doc[twice], least[twice], src[twice]
    out = [(names[s], 1, _pack(doc[part], least[part])) for s, part in _by_bucket(src)]
    return pa.Table.from_batches([_table(through + out, FLAGS)])


def _to_documents(group: pa.Table) -> pa.Table:
    """For a batch: each of its documents with its wanted minimizers."""
    kinds, blobs = group.column("kind").to_pylist(), group.column("blob").to_pylist()
    ids = [_unpack(b, "i8", "i8") for k, b in zip(kinds, blobs) if k == 2]
    parts = [_unpack(b, "u4", "u8") for k, b in zip(kinds, blobs) if k == 1]
    if not ids or not parts:
        return pa.Table.from_batches([], WANTED)
    doc, least = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    out = [(int(ids[0][0][d]), int(ids[0][1][d]), np.unique(least[part]).tobytes()) for d, part in _by_bucket(doc.astype(np.int64))]
    return pa.Table.from_batches([_table(out, WANTED)])


def _spans(starts: np.ndarray, size: np.ndarray, width: int) -> bytes:
    return np.stack([starts, starts + size + width - 1], 1).astype(np.int64).tobytes()


def _cut_strings(width: int, n_buckets: int):
    """Kind 0: a bucket's strings, each with the least document of the batch that has it; 1: spans settled within the batch, which pass through any bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keep, data, ends in _batches(batches, lambda row: row["wanted"]):
            starts, size, least, doc = runs(data, ends, width)
            if not len(starts):
                continue
            low, good = least & LOW, np.zeros(len(starts), bool)
            edge = np.searchsorted(doc, np.arange(len(keep) + 1))
            for i, row in enumerate(keep):
                a, b = edge[i], edge[i + 1]
                if b > a and row["wanted"]:
                    good[a:b] = np.isin(low[a:b], np.concatenate([np.frombuffer(x, np.uint64) for x in row["wanted"]]))
            starts, size, least, doc = starts[good], size[good], least[good], doc[good]
            ids = np.array([r["id"] for r in keep], np.int64)
            raw, begin = data.tobytes(), np.r_[0, ends[:-1]]
            owner: dict[bytes, int] = {}
            strings = [raw[s : s + n + width - 1] for s, n in zip(starts.tolist(), size.tolist())]
            mine = ids[doc] if len(doc) else np.empty(0, np.int64)
            for text, d in zip(strings, mine.tolist()):
                if owner.setdefault(text, d) > d:
                    owner[text] = d
            low_id = np.fromiter((owner[t] for t in strings), np.int64, len(strings))
            local, out = mine > low_id, []
            for d, part in _by_bucket(doc[local]):
                s = starts[local][part] - begin[d]
                out.append((1, abs(keep[d]["tag"]) % n_buckets, int(ids[d]), keep[d]["tag"], _spans(s, size[local][part], width)))
            far = np.flatnonzero(~local)
            tags = np.array([r["tag"] for r in keep], np.int64)
            for bucket, part in _by_bucket(((least[far] >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64)):
                at = far[part]
                head = _pack(ids[doc[at]], tags[doc[at]], (starts[at] - begin[doc[at]]).astype(np.int64), size[at].astype(np.int32))
                body = zstandard.ZstdCompressor(level=1).compress(b"".join([strings[i] for i in at.tolist()]))
                out.append((0, bucket, None, None, len(head).to_bytes(4, "little") + head + body))
            yield _table(out, CUT)

    return run


def _settle(width: int):
    """For a bucket: the windows of each string that a document with a smaller id has, as spans."""

    def run(group: pa.Table) -> pa.Table:
        heads, texts, through = [], [], []
        for kind, id_, tag, blob in zip(*(group.column(c).to_pylist() for c in ("kind", "id", "tag", "blob"))):
            if kind:
                through.append((id_, tag, blob))
                continue
            n = int.from_bytes(blob[:4], "little")
            heads.append(_unpack(blob[4 : 4 + n], "i8", "i8", "i8", "i4"))
            texts.append(zstandard.ZstdDecompressor().decompress(blob[4 + n :]))
        if not heads:
            return pa.Table.from_batches([_table(through, SPANS)])
        ids, tags, starts, size = (np.concatenate([h[k] for h in heads]) for k in range(4))
        size = size.astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        length = size + width - 1
        begin = np.cumsum(length) - length
        item = np.repeat(np.arange(len(size)), size)
        offset = np.arange(len(item)) - np.repeat(np.cumsum(size) - size, size)
        at = begin[item] + offset
        one, two = gram_hashes(data, width, 0)[at], gram_hashes(data, width, 1)[at]
        who = ids[item]
        order = np.lexsort((who, two, one))
        a, b = one[order], two[order]
        head = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        least = who[order][np.flatnonzero(head)[np.cumsum(head) - 1]]
        gone = np.zeros(len(item), bool)
        gone[order] = who[order] > least
        first = gone & np.r_[True, (item[1:] != item[:-1]) | ~gone[:-1]]
        last = gone & np.r_[(item[1:] != item[:-1]) | ~gone[1:], True]
        f, e = np.flatnonzero(first), np.flatnonzero(last)
        s, t = starts[item[f]] + offset[f], starts[item[f]] + offset[e] + width
        key = np.stack([ids[item[f]], tags[item[f]]], 1)
        out = []
        if len(f):
            order = np.lexsort((key[:, 1], key[:, 0]))
            cut = np.flatnonzero((np.diff(key[order], axis=0) != 0).any(1)) + 1
            spans = np.stack([s, t], 1)
            out = [(int(key[p[0], 0]), int(key[p[0], 1]), spans[p].tobytes()) for p in np.split(order, cut)]
        return pa.Table.from_batches([_table(through + out, SPANS)])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges each document's spans and cuts them out."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            first, kept, gone, size = at, [], [], 0
            while at < batch.num_rows and size < BATCH_BYTES:
                text = (batch.column("text")[at].as_py() or "").encode("utf-8", "replace")
                blobs, merged, rest, done = batch.column("spans")[at].as_py() or (), [], [], 0
                if blobs:
                    for s, e in sorted(map(tuple, np.concatenate([np.frombuffer(x, np.int64) for x in blobs]).reshape(-1, 2).tolist())):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(e, merged[-1][1])
                        else:
                            merged.append([s, e])
                for s, e in merged:
                    rest.append(text[done:s])
                    done = e
                kept.append(b"".join([*rest, text[done:]]) if merged else text)
                gone.append([{"start": s, "end": e} for s, e in merged])
                size += len(text)
                at += 1
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, at - first), pa.array(gone, kind), pa.array(kept, pa.binary())], names=["id", "spans", "kept"])


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans array<struct<start,end>>, kept binary)`` of every row; ``width`` from GRAM + 1.

    A byte goes if a ``width``-byte string over it also starts in a document with a smaller id.
    Matches lie within documents and are judged on the input.  A null text is empty; rows with a
    null id keep all and count for none; rows that share an id are no smaller than each other;
    other columns are not read; an empty table gives no rows.
    """
    if width <= GRAM:
        raise ValueError(f"width must be over {GRAM}")
    spark = docs.sparkSession
    folder = scratch(spark)
    text = F.col(text_col)
    all_rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tag"), text.alias("text"))
    usable = all_rows.filter(F.col("id").isNotNull() & (F.octet_length("text") >= width))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n_buckets = max(tasks(spark), min(size, 1 << 50) // BUCKET_BYTES)
    ddl = lambda s: T.StructType.fromDDL(", ".join(f"{f.name} {'binary' if pa.types.is_binary(f.type) else 'string' if pa.types.is_string(f.type) else 'int' if f.type == pa.int32() else 'long'}" for f in s))
    sent = usable.mapInArrow(_send_minimizers(width, n_buckets), ddl(SENT))
    flags = sent.groupBy("bucket").applyInArrow(_repeated, ddl(FLAGS))
    wanted = flags.groupBy("batch").applyInArrow(_to_documents, ddl(WANTED)).groupBy("id", "tag").agg(F.collect_list("wanted").alias("wanted"))
    wanted = stored(wanted, folder, "wanted")
    # Outer joins on both sides: the shuffled documents are then one exchange, used twice.
    cut = all_rows.join(wanted, ["id", "tag"], "left").select("id", "tag", "text", "wanted").mapInArrow(_cut_strings(width, n_buckets), ddl(CUT))
    spans = cut.groupBy("bucket").applyInArrow(_settle(width), ddl(SPANS))
    spans = spans.groupBy("id", "tag").agg(F.collect_list("blob").alias("spans"))
    out = all_rows.join(spans, ["id", "tag"], "left").select("id", "text", "spans")
    return out.mapInArrow(_remove, "id long, spans array<struct<start: long, end: long>>, kept binary").withColumnRenamed("id", id_col)
