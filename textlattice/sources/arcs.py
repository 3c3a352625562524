"""Transducers as binary blocks: a Python data source with partitioned reads, and a writer that commits all or nothing.

A resource is a folder of block files and a header.  A block holds a run of coded arcs: starts of
their states, targets, symbol numbers.  The header, written last and renamed into place, lists
blocks with their bytes, digests and bounds, the symbols and the final states; without it there
is no resource.  A read of a partition is one block: its length, digest, bounds and order are
checked before any row leaves it.  Paths are of a file system that driver and executors share.

    write(arcs, finals, path)                      # blocks by range of arcs
    read(spark, path)                              # arcs(src, dst, isym, osym), finals(state)
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "textlattice_arcs"
SCHEMA = "textlattice.arcs.v1"
HEADER = "header.json"
#: First bytes of a block, and the little-endian columns after them, in order: numbers of the source, the target and both symbols.
MAGIC = b"TLARCS01"
COLUMNS = (("src", "<u4"), ("dst", "<u4"), ("in_id", "<u4"), ("out_id", "<u4"))
ROW = "src int, dst int, isym string, osym string"
CODED = "arc long, src int, dst int, in_id int, out_id int"
FIELDS = {"schema", "states", "arcs", "start", "finals", "inputs", "outputs", "blocks", "epsilon_cycles"}
BLOCK_FIELDS = {"name", "arcs", "bytes", "sha256", "first_arc", "first_src", "last_src"}


def _local(path: str) -> str:
    """A path as the operating system knows it."""
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


class BadResource(ValueError):
    """What is wrong with a resource, said before any of its rows is read."""


def _need(ok: bool, problem: str) -> None:
    if not ok:
        raise BadResource(problem)


def header(path: str) -> dict:
    """The checked header of a resource."""
    name = os.path.join(_local(path), HEADER)
    _need(os.path.isfile(name), f"no header in {path}")
    with open(name, encoding="utf-8") as f:
        try:
            h = json.load(f)
        except ValueError as e:
            raise BadResource(f"header is not JSON: {e}") from e
    _need(isinstance(h, dict) and set(h) == FIELDS, "header has missing or unknown fields")
    _need(h["schema"] == SCHEMA, f"unknown schema {h['schema']!r}")
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 0
    _need(whole(h["states"]) and h["states"] > 0 and whole(h["arcs"]) and whole(h["start"]) and h["start"] < h["states"], "counts out of bounds")
    for side in ("inputs", "outputs"):
        s = h[side]
        _need(isinstance(s, list) and s[:1] == [""] and all(isinstance(x, str) for x in s) and len(set(s)) == len(s), f"{side} are no table of symbols")
    _need(all(len(x) == 1 for x in h["inputs"][1:]), "an input symbol is no single character")
    _need(h["epsilon_cycles"] is False, "input epsilons form cycles")
    f = h["finals"]
    _need(isinstance(f, list) and all(whole(x) and x < h["states"] for x in f) and sorted(set(f)) == f, "final states out of bounds or order")
    arcs = last = 0
    for b in h["blocks"]:
        _need(isinstance(b, dict) and set(b) == BLOCK_FIELDS, "a block has missing or unknown fields")
        _need(os.path.basename(b["name"]) == b["name"] and all(whole(b[k]) for k in BLOCK_FIELDS - {"name", "sha256"}), "a block is out of bounds")
        _need(b["first_arc"] == arcs and b["arcs"] > 0 and last <= b["first_src"] <= b["last_src"] < h["states"], f"block {b['name']} is out of order")
        _need(b["bytes"] == len(MAGIC) + 16 * b["arcs"], f"block {b['name']} has another length")
        arcs, last = arcs + b["arcs"], b["last_src"]
    _need(arcs == h["arcs"], "blocks don't add up to the arcs")
    return h


def decoded(path: str, block: dict, h: dict) -> dict[str, np.ndarray]:
    """The columns of a block, all of it checked."""
    with open(os.path.join(_local(path), block["name"]), "rb") as f:
        data = f.read(block["bytes"] + 1)
    _need(len(data) == block["bytes"], f"block {block['name']} is cut off or too long")
    _need(hashlib.sha256(data).hexdigest() == block["sha256"], f"block {block['name']} has another digest")
    _need(data[: len(MAGIC)] == MAGIC, f"block {block['name']} is of another kind")
    n, at, out = block["arcs"], len(MAGIC), {}
    for name, kind in COLUMNS:
        out[name] = np.frombuffer(data, kind, n, at)
        at += 4 * n
    src = out["src"]
    _need(bool((src[1:] >= src[:-1]).all()) and src[0] == block["first_src"] and src[-1] == block["last_src"], f"block {block['name']} is not in order")
    for name, bound in (("dst", h["states"]), ("in_id", len(h["inputs"])), ("out_id", len(h["outputs"]))):
        _need(bool((out[name] < bound).all()), f"{name} of block {block['name']} out of bounds")
    return out


class _Block(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.header = path, header(path)

    def partitions(self) -> list[InputPartition]:
        return [_Block(i) for i in range(len(self.header["blocks"]))]

    def read(self, partition: _Block) -> Iterator[pa.RecordBatch]:
        h = self.header
        if not h["blocks"]:
            return
        c = decoded(self.path, h["blocks"][partition.value], h)
        said = lambda side, ids: pa.array(h[side], pa.string()).take(pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c["src"].astype(np.int32)), pa.array(c["dst"].astype(np.int32)), said("inputs", c["in_id"]), said("outputs", c["out_id"])], names=["src", "dst", "isym", "osym"]
        )


class _Written(WriterCommitMessage):
    def __init__(self, blocks: list[dict]):
        self.blocks = blocks


class _Writer(DataSourceArrowWriter):
    """Tasks write blocks of their own names; the commit states them in a header, an abort leaves none."""

    def __init__(self, path: str, facts: str):
        self.path, self.facts = path, facts

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        folder, blocks = _local(self.path), []
        os.makedirs(folder, exist_ok=True)
        # A task's batches are runs of coded arcs in order; one that is empty writes nothing.
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {n: batch.column(n).to_numpy() for n in ("arc", *(n for n, _ in COLUMNS))}
            data = MAGIC + b"".join(c[n].astype(kind).tobytes() for n, kind in COLUMNS)
            name = f"block-{uuid.uuid4().hex}"
            with open(os.path.join(folder, f".{name}"), "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            os.replace(os.path.join(folder, f".{name}"), os.path.join(folder, name))
            blocks.append({"name": name, "arcs": batch.num_rows, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest(), "first_arc": int(c["arc"][0]), "first_src": int(c["src"][0]), "last_src": int(c["src"][-1])})
        return _Written(blocks)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        folder = _local(self.path)
        os.makedirs(folder, exist_ok=True)
        h = json.loads(self.facts)
        h["blocks"] = sorted((b for m in messages if m for b in m.blocks), key=lambda b: b["first_arc"])
        h["arcs"] = sum(b["arcs"] for b in h["blocks"])
        new = os.path.join(folder, f".{HEADER}.{uuid.uuid4().hex}")
        with open(new, "w", encoding="utf-8") as f:
            json.dump(h, f, ensure_ascii=False, sort_keys=True)
        os.replace(new, os.path.join(folder, HEADER))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            for b in m.blocks if m else ():
                os.unlink(os.path.join(_local(self.path), b["name"]))


class ArcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options["facts"])


def write(arcs: DataFrame, finals: DataFrame, path: str) -> None:
    """Writes ``arcs(src, dst, isym, osym)`` and ``finals(state)`` as a resource at a new ``path``.

    Symbols and final states, which a reader holds whole, are collected: a transducer's alphabet
    and its accepting states.  Arcs whose input epsilons form cycles are refused.
    """
    from textlattice.operators import transducer as D

    spark = arcs.sparkSession
    spark.dataSource.register(ArcSource)
    _need(not os.path.exists(os.path.join(_local(path), HEADER)), f"{path} has a resource")
    _need(D.epsilon_cycles(arcs).isEmpty(), "input epsilons form cycles")
    coded, symbols = D.coded(arcs)
    table = {side: [r.symbol for r in symbols.filter(F.col("side") == side).orderBy("id").collect()] for side in ("i", "o")}
    accepting = sorted({r.state for r in finals.select("state").collect()})
    top = arcs.agg(F.max(F.greatest("src", "dst"))).first()[0]
    states = max([top if top is not None else 0, *accepting]) + 1
    facts = {"schema": SCHEMA, "states": states, "start": 0, "finals": accepting, "inputs": table["i"], "outputs": table["o"], "epsilon_cycles": False}
    ordered = coded.select(*(F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in CODED.split(", "))).repartitionByRange("arc").sortWithinPartitions("arc")
    ordered.write.format(NAME).mode("append").option("path", path).option("facts", json.dumps(facts)).save()


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(arcs, finals)`` of a resource; BadResource if its header or, once read, a block is not sound."""
    h = header(path)
    spark.dataSource.register(ArcSource)
    finals = spark.range(1).select(F.explode(F.array(*map(F.lit, h["finals"])) if h["finals"] else F.array().cast("array<int>")).alias("state"))
    return spark.read.format(NAME).option("path", path).load(), finals
