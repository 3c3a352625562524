"""Finite transducers as arc tables: lookup, generation, graph checks.

``arcs(src, dst, isym, osym)`` with '' for epsilon, ``finals(state)``, start state 0.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlattice.operators.numbering import numbered, running_sum
from textlattice.plans.session import shared_folder

#: Bounds of a lookup: input characters, candidates, steps, output characters.
LONGEST, CANDIDATES, STEPS, OUTPUT = 256, 512, 250_000, 4096

#: Arcs up to which a transducer is broadcast (some 100 bytes each).
FEW_ARCS = 1_000_000

#: Frontier join of words and arcs; ``{level}`` rounds at most.  Spark and DuckDB both run it.
LOOKUP_SQL = """
WITH RECURSIVE walk(word, state, pos, outp) AS (
  SELECT word, 0, 0, CAST('' AS {string}) FROM words
  UNION ALL
  SELECT w.word, a.dst, w.pos + CASE WHEN a.isym = '' THEN 0 ELSE 1 END, CAST(concat(w.outp, a.osym) AS {string})
  FROM walk w JOIN arcs a ON a.src = w.state AND (a.isym = '' OR a.isym = substring(w.word, w.pos + 1, 1))
)
SELECT DISTINCT word, outp FROM walk JOIN finals ON walk.state = finals.state WHERE pos = length(word)
"""


class Relation:
    """Arcs by source and input, with symbol ids for the order of outputs."""

    def __init__(self, arcs: list[tuple[int, int, str, str]], finals: list[int]):
        self.by: dict[tuple[int, str], list[tuple[int, str]]] = defaultdict(list)
        for s, d, i, o in arcs:
            self.by[s, i].append((d, o))
        self.finals = set(finals)
        self.symbols = {a[2] for a in arcs}
        self.ids = {s: n for n, s in enumerate(sorted({a[3] for a in arcs}))}

    def lookup(self, word: str) -> tuple[list[str], str]:
        """Distinct outputs by the ids of their symbols, and ``ok`` or the bound that stopped the search."""
        if len(word) > LONGEST:
            return [], "input bound"
        if any(c not in self.symbols for c in word):
            return [], "unknown symbol"
        found: set[tuple[str, ...]] = set()
        stack: list[tuple[int, int, tuple[str, ...], int]] = [(0, 0, (), 0)]
        steps = 0
        while stack:
            state, at, out, said = stack.pop()
            steps += 1
            if steps > STEPS:
                return [], "step bound"
            if at == len(word) and state in self.finals:
                found.add(tuple(s for s in out if s))
                if len(found) > CANDIDATES:
                    return [], "candidate bound"
            for sym, move in ((("", 0), (word[at], 1)) if at < len(word) else (("", 0),)):
                for dst, o in self.by.get((state, sym), ()):
                    if said + len(o) > OUTPUT:
                        return [], "output bound"
                    stack.append((dst, at + move, (*out, o), said + len(o)))
        ordered = sorted(found, key=lambda v: [self.ids[s] for s in v])
        return ["".join(v) for v in ordered], "ok"


def lookup(words: DataFrame, arcs: DataFrame, finals: DataFrame, invert: bool = False, col: str = "word") -> DataFrame:
    """``(word, cand_idx, output, status)``: ordered outputs of distinct words; a row with null output if there are none.

    A transducer counted to have at most FEW_ARCS arcs is broadcast; a larger one meets the words
    in joins (``lookup_joined``).  Input epsilon arcs must not form cycles (``epsilon_cycles``).
    """
    spark = words.sparkSession
    if arcs.count() > FEW_ARCS:
        turned = arcs.select("src", "dst", F.col("osym").alias("isym"), F.col("isym").alias("osym")) if invert else arcs
        return lookup_joined(words, turned, finals, col)
    rows = [(r.src, r.dst, r.osym, r.isym) if invert else (r.src, r.dst, r.isym, r.osym) for r in arcs.select("src", "dst", "isym", "osym").collect()]
    held = spark.sparkContext.broadcast((rows, [r.state for r in finals.select("state").collect()]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        relation = Relation(*held.value)
        for batch in batches:
            out = []
            for word in batch["word"]:
                found, status = relation.lookup(word)
                out += [(word, i, x, status) for i, x in enumerate(found)] or [(word, None, None, status)]
            yield pd.DataFrame(out, columns=["word", "cand_idx", "output", "status"]).astype({"cand_idx": "Int32"})

    return words.select(F.col(col).alias("word")).distinct().mapInPandas(run, "word string, cand_idx int, output string, status string")


def lookup_joined(words: DataFrame, arcs: DataFrame, finals: DataFrame, col: str = "word") -> DataFrame:
    """``lookup`` as rounds of joins: partial paths of all words meet the arcs by state and symbol.

    A round is a written table and reads one symbol at most, so there are as many as the longest
    word and its epsilon arcs.  A word stops at the round that takes it beyond STEPS.
    """
    spark = words.sparkSession
    folder = f"{shared_folder(spark)}/paths-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    symbols = arcs.select(F.col("osym").alias("sym")).distinct()
    ids = stored(numbered(symbols, ["sym"], "oid"), "symbols")
    a = stored(arcs.join(ids, arcs["osym"] == ids["sym"]).select("src", "dst", F.col("isym").alias("_isym"), F.struct("oid", "osym").alias("_o")), "arcs")
    known = arcs.select(F.col("isym").alias("sym")).distinct()
    asked = words.select(F.col(col).alias("word")).distinct().filter("word is not null")
    letters = asked.filter(F.length("word") <= LONGEST).select("word", F.explode(F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0))).alias("sym"))
    odd = letters.join(known, "sym", "left_anti").select("word").distinct().withColumn("status", F.lit("unknown symbol"))
    odd = odd.unionByName(asked.filter(F.length("word") > LONGEST).select("word", F.lit("input bound").alias("status")))
    stopped = stored(odd, "stopped")
    none = F.array().cast("array<struct<oid: bigint, osym: string>>")
    front = stored(asked.join(stopped, "word", "left_anti").select("word", F.lit(0).alias("state"), F.lit(0).alias("pos"), F.lit(0).alias("said"), none.alias("out")), "front-0")
    steps, fronts, turn = front.select("word", F.lit(0).cast("long").alias("n")).limit(0), [front], 0
    while not fronts[-1].isEmpty():
        turn += 1
        front = fronts[-1]
        steps = stored(steps.unionByName(front.groupBy("word").agg(F.count("*").alias("n"))).groupBy("word").agg(F.sum("n").alias("n")), f"steps-{turn}")
        live = front.join(steps.filter(F.col("n") > STEPS).select("word"), "word", "left_anti")
        sym = F.explode(F.when(F.col("pos") < F.length("word"), F.array(F.lit(""), F.substring("word", F.col("pos") + 1, F.lit(1)))).otherwise(F.array(F.lit(""))))
        step = live.withColumn("sym", sym).join(a, (F.col("state") == F.col("src")) & (F.col("sym") == F.col("_isym")))
        fronts.append(stored(step.select(
            "word", F.col("dst").cast("int").alias("state"), (F.col("pos") + F.length("sym")).alias("pos"), (F.col("said") + F.length("_o.osym")).alias("said"),
            F.when(F.col("_o.osym") == "", F.col("out")).otherwise(F.concat("out", F.array("_o"))).alias("out"),
        ).filter(F.col("said") <= OUTPUT + 1), f"front-{turn}"))
    every = fronts[0]
    for front in fronts[1:]:
        every = every.unionByName(front)
    over = steps.filter(F.col("n") > STEPS).select("word", F.lit("step bound").alias("status"))
    long = every.filter(F.col("said") > OUTPUT).select("word", F.lit("output bound").alias("status")).distinct()
    done = every.filter(F.col("pos") == F.length("word")).join(F.broadcast(finals) if finals.count() <= FEW_ARCS else finals, "state", "left_semi").select("word", "out").distinct()
    many = done.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") > CANDIDATES).select("word", F.lit("candidate bound").alias("status"))
    status = stopped.unionByName(over).unionByName(long).unionByName(many).groupBy("word").agg(F.min("status").alias("status"))
    order = Window.partitionBy("word").orderBy("_ids")
    done = done.join(status, "word", "left_anti").withColumn("_ids", F.transform("out", lambda o: o["oid"]))
    done = done.select("word", (F.row_number().over(order) - 1).alias("cand_idx"), F.array_join(F.transform("out", lambda o: o["osym"]), "").alias("output"))
    return asked.join(status, "word", "left").join(done, "word", "left").select("word", "cand_idx", "output", F.coalesce("status", F.lit("ok")).alias("status"))


def compile_words(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(arcs, finals)`` of a trie of ``words(word, tail)``: a word reads as itself and then says its tail.

    States are the prefixes in order, the empty one 0, and a last one that accepts.
    """
    spark = words.sparkSession
    path = f"{shared_folder(spark)}/trie-{uuid.uuid4().hex}"
    some = words.filter(F.col("word") != "").select("word", "tail").distinct()
    prefix = some.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("word")), lambda k: F.substring("word", F.lit(1), k))).alias("prefix")).distinct()
    numbered(prefix, ["prefix"], "state").write.parquet(path)
    states = spark.read.schema("prefix string, state long").parquet(path)
    n = states.count()
    child = states.filter("prefix <> ''").select(F.col("state").alias("dst"), F.left("prefix", F.length("prefix") - 1).alias("prefix"), F.right("prefix", F.lit(1)).alias("sym"))
    inner = child.join(states, "prefix").select(F.col("state").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), F.col("sym").alias("isym"), F.col("sym").alias("osym"))
    last = some.join(states, F.col("word") == F.col("prefix")).select(F.col("state").cast("int").alias("src"), F.lit(n).cast("int").alias("dst"), F.lit("").alias("isym"), F.col("tail").alias("osym"))
    return inner.unionByName(last), spark.range(1).select(F.lit(n).cast("int").alias("state"))


def lookup_sql(spark: SparkSession, words: DataFrame, arcs: DataFrame, finals: DataFrame) -> DataFrame:
    """The same relation as a recursive query, without order or bounds."""
    for name, df in (("words", words), ("arcs", arcs), ("finals", finals)):
        df.createOrReplaceTempView(name)
    return spark.sql(LOOKUP_SQL.format(string="STRING"))


def _one_task(edges: DataFrame, run, ddl: str) -> DataFrame:
    """``run`` over all of ``edges``, which have been counted to be at most FEW_ARCS, as two arrays in one task."""
    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        every = pd.concat(parts) if parts else pd.DataFrame({"src": [], "dst": []})
        yield pd.DataFrame({"state": run(every["src"].to_numpy("int64"), every["dst"].to_numpy("int64"))}).astype({"state": "int32"})

    return edges.select("src", "dst").coalesce(1).mapInPandas(whole, ddl)


def _reached(src, dst) -> list[int]:
    near = defaultdict(list)
    for a, b in zip(src.tolist(), dst.tolist()):
        near[a].append(b)
    seen, todo = {0}, [0]
    while todo:
        for b in near[todo.pop()]:
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return sorted(seen)


def _cyclic(src, dst) -> list[int]:
    """Nodes of strongly connected components with an edge inside: depth-first orders forwards, then components backwards."""
    near, back = defaultdict(list), defaultdict(list)
    for a, b in zip(src.tolist(), dst.tolist()):
        near[a].append(b)
        back[b].append(a)
    left, order = set(), []
    for root in list(near):
        todo = [(root, iter(near[root]))] if root not in left else []
        left.add(root)
        while todo:
            node, rest = todo[-1]
            fresh = next((b for b in rest if b not in left), None)
            if fresh is None:
                order.append(node)
                todo.pop()
            else:
                left.add(fresh)
                todo.append((fresh, iter(near[fresh] if fresh in near else ())))
    taken, out = set(), []
    for root in reversed(order):
        if root in taken:
            continue
        group, todo = [], [root]
        taken.add(root)
        while todo:
            node = todo.pop()
            group.append(node)
            for a in back.get(node, ()):
                if a not in taken:
                    taken.add(a)
                    todo.append(a)
        if len(group) > 1 or group[0] in near.get(group[0], ()):
            out += group
    return sorted(out)


def reachable(arcs: DataFrame) -> DataFrame:
    """``(state)`` reachable from 0: in one task where the arcs are counted to be few, else a frontier that stops growing."""
    if arcs.count() <= FEW_ARCS:
        return _one_task(arcs, _reached, "state int")
    seen = arcs.sparkSession.createDataFrame([(0,)], "state int")
    n = 1
    while True:
        seen = seen.union(seen.join(arcs, seen["state"] == arcs["src"]).select(F.col("dst").alias("state"))).distinct().checkpoint()
        m = seen.count()
        if m == n:
            return seen
        n = m


def epsilon_cycles(arcs: DataFrame) -> DataFrame:
    """``(state)`` reachable states that come back to themselves over input epsilons.

    Epsilon arcs counted to be few are searched for components in one task, however deep.  More are
    trimmed of states without arcs in or out; a colour, the greatest state that reaches it, goes round
    until it rests, and what reaches its colour's state within the colour is its component.
    """
    shared_folder(arcs.sparkSession)
    edges = arcs.filter("isym = ''").select("src", "dst").distinct().join(reachable(arcs), F.col("src") == F.col("state"), "left_semi").checkpoint()
    if edges.count() <= FEW_ARCS:
        return _one_task(edges, _cyclic, "state int")
    found = edges.select(F.col("src").alias("state")).limit(0)
    while not edges.isEmpty():
        while True:
            n = edges.count()
            core = edges.select(F.col("dst").alias("s")).distinct().join(edges.select(F.col("src").alias("s")).distinct(), "s")
            edges = edges.join(core.withColumnRenamed("s", "src"), "src", "left_semi").join(core.withColumnRenamed("s", "dst"), "dst", "left_semi").checkpoint()
            if edges.count() == n:
                break
        colour = edges.select(F.col("src").alias("v")).distinct().withColumn("c", F.col("v")).checkpoint()
        while True:
            said = edges.join(colour, edges["src"] == colour["v"]).groupBy(F.col("dst").alias("v")).agg(F.max("c").alias("near"))
            fresh = colour.join(said, "v", "left").select("v", F.greatest("c", F.coalesce("near", "c")).alias("c"), (F.coalesce("near", "c") > F.col("c")).alias("moved")).checkpoint()
            colour = fresh.select("v", "c")
            if fresh.filter("moved").isEmpty():
                break
        a, b = colour.toDF("src", "ca"), colour.toDF("dst", "cb")
        inner = edges.join(a, "src").join(b, "dst").filter("ca = cb").select("src", "dst", F.col("ca").alias("c")).checkpoint()
        group = colour.filter("v = c").checkpoint()
        while True:
            n = group.count()
            group = group.unionByName(inner.join(group.withColumnRenamed("v", "dst"), ["dst", "c"]).select(F.col("src").alias("v"), "c")).distinct().checkpoint()
            if group.count() == n:
                break
        loops = inner.join(group.select(F.col("v").alias("src"), "c"), ["src", "c"], "left_semi").join(group.select(F.col("v").alias("dst"), "c"), ["dst", "c"], "left_semi")
        found = found.unionByName(loops.select(F.col("src").alias("state")).distinct()).distinct().checkpoint()
        gone = group.select(F.col("v"))
        edges = edges.join(gone, F.col("src") == F.col("v"), "left_anti").join(gone, F.col("dst") == F.col("v"), "left_anti").checkpoint()
    return found


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side only: ``side`` is ``left`` or ``right``.  Empty: the relations are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def csr(arcs: DataFrame) -> DataFrame:
    """``(src, first, n)`` row offsets of arcs sorted by (src, isym, osym, dst)."""
    return running_sum(arcs.groupBy("src").agg(F.count("*").alias("n")), ["src"], "n", "first").select("src", "first", "n")


def coded(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(arcs, symbols)``: arcs with ``arc`` (their place in order), ``in_id`` and ``out_id``; ``symbols(side, id, symbol)`` in order, epsilon 0."""
    def table(side: str) -> DataFrame:
        used = arcs.select(F.col(f"{side}sym").alias("symbol")).unionByName(arcs.sparkSession.range(1).select(F.lit("").alias("symbol"))).distinct()
        return numbered(used, ["symbol"], "id").select(F.lit(side).alias("side"), F.col("id").cast("int").alias("id"), "symbol")

    tables = {side: table(side) for side in ("i", "o")}
    out = arcs
    for side in ("i", "o"):
        out = out.join(tables[side].select(F.col("symbol").alias(f"{side}sym"), F.col("id").alias("in_id" if side == "i" else "out_id")), f"{side}sym")
    out = numbered(out.select("src", "dst", "isym", "osym", "in_id", "out_id"), ["src", "in_id", "out_id", "dst"], "arc")
    return out, tables["i"].unionByName(tables["o"])
