"""Command line: gold CoNLL-U against the engine's readings, as one JSON report of measures by scope."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlattice.engine import Engine
from textlattice.operators import align as A
from textlattice.operators import evaluate as E
from textlattice.plans.session import session
from textlattice.sources import conllu, files


def evaluate(engine: Engine, texts: DataFrame) -> dict[str, DataFrame]:
    """``measures`` (a row for each scope), ``alignment`` (one row of counters), ``errors`` of gold ``texts(path, text)``.

    Sentences are analyzed by their texts and aligned token by token; repeated paths are files each.
    """
    p = conllu.parse(texts)
    sentences = p["sentences"].select(F.col("sent_id").alias("doc_id"), "text")
    t = engine.tokens(sentences).filter("kind <> 'space'")
    t = t.select(F.col("doc_id").alias("sent_id"), "tok_idx", "text", "readings", "selected")
    gold = p["tokens"].select("sent_id", "ordinal", "tok_id", "form", "lemma", "upos", "features")
    # Predicted tokens are numbered without white space, as the alignment counts them.
    order = Window.partitionBy("sent_id").orderBy("tok_idx")
    t = t.withColumn("tok_idx", F.row_number().over(order) - 1)
    ops = A.align(gold, t, p["multiword"])
    return {"measures": E.metric_set(E.scoped(gold, t, ops), "scope"), "alignment": A.counts(ops), "errors": p["errors"]}


def report(spark: SparkSession, engine: Engine, texts: DataFrame, samples: int = 20) -> dict:
    """The report as plain data: three rows of measures, the counters, and the first ``samples`` bad rows of the gold."""
    found = evaluate(engine, texts)
    measures = {}
    for r in found["measures"].collect():  # a row for each of three scopes
        d = r.asDict()
        names = sorted({c.rsplit("_", 1)[0] for c in d if c.endswith("_total")})
        measures[d["scope"]] = {n: {"correct": d[f"{n}_correct"], "total": d[f"{n}_total"], "value": d[f"{n}_correct"] / d[f"{n}_total"] if d[f"{n}_total"] else None} for n in names}
    bad = [r.asDict() for r in found["errors"].orderBy("path", "line_no").limit(samples).collect()]
    return {"schema": "textlattice.evaluation.v1", "ud_profile": engine.ud_profile, "measures": measures, "alignment": found["alignment"].first().asDict(), "errors": bad}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="textlattice.report", description="Gold CoNLL-U against the engine's readings.")
    p.add_argument("gold", help="file or folder of CoNLL-U")
    p.add_argument("output", nargs="?", default="-")
    p.add_argument("--lexicon", required=True, help="Parquet table (surface, cand_idx, raw)")
    p.add_argument("--ud-profile", choices=("universal", "ktb"), default="universal")
    args = p.parse_args(argv)
    spark = session("*", 8, "2g")
    engine = Engine(spark, spark.read.parquet(args.lexicon), ud_profile=args.ud_profile)
    said = json.dumps(report(spark, engine, files.whole_texts(spark, args.gold, pattern="*.conllu")), ensure_ascii=False, indent=1, sort_keys=True)
    if args.output == "-":
        print(said)
    else:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(said + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
