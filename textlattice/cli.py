"""Command line: analyze a text with a lexicon table and print one of the five formats."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from textlattice.functions import text as X
from textlattice.operators import serialize as S
from textlattice.plans.session import session
from textlattice.sources import files, tables

FORMATS = ("text", "json", "jsonl", "xml", "conllu")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textlattice", description="Ambiguity-preserving text analysis on Spark.")
    p.add_argument("input", nargs="?", default="-")
    p.add_argument("output", nargs="?", default="-")
    for flags, dest, help_ in (
        ("-n", "newline", "one segment a line"), ("-c", "copy_input", "copy what is not analysed"), ("-w", "dictionary_only", "readings of the dictionary only"), ("-l", "lemmas_only", "readings without surfaces"),
        ("-i", "gram_info", "grammatical information"), ("-g", "merge", "merge readings by lemma"), ("-s", "sentence_markers", "mark ends of sentences (with -c)"), ("--eng-gr", "eng_gr", "accepted for compatibility"),
        ("--weight", "weights", "scores"), ("--generate-all", "generate_all", "all hypotheses"), ("--no-guesser", "no_guesser", "no hypotheses for unknown words"), ("--selected-only", "selected_only", "only the chosen reading"),
    ):
        p.add_argument(flags, dest=dest, action="store_true", help=help_)
    p.add_argument("-e", "--encoding", default="utf-8")
    p.add_argument("--format", choices=FORMATS, default="text")
    p.add_argument("--filter-gram", action="append", default=[], dest="filters")
    p.add_argument("--fixlist")
    p.add_argument("--lexicon", help="Parquet table (surface, cand_idx, raw)")
    p.add_argument("--relation", help="Parquet table (surface, raw) of hypotheses")
    p.add_argument("--guess-limit", type=int, default=8)
    p.add_argument("--ud-profile", choices=("universal", "ktb"), default="universal")
    p.add_argument("-v", "--version", action="version", version="textlattice 0.1.0")
    return p


def check(args: argparse.Namespace, fail) -> None:
    if args.sentence_markers and not args.copy_input:
        fail("-s needs -c")
    if args.sentence_markers and args.format == "json":
        fail(f"-s does not go with {args.format}")
    if args.merge and not args.gram_info:
        fail("-g needs -i")
    if args.guess_limit < 1:
        fail("--guess-limit must be positive")
    try:
        files.check_codec(args.encoding)
    except (LookupError, ValueError) as e:
        fail(str(e))


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    check(args, p.error)
    raw = sys.stdin.buffer.read() if args.input == "-" else open(args.input, "rb").read()
    text = raw.decode(args.encoding)
    from textlattice.engine import Engine

    spark = session("*", 8, "2g")
    spark.sparkContext.setLogLevel("ERROR")
    lexicon = spark.read.parquet(args.lexicon) if args.lexicon else spark.createDataFrame([], "surface string, cand_idx int, raw string")
    fix = None
    if args.fixlist:
        lines = open(args.fixlist, encoding="utf-8").read().splitlines()
        fix, bad = tables.fixlist(spark.createDataFrame(list(enumerate(lines, 1)), "line_no int, line string"))
        for r in bad.orderBy("line_no").collect():
            p.error(f"{args.fixlist}:{r.line_no}: {r.message}")
    relation = spark.read.parquet(args.relation) if args.relation and not args.no_guesser else None
    engine = Engine(spark, lexicon, fix, relation, guess_limit=args.guess_limit, ud_profile=args.ud_profile)
    d = engine.documents(spark.createDataFrame([(0, text)], "doc_id long, text string"), generate_all=args.generate_all)
    t, f = F.col("tokens"), tuple(g for x in args.filters for g in x.split(",") if g)
    common = {"copy_input": args.copy_input, "dictionary_only": args.dictionary_only, "filters": f}
    more = {"gram_info": args.gram_info, "merge": args.merge, "weights": args.weights, "selected_only": args.selected_only}
    said = {
        "text": lambda: S.to_text(t, newline=args.newline, lemmas_only=args.lemmas_only, sentence_markers=args.sentence_markers, **common, **more), "json": lambda: S.to_json(t, newline=args.newline, **common, **more),
        "jsonl": lambda: S.to_jsonl(t, F.col("spans"), profile=args.ud_profile, **common), "xml": lambda: S.to_xml(t, sentence_markers=args.sentence_markers, **common, **more), "conllu": lambda: S.to_conllu(t, args.dictionary_only, f),
    }[args.format]()
    row = d.select(said.alias("said")).first()
    out = "" if row is None else row.said
    if out is None:
        at = X.xml_forbidden(F.lit(text))
        p.error(f"XML 1.0 forbids a character of the text at {spark.range(1).select(at).first()[0]}")
    data = out.encode(args.encoding)
    if args.output == "-":
        sys.stdout.buffer.write(data)
    else:
        with open(args.output, "wb") as target:
            target.write(data)
    return 0


if __name__ == "__main__":
    sys.exit(main())
