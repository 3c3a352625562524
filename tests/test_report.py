import json

from textlattice import report as P
from textlattice.engine import Engine

GOLD = "# text = ab cd, ef\n1\tab\tab\tNOUN\t_\tCase=Nom\t0\tx\t_\t_\n2\tcd\tcd\tVERB\t_\t_\t0\tx\t_\tSpaceAfter=No\n3\t,\t,\tPUNCT\t_\t_\t0\tx\t_\t_\n4\tef\tef\tNOUN\t_\tCase=Nom\t0\tx\t_\t_\n\n1\tgh\tgh\tNOUN\t_\t_\n"
LEX = "surface string, cand_idx int, raw string"


def test_report_by_scope(spark, tmp_path):
    (tmp_path / "g.conllu").write_text(GOLD)
    lex = spark.createDataFrame([("ab", 0, "ab<n><nom>"), ("cd", 0, "cd<n><nom>"), ("cd", 1, "cd<v>")], LEX)
    from textlattice.sources import files

    r = P.report(spark, Engine(spark, lex), files.whole_texts(spark, str(tmp_path), pattern="*.conllu"))
    m = r["measures"]
    assert m["end_to_end"]["lemma"] == {"correct": 2, "total": 4, "value": 0.5} and m["end_to_end"]["upos"]["correct"] == 2
    assert m["aligned_only"]["full"] == {"correct": 2, "total": 4, "value": 0.5}
    # Of two readings none is chosen, an unknown one doesn't count, punctuation has none.
    assert m["selected_only"]["upos"] == {"correct": 1, "total": 1, "value": 1.0}
    assert r["alignment"]["one_to_one_exact"] == 4 and [e["line_no"] for e in r["errors"]] == [7]
    lex.write.parquet(str(tmp_path / "lex"))
    assert P.main([str(tmp_path), str(tmp_path / "out.json"), "--lexicon", str(tmp_path / "lex")]) == 0
    assert json.loads((tmp_path / "out.json").read_text()) == json.loads(json.dumps(r))
