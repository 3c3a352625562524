from textlattice.llm.licenses import TEMPLATES, scan_licenses


def test_matches(spark):
    mit, apache = TEMPLATES["MIT"], TEMPLATES["Apache-2.0"]
    changed = mit.replace("merge, publish", "combine").upper()
    rows = [
        (1, f"Some text.\n{TEMPLATES['MIT-line']}\nMore."), (2, None), (3, ""), (4, "Permission is hereby granted to nobody."),
        (5, "x " * 40000 + changed + " tail " * 100), (6, apache + "\n" + apache), (7, "ordinary words about the license of a poet"), (7, "ordinary words about the license of a poet"),
    ]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, matches int")
    got = {r.doc_id: r.matches for r in scan_licenses(df).collect()}
    names = {i: sorted(m.license for m in ms) for i, ms in got.items()}
    assert names == {1: ["MIT-line"], 2: [], 3: [], 4: [], 5: ["MIT"], 6: ["Apache-2.0", "Apache-2.0", "Apache-2.0-line", "Apache-2.0-line"], 7: []}
    text = dict(rows)[1]
    assert text[got[1][0].start : got[1][0].end] == "Released under the MIT License"
    (m,) = got[5]
    assert 0.9 < m.coverage < 1 and dict(rows)[5][m.start : m.end] == changed.rstrip(".")
    assert scan_licenses(df.limit(0)).collect() == []
