import random
import re

from textlattice.llm import secrets as S
from textlattice.llm.secrets import Ratio, labelled, scan_secrets, transitions

BASE = (
    ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6),
    ("access", re.compile(r"(AKIA[A-Z0-9]+)"), 20),
    ("hex", re.compile(r"([0-9a-f]+)"), 24),
)


def base(text):
    return sorted((m.start(), i, kind, m.end()) for i, (kind, rx, least) in enumerate(BASE) for m in rx.finditer(text or "") if len(m.group(1)) >= least)


def prose(pick, n):
    syllables = ["tion", "heit", "ment", "lich", "er", "an", "the", "sch", "ou", "re", "in", "keit"]
    return ["".join(pick.choice(syllables) for _ in range(pick.randrange(1, 6))) for _ in range(n)]


def drawn(pick, chars, n):
    return "".join(pick.choice(chars) for _ in range(n))


CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def corpus(pick):
    rows, planted = [], []
    for i in range(250):
        words = prose(pick, 40)
        kind, secret = i % 6, None
        if kind == 0:
            words.insert(7, f'{pick.choice(["password", "API_KEY", "Token", "secret"])}{pick.choice(["=", ": ", chr(34) + " = " + chr(34)])}{drawn(pick, CHARS, 24)}')
        elif kind == 1:
            words.insert(9, "AKIA" + drawn(pick, CHARS[:26] + "0123456789", 16))
        elif kind == 2:
            words.insert(3, drawn(pick, "0123456789abcdef", pick.choice([23, 24, 40])))
        elif kind == 3:
            secret = drawn(pick, CHARS, 40)
            words.insert(20, secret)
        text = " é😀".join(words)
        rows.append((i, text))
        if secret:
            planted.append((i, text.index(secret), text.index(secret) + 40))
    rows.append((990, " ".join(w.upper() + "!!" for w in prose(pick, 60))))  # shouted, and clean
    edge = ["token=abc", "token=token:abcdefgh", "TOKEN : x password=" + "a" * 6, "AKIAAKIA" + "B" * 15, "AKIA" + "AKIA" * 5, "x" * 30, "0" * 24 + "g" + "f" * 23, "secret='" + "z" * 5 + "' secret='" + "z" * 6, "token\n=abcdefg", "toKEN  =  \"+/_.=-\"", "apikey:abcdef.api_key=ghijkl"]
    rows += [(1000 + i, t) for i, t in enumerate(edge)]
    rows += [(2000, None), (2001, ""), (2002, "ab " * 40_000 + "password=hunter22 " * 300), (2003, rows[0][1]), (0, rows[0][1]), (None, rows[6][1])]
    return rows, planted


def test_base_spans_equal_brute_force_and_models_add(spark):
    rows, planted = corpus(random.Random(8))
    df = spark.createDataFrame([(k, t, 5) for k, t in rows], "doc_id long, text string, spans int").repartition(4)
    got = scan_secrets(df).collect()
    assert len(got) == len(rows)
    key = lambda k, spans: str((k, spans))
    bases = sorted(key(r.doc_id, [tuple(s)[:4] for s in r.spans if s.order < 3]) for r in got)
    assert bases == sorted(key(k, base(t)) for k, t in rows)
    added = {(r.doc_id, s.start, s.end) for r in got for s in r.spans if s.order == 3}
    assert len(added & set(planted)) >= 0.9 * len(planted)
    # Prose has none; a hex string just under the least length may be taken, being as random.
    wrong = {k for k, _, _ in added} - {k for k, _, _ in planted}
    assert all(k is not None and k < 250 and k % 6 == 2 or k is not None and k >= 1000 for k in wrong)
    assert scan_secrets(df.limit(0)).collect() == []


def test_spans_lie_where_the_strings_are(spark):
    rows, _ = corpus(random.Random(2))
    text_of = dict(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in scan_secrets(df, margin=-5.0).collect():
        if r.doc_id is None:
            continue
        for s in r.spans:
            if s.order == 3:
                piece = text_of[r.doc_id][s.start : s.end]
                assert re.fullmatch(r"[A-Za-z0-9+/_=-]{12,}", piece)
                assert not any(a < s.end and s.start < e for a, _, _, e in base(text_of[r.doc_id]))


def test_scores_equal_brute_force_and_held_out_strings(spark):
    import math

    pick = random.Random(6)
    both = [("".join(prose(pick, 6))[:20], 0) for _ in range(600)] + [(drawn(pick, CHARS, 20), 1) for _ in range(200)]
    pick.shuffle(both)
    train, held = both[:600], both[600:]
    ratio = Ratio(transitions(spark.createDataFrame(train, "value string, secret int")))
    pairs = [[ab for v, t in train if t == s for ab in zip("\0" + v.lower(), v.lower())] for s in (0, 1)]

    def p(s, a, b):
        of_a, of_b = [y for x, y in pairs[s] if x == a], sum(y == b for _, y in pairs[s])
        own = (of_b + S.SMOOTH) / (len(pairs[s]) + S.SMOOTH * S.LETTERS)
        return math.log((max(of_a.count(b) - S.DISCOUNT, 0) + S.DISCOUNT * len(set(of_a)) * own) / len(of_a) if of_a else own)

    df = spark.createDataFrame(held, "value string, secret int")
    got = {r.value: r.score for r in df.select("value", ratio.score(df["value"]).alias("score")).collect()}
    right = 0
    for k, (v, s) in enumerate(held):
        right += (got[v] > ratio.odds) == bool(s)
        if k >= 40:  # the plain way is slow
            continue
        want = sum(p(1, a, b) - p(0, a, b) for a, b in zip("\0" + v.lower(), v.lower()))
        assert abs(got[v] - want) < 1e-6
    assert right >= 0.98 * len(held)


def test_labels_and_no_labels(spark):
    df = spark.createDataFrame([(1, "password=" + "k7" * 9), (2, "k7" * 9 + " plainidentifier plainidentifier")], "doc_id long, text string")
    found = S._found(df, "doc_id", "text")
    assert sorted(map(tuple, labelled(found).collect())) == [("k7" * 9, 1), ("plainidentifier", 0)]
    bare = spark.createDataFrame([(1, "plainidentifier only"), (2, "none")], "doc_id long, text string")
    assert all(r.spans == [] for r in scan_secrets(bare).collect())
    named = spark.createDataFrame([("x", "secret=abcdef1")], "doc_id string, text string")
    assert [(r.doc_id, [s.kind for s in r.spans]) for r in scan_secrets(named).collect()] == [("x", ["assign"])]
