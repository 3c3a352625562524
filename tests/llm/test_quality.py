import random
import re
from collections import Counter

from textlattice.llm.quality import quality_rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(wins).items() if n > 1}
    covered = {i + k for i, w in enumerate(wins) if w in twice for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_statistics_and_verdicts(spark):
    pick = random.Random(4)
    vocabulary = ["w" + "".join(pick.choice("abcdefgé") for _ in range(pick.randint(1, 8))) for _ in range(500)]
    prose = lambda n: "\n".join(" ".join(pick.choice(vocabulary) for _ in range(12)) for _ in range(n // 12))
    rows = [(i, prose(pick.choice([20, 100, 400, 1500])), "en", f"s{i % 3}") for i in range(400)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in prose(200).split(" ")), "en", f"s{i % 3}") for i in range(12)]
    odd = [(2000, None, "en", "s0"), (2001, "", None, None), (2002, " \t\x0b\n\n", "en", "s0"), (2003, "a b c a b c\na b c a b c\n\nx", "de", "s9"), (2004, "x" * 100000, "en", "s1"),
           (2005, "same line here\n" * 3000, "en", "s1"), (2006, "\x1c a\x85b 　", "en", "s1"), (2007, prose(300), None, None), (2007, rows[0][1], None, None), (None, prose(120), "en", "s2"), (2008, prose(30000), "en", "s0")]
    every = rows + junk + odd
    df = spark.createDataFrame([(*r, 1) for r in every], "doc_id long, text string, lang string, source string, n_words int")
    got = quality_rules(df).collect()
    key = lambda k, s: (k is None, k or 0, s)
    have = sorted((key(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got))
    assert have == sorted(key(k, brute(t)) for k, t, _, _ in every)
    by = {r.doc_id: r for r in got}
    assert not any(by[k].kept for k, *_ in junk)
    clean = [by[k].kept for k, t, *_ in rows if not brute(t)[5]]
    assert sum(clean) >= 0.99 * len(clean) and by[2008].kept
    assert all(not (r.base_failed and r.kept) for r in got)
    assert quality_rules(df.limit(0)).collect() == []
