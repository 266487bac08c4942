"""Quality rules: counts against brute force, cutoffs against exact binomial tails."""

import math
import re
from collections import Counter

from sqlcheck import mismatch

from storelytics.llm import quality_rules as rules


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(g)
    hit = {p for i, x in enumerate(g) if n[x] > 1 for p in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(hit))


TEXTS = [
    None, "", "   \n\n", "one", "a b c a b c", "a a a a", "x\ny\nx\n x\n\n\nx", "ü#ö $5 <b> ünï code", "a b c d a b c e b c d", "a b\x0bc\x0cd\re",
    "lang " * 30_000, "w1 w2 w3 w4 " * 2 + " ".join(f"u{i}" for i in range(5000)),
]


def test_counts(docs):
    rows = list(enumerate(TEXTS)) + [(None, "a b c"), (3, "one")]
    got = rules.counts(docs(*rows)).drop("stratum").collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute(t)) for i, t in rows)


def tail(n, k, p):
    from fractions import Fraction

    q = Fraction(str(p))
    return float(sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1)))


def test_cutoffs_are_the_strictest_that_hold(spark):
    rows = [(i, "en", 100, 500, min(60, i % 400 // 3 * (i % 7 == 0)), 10, 0, 0) for i in range(3000)] + [(9000, "de", 100, 500, 99, 10, 0, 0)]
    numbers = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    got = {r.stratum: r for r in rules.cutoffs(numbers, numbers.select("doc_id"), risk=0.1, error=0.05).collect()}
    want = None
    for c in rules.LADDERS["symbol_share"]:
        k = sum(s / 100 > c for _, lang, _, _, s, *_ in rows if lang == "en")
        if tail(3000, k, 0.02) > 0.05 / 10:
            break
        want = c
    assert got["en"]["cut_symbol_share"] == want and "de" not in got


def test_rules_reject_and_empty_tables(spark, docs):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(2500)]
    bad = [(5000, " ".join(f"#$%{j}" for j in range(60))), (5001, None), (5002, "short")]
    table = docs(*good, *bad)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(5000, 0, 0), (1, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in rules.judge(table, labels).collect()}
    assert len(got) == 2503 and all(got[i].kept for i, _ in good)
    assert not got[5000].kept and not got[5000].base_failed and "symbol_share" in got[5000].broken_rules
    assert got[5001].base_failed and got[5002].base_failed
    assert all(r.broken_rules == "" for r in rules.judge(table, labels.limit(0)).collect())
    assert rules.judge(table.limit(0), labels).count() == 0


def test_sql(spark):
    assert mismatch(spark, "op8_quality_rules") == []
