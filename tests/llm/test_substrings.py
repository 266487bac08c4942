"""Substring dedup against SQL and brute force over all windows."""

import random
import re
from collections import Counter

import pytest
from sqlcheck import mismatch

from storelytics.llm import substrings


def brute(rows, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    n = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {p for i in range(len(w) - length + 1) if n[tuple(w[i : i + length])] > 1 for p in range(i, i + length)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def corpus(seed, letters):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(30)]
    rows = [(1, None), (2, ""), (3, "a b c"), (None, " ".join(passage))]
    for i in range(10, 90):
        w = [word() for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            at, a = rng.randint(0, len(w)), rng.randint(0, 20)
            w[at:at] = passage[a : a + rng.randint(5, 30)]
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[20][1]) for i in range(5)] + [rows[30], rows[30]]
    rows += [(300, "x " * 500), (301, " ".join(passage * 8)), (302, "p\tq\nr " * 40)]
    return rows


@pytest.mark.parametrize(("letters", "shard"), [("abcdefgh", 50), ("ab", 50), ("abcdefgh", 0), ("ab", 3)])
def test_matches_brute_force(docs, letters, shard):
    rows = corpus(len(letters) + shard, letters)
    got = substrings.remove(docs(*rows), length=12, gram=5, shard_regions=shard)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 12)


def test_no_rows_and_nothing_to_remove(docs):
    assert substrings.remove(docs((1, "a")).limit(0)).count() == 0
    assert [tuple(r) for r in substrings.remove(docs((1, "a  b"))).collect()] == [(1, 2, 0, "a b")]


def test_automaton_statistics():
    rng = random.Random(5)
    for _ in range(50):
        texts = [([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 25))], rng.choice([1, 1, 2])) for _ in range(rng.randint(1, 6))]
        auto = substrings.Automaton(texts)
        count = Counter()
        for w, n in texts:
            for i in range(len(w)):
                for j in range(i + 1, len(w) + 1):
                    count[tuple(w[i:j])] += n
        for w, _ in texts:
            want = [max((k for k in range(1, i + 2) if count[tuple(w[i + 1 - k : i + 1])] > 1), default=0) for i in range(len(w))]
            assert list(auto.statistics(w)) == want


def test_sql(spark):
    assert mismatch(spark, "op10_substring_dedup") == []
