"""Benchmark decontamination against SQL and brute force."""

import hashlib
import re

import pytest
from sqlcheck import mismatch

from storelytics.llm import decontaminate as dec


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items, n=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(len(w) - n, 0) + 1) if w else []:
            wins.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, seen = words(t), set(), set()
        for win, ids in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    seen |= ids
        seen.discard(None)
        names = ",".join(sorted(map(str, seen)))
        out.append((d, len(w), len(hit), len(seen), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog and then runs far away"), (2, "short item"), (3, "Ünder"), (4, ""), (5, None),
    (6, "a b c"), (10, "short item"), (None, "null id words"), (7, "the quick brown fox jumps over the lazy dog and then"),
]
ROWS = [
    (1, "x THE quick, brown fox jumps over the lazy dog and then runs far off"), (2, None), (3, ""), (4, "a b a b c a b c d"),
    (5, "short-item! short item"), (6, "ünder Ünder under"), (6, "ünder Ünder under"), (None, "null id words"), (8, "..."), (9, "a"),
    (11, "the quick brown fox jumps over the lazy dog and not then"),
]


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("set_leads", [50_000, 0])
def test_matches_brute_force(spark, docs, set_leads, monkeypatch):
    monkeypatch.setattr(dec.hits, "__defaults__", (10, set_leads))
    got = dec.report(docs(*ROWS), items(spark))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS, ITEMS)


def test_no_items_and_no_documents(spark, docs):
    empty = items(spark).limit(0)
    assert {(r.n_hit, r.contaminated) for r in dec.report(docs(*ROWS), empty).collect()} == {(0, False)}
    assert dec.report(docs(*ROWS).limit(0), items(spark)).count() == 0


def test_filters_keep_clean_documents(spark, docs):
    clean = {d for d, *_, bad in brute(ROWS, ITEMS) if not bad}
    assert {r.doc_id for r in dec.drop_documents(docs(*ROWS), items(spark)).collect()} == clean
    cut = {r.doc_id: r.text for r in dec.drop_spans(docs(*ROWS), items(spark)).collect()}
    assert cut[4] == "a b d" and cut[9] == "a" and cut[1] == "x off" and cut[2] is None


def test_a_very_long_text(spark, docs):
    rows = [(1, "w " * 200_000 + ITEMS[0][1]), (2, "short item " * 20_000)]
    assert sorted((tuple(r) for r in dec.report(docs(*rows), items(spark)).collect()), key=str) == brute(rows, ITEMS)


def test_sql(spark):
    assert mismatch(spark, "op6_benchmark_decontamination") == []
