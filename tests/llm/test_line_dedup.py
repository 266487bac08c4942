"""Line dedup against brute force over all runs, and SQL."""

import random
import re

import pytest
from sqlcheck import mismatch

from storelytics.llm import line_dedup


def brute(rows, run, long_words=None):
    """doc_id, n_lines, n_removed, text in the order of the rows; rows of one id in the order given."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = set(), []
    for k in order:
        i, t = rows[k]
        lines = (t or "").split("\n")
        solid = [p for p, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = set()
        for b in range(len(solid)):
            for width in range(1, run + 1):
                key = tuple(lines[p] for p in solid[b : b + width])
                words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in key)
                if len(key) < width or width < run and not (long_words and words >= long_words):
                    continue
                if key in seen:
                    gone.update(range(b, b + width))
                seen.add(key)
        places = {solid[b] for b in gone}
        for b in gone:
            if b + 1 in gone:
                places.update(range(solid[b], solid[b + 1]))
        out.append((i, len(solid), len(gone), None if t is None else "\n".join(x for p, x in enumerate(lines) if p not in places)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("run", "letters"), [(3, "abcdefghij"), (2, "abc"), (1, "abcdefghijklmnopqrstuvwxyz"), (4, "ab")])
def test_matches_brute_force(docs, run, letters):
    rng = random.Random(run)
    line = lambda: rng.choice(["", " ", "\t"]) if rng.random() < 0.15 else " ".join(rng.choice(letters) for _ in range(rng.choice([1, 1, 2])))
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, "a\nb\nc\nd"), (4, "a")]
    rows += [(i, "\n".join(line() for _ in range(rng.randint(0, 25)))) for i in range(10, 70)]
    rows += [(200 + i, rows[12][1]) for i in range(4)] + [(7, "x\n" * 3000), (8, "\n".join(f"u{i % 500}" for i in range(1200)))]
    got = line_dedup.dedup(docs(*rows), run)
    assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_removed", "text").collect()), key=str) == brute(rows, run)


@pytest.mark.parametrize(("run", "long_words"), [(3, 4), (4, 5), (2, 3)])
def test_long_runs_of_few_lines_match_brute_force(docs, run, long_words):
    rng = random.Random(run * long_words)
    line = lambda: rng.choice(["", " "]) if rng.random() < 0.15 else " ".join(rng.choice("ab") for _ in range(rng.choice([1, 1, 2, 3, 5])))
    rows = [(1, None), (2, ""), (None, "a b a b a"), (4, "a b a b a"), (5, "x\ty\vz  w v")]
    rows += [(i, "\n".join(line() for _ in range(rng.randint(0, 12)))) for i in range(10, 70)]
    got = line_dedup.dedup(docs(*rows), run, long_words)
    assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_removed", "text").collect()), key=str) == brute(rows, run, long_words)


def test_a_long_line_goes_wherever_it_stands(docs):
    """A passage of 120 words on one line among other lines, and two equal documents of one line; a short line stays."""
    line = " ".join(f"w{i}" for i in range(120))
    rows = [(1, f"one\n{line}\nshort"), (2, f"two\n{line}\nother\nshort"), (3, line), (4, " ".join("ab" for _ in range(40))), (5, " ".join("ab" for _ in range(40)))]
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs(*rows), 3, 35).collect()}
    assert got == {1: rows[0][1], 2: "two\nother\nshort", 3: "", 4: rows[3][1], 5: ""}


def test_repeated_rows_and_extra_columns(docs):
    table = docs((5, "a\nb\nc"), (5, "a\nb\nc"), (6, "a\nb\nc\nd"))
    got = line_dedup.dedup(table)
    assert sorted((r.doc_id, r.n_removed, r.text) for r in got.collect()) == [(5, 0, "a\nb\nc"), (5, 3, ""), (6, 3, "d")]
    assert set(got.columns) == {*table.columns, "n_lines", "n_removed"}
    assert line_dedup.dedup(table.limit(0)).count() == 0


def test_sql(spark):
    assert mismatch(spark, "op5_line_dedup") == []
