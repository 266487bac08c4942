"""Spelling variants against SQL and against all pairs of words."""

import random
import zlib
from collections import Counter

import pytest
import regex
from sqlcheck import mismatch

from storelytics.llm import spelling
from storelytics.llm.common import cut

RUN = regex.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    """Exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    forms, found = {}, []
    for w, n in words.items():
        others = sorted((-words[v], v) for v in words if near(w, v))
        form = others[0][1] if others and -others[0][0] >= 2 * n else None
        forms[w] = form
        found.append((w, form, n, len(others), words[form] if form else None))
    out = []
    for w, form, n, k, form_n in found:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, form, root, n, k, form_n))
    return sorted(out, key=str)


def got(frame):
    return sorted(map(tuple, frame.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_the_sample_equals_sql(spark):
    assert mismatch(spark, "op13_spelling_variants") == []


@pytest.mark.parametrize("seed", range(3))
def test_random_words_equal_all_pairs(spark, docs, seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("aberéß") for _ in range(rng.randint(5, 9))) for _ in range(25)]

    def edited(w):
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w))
            w = w[:i] + rng.choice(["", rng.choice("aberÉ") + w[i], rng.choice("abÿ")]) + w[i + 1 :]
        return w

    rows = [(i, " ".join(edited(rng.choice(stems)) for _ in range(120))) for i in range(40)]
    assert got(spelling.grouped(docs(*rows))) == brute(rows)


def test_chains_of_forms_end_at_the_commonest(spark, docs):
    words = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb"]
    text = " ".join(" ".join([w] * (3 * 2**k)) for k, w in enumerate(words))
    found = {r.word: r.root for r in spelling.grouped(docs((1, text)), dropped=2**40).collect()}
    assert found == {w: "abbbbb" for w in words}


def test_odd_rows(spark, docs):
    long = "x" * 5_000
    rows = [
        (1, None), (2, ""), (None, "Straße straßE straße"), (3, "ÀÉÎÕÜ ÀÉÎÕÜ àéîõü ÀÉÎÕÜ"), (3, "ab×cd÷e " * 4),
        (4, f"{long} {long} {long} {long}y {long}y {long}y"), (5, "word's WORDS words wordsĀwords " * 3), (5, "12345 _____"),
    ]
    assert got(spelling.grouped(docs(*rows))) == brute(rows)
    assert spelling.grouped(docs((1, "a")).limit(0)).count() == 0


def test_columns_of_any_name(spark, docs):
    frame = docs((1, "lettre lettre lettre letter letter letter")).selectExpr("*", "1 AS word", "2 AS n", "3 AS run", "4 AS doc", "5 AS h", "6 AS key")
    assert [r.word for r in spelling.grouped(frame).orderBy("word").collect()] == ["letter", "lettre"]


def test_every_edit_shares_a_signature(spark):
    """A third of all words in one bucket of letters: none lost, and the join pairs far fewer than all."""
    rng = random.Random(5)
    words = {"".join(rng.choice("aeiou") for _ in range(7)) for _ in range(600)}
    frame = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    pairs = {(r.a, r.b) for r in spelling.near_pairs(frame).collect()}
    assert pairs == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_nothing_is_broadcast(spark):
    """Exploded signatures are sized by the table they come from; a small table must not send all of them through the driver."""
    words = cut(spark.createDataFrame([("letter", 9), ("lettre", 3), ("lettr", 3)], "word string, n long"))
    frames = [spelling.near_pairs(words), spelling.variants(words)]
    assert all("Broadcast" not in f._jdf.queryExecution().executedPlan().toString() for f in frames)
    assert {r.word: r.root for r in frames[1].collect()} == {"letter": "letter", "lettr": "letter", "lettre": "lettre"}
