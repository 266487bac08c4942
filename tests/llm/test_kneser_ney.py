"""The bigram model against a plain-Python one, its sums, and held-out gain over the base."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from storelytics.llm import kneser_ney as kn
from storelytics.llm import queries


def plain(rows):
    """(doc_id, held_out, n_tokens, n_known, N, base, score) by dictionaries of words."""
    toks = [(t or "").encode().lower().split() + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    uni, bi = Counter(), Counter()
    for w, h in zip(toks, held):
        if not h:
            uni.update(w)
            bi.update(zip([b" s", *w], w))
    n, v = sum(uni.values()), len(uni)
    ctx, seen, cls = Counter(), Counter(), defaultdict(lambda: [0, 0, 0])
    for (a, b), c in bi.items():
        ctx[a] += c
        seen[b] += 1
        cls[a][min(c, 3) - 1] += 1
    four = lambda x: [sum(c == k for c in x) for k in (1, 2, 3, 4)]
    d, e = kn._discounts(four(bi.values())), kn._discounts(four(seen.values()))
    spare = sum(e[min(c, 3) - 1] for c in seen.values()) / len(bi) if bi else 1.0
    out = []
    for (i, _), w, h in zip(rows, toks, held):
        base = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for a, b in zip([b" s", *w], w):
            p = ((seen[b] - e[min(seen[b], 3) - 1]) / len(bi) if seen[b] else 0) + spare / (v + 1)
            if ctx[a]:
                c = bi[a, b]
                p = ((c - d[min(c, 3) - 1]) / ctx[a] if c else 0) + sum(x * y for x, y in zip(d, cls[a])) / ctx[a] * p
            score += math.log10(p)
        out.append((i, h, len(w), sum(uni[x] > 0 for x in w), n, base, score))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[2], r[6])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def rows_of(df):
    return [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()]


def test_the_sample_matches_and_beats_the_base(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(queries.queries()["op4_lm_scoring"](spark, "/root/testdata/sf0.01"))
    same(got, plain(rows))
    assert sum(r[6] for r in got if r[1]) > sum(r[5] for r in got if r[1])


@pytest.mark.parametrize("shard_tokens", [2_000_000, 3])
def test_edge_rows(docs, shard_tokens, monkeypatch):
    monkeypatch.setattr(kn, "CHUNK_TOKENS", 7)
    rows = [(i, t) for i, t in enumerate([None, "", "a b a b", "A\tB c", "the the the x", "ünï 😀", "a b c d e f g h"] * 4)] + [(3, "a b"), (3, "a b"), (None, "q r")]
    same(rows_of(kn.scored(docs(*rows), shard_tokens)), plain(rows))


def test_nothing_to_learn_from(docs):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = rows_of(kn.scored(docs((held, "a b"))))
    assert got == [(held, True, 3, 0, 0, 0.0, 0.0)]
    assert kn.scored(docs((1, "a")).limit(0)).count() == 0
