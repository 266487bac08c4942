"""SimHash near-dedup against brute force over all pairs."""

import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from storelytics.llm import simhash
from storelytics.llm.common import cut
from storelytics.llm.components import components

SAMPLE = "/root/testdata/sf0.01/documents.parquet"


def brute(rows, words, radius):
    """(doc_id, fingerprint, component_id) by plain Python."""
    prints = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    comp = list(range(len(rows)))
    p = np.array(prints, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(p ^ p[i]) <= radius):
            a, b = comp[i], comp[int(j)]
            if a != b:
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    least = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted([(i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(rows, prints, comp)], key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()], key=str)


def test_matches_brute_force_on_the_sample(spark, docs):
    rows = [tuple(r) for r in spark.read.parquet(SAMPLE).select("doc_id", "text").collect()]
    assert got(simhash.linked_fingerprints(docs(*rows))) == brute(rows, 3, 2)


def test_edge_rows(docs):
    rows = [(5, None), (4, ""), (3, "a b"), (2, "A  B"), (9, "a b"), (9, "a b"), (None, "x y z"), (7, "x y z"), (8, "one")]
    assert got(simhash.linked_fingerprints(docs(*rows))) == brute(rows, 3, 2)


def test_empty_table(docs):
    assert simhash.linked_fingerprints(docs((1, "a")).limit(0)).count() == 0
    assert simhash.keep_one(docs((1, "a")).limit(0)).count() == 0


def test_forest_finds_every_link():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 40).astype(np.uint64)
    flips = np.uint64(1) << rng.integers(0, 63, (3, 2000)).astype(np.uint64)
    p = np.unique(centre[rng.integers(0, 40, 2000)] ^ flips[0] ^ flips[1] ^ flips[2])
    label = simhash._local_roots(simhash.Forest(p[:, None], np.zeros(len(p), np.int64)), 2)
    near = [(i, int(j)) for i in range(len(p)) for j in np.flatnonzero(np.bitwise_count(p ^ p[i]) <= 2)]
    want = np.arange(len(p))
    while True:
        before = want.copy()
        for i, j in near:
            want[i] = want[j] = min(want[i], want[j])
        if (before == want).all():
            break
    assert (label == want).all()


def test_large_shards_in_chunks_lose_nothing(spark):
    rng = random.Random(2)
    prints = sorted({(1 << 40) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)})
    rows = [(7, bytearray(p.to_bytes(8, "big"))) for p in prints]
    stars = simhash.links(spark.createDataFrame(rows, "key long, fp binary"), 1, 2, shard_nodes=20)
    found = components(stars)
    assert found.select("root").distinct().count() == 1 and found.count() == len(prints) - 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (100, 101), (None, 3)]
    rows = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert rows == {i: 0 for i in range(1, 51)} | {i: 100 for i in range(101, 140)}


def test_near_copies_leave_one(docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(300)] for _ in range(6)]
    rows = []
    for n, b in enumerate(base):
        rows.append((10 * n, " ".join(b)))
        for c in range(1, 4):
            w = list(b)
            for _ in range(c):
                w[rng.randrange(300)] = word()
            rows.append((10 * n + c, " ".join(w)))
    rows += [(900, None), (901, ""), (None, "lone text"), (None, rows[0][1]), (7, "one id"), (7, "two texts"), (7, "one id")]
    kept = [r.doc_id for r in simhash.keep_one(docs(*rows)).collect()]
    assert sorted(kept, key=str) == sorted([10 * n for n in range(6)] + [900, None, 7, 7], key=str)


def shared(rng, n, words=300):
    """Two texts of random words that have the first ``n`` in common."""
    a, b = ([f"{rng.randrange(10**6)}" for _ in range(words)] for _ in range(2))
    return " ".join(a), " ".join(a[:n] + b[n:])


def test_links_at_the_similarity_and_not_below(docs):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        for side, n in ((0, 268), (1000, 265)):  # 264 of 328 and 261 of 331 shingles: 0.805 and 0.789
            a, b = shared(rng, n)
            rows += [(side + 2 * k, a), (side + 2 * k + 1, b)]
    kept = {r.doc_id for r in simhash.keep_one(docs(*rows)).collect()}
    assert kept == set(range(0, 120, 2)) | set(range(1000, 1120))


def test_chunks_of_a_large_component_lose_nothing(docs, monkeypatch):
    rng = random.Random(6)
    base = [f"{rng.randrange(10**6)}" for _ in range(320)]
    rows = [(i, " ".join(base[3 * i : 3 * i + 200])) for i in range(40)]  # each like its neighbours, the ends unlike
    monkeypatch.setattr(simhash, "SET_NODES", 7)
    assert {r.component_id for r in simhash.near_duplicates(docs(*rows)).collect()} == {0}


def test_sets_against_brute_force():
    rng = np.random.default_rng(7)
    for n in [2] * 5 + [3, 9, 30] * 5:
        sets = [np.flatnonzero(rng.random(40) < 0.75).astype(np.uint64) for _ in range(n)]
        want = list(range(n))
        for i in range(n):
            for j in range(n):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if a | b and len(a & b) / len(a | b) >= 0.65:
                    want = [min(want[i], want[j]) if c in (want[i], want[j]) else c for c in want]
        assert simhash._alike(sets, 0.65).tolist() == want


def test_a_tail_of_one_repeated_phrase_keeps_the_link(docs):
    a, b = (shared(random.Random(n), 0)[0] for n in (8, 9))
    rows = [(1, a), (2, a + " spam" * 2000), (3, b), (4, b + " buy it now" * 700), (5, "spam " * 2000)]
    assert {r.doc_id for r in simhash.keep_one(docs(*rows)).collect()} == {1, 3, 5}


def test_shards_by_samples_of_bits_bring_pairs_together(spark):
    """Fingerprints that differ as texts at 0.8 do share a shard, unlike ones hardly ever."""
    rng, angle = np.random.default_rng(8), 0.1515
    bits = rng.integers(0, 2, (500, 64 * simhash.DRAWN), np.uint8)
    other = bits ^ (rng.random(bits.shape) < angle)
    rows = [(bytearray(i.to_bytes(4, "big")), bytearray(np.packbits(b).tobytes())) for i, b in enumerate(np.concatenate((bits, other)))]
    nodes = spark.createDataFrame(rows, "fp binary, drawn binary")
    samples = simhash._samples(100_000, angle)
    keys = {}
    for r in simhash._sample_keys(nodes, samples).collect():
        keys.setdefault(int.from_bytes(r.fp, "big"), set()).add(r.key)
    assert all(len(k) == len(samples) for k in keys.values())
    assert sum(bool(keys[i] & keys[500 + i]) for i in range(500)) >= 495
    assert sum(bool(keys[i] & keys[i + 1]) for i in range(499)) <= 50
    assert [len(s) for s in simhash._samples(simhash.SHARD_TEXTS, angle)] == [0]  # few texts are one shard


def test_a_dense_group_is_not_compared_pair_by_pair():
    rng = np.random.default_rng(9)
    centre = rng.integers(0, 2**63, (3, 4)).astype(np.uint64)
    prints = np.repeat(centre, [1, 4000, 50], axis=0)
    flips = np.uint64(1) << rng.integers(0, 63, (6, *prints.shape)).astype(np.uint64)
    prints ^= np.bitwise_xor.reduce(flips, axis=0)
    forest = simhash.Forest(prints, np.zeros(len(prints), np.int64))
    label = simhash._local_roots(forest, 62)
    assert np.unique(label, return_counts=True)[1].tolist() == [1, 4000, 50]
    assert sum(len(a) for a, _ in forest.links(np.arange(len(prints)), 62)) < 100 * len(prints)


def test_short_texts_at_the_similarity_are_all_linked(docs):
    """Four and five shingles, four of them shared: too few for their fingerprints to be as near as those of long texts."""
    rng = random.Random(11)
    rows = []
    for i in range(0, 1200, 2):
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(9))
        rows += [(i, text), (i + 1, text.rsplit(" ", 1)[0])]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(*rows)).collect()}
    assert found == {i: i - i % 2 for i in range(1200)}


def test_prefixes_find_all_pairs_without_the_trees(docs, monkeypatch):
    """Sets of all sizes over few shingles, most of them common, against all pairs; chunks and steps are small."""
    monkeypatch.setattr(simhash, "SHARD_NODES", 7)
    monkeypatch.setattr(simhash, "PAIRS", 50)
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(40)}" for _ in range(rng.choice((1, 3, 8, 20, 120, 3000)))]
        texts += [" ".join(base), " ".join(base[: rng.randint(3 * len(base) // 4, len(base))]), " ".join(base + ["x"] * rng.randint(0, 2))]
    sets = [set(np.unique(simhash._shingle_hashes(t, 2)).tolist()) for t in texts]
    frame = cut(docs(*enumerate(texts)))
    prints = cut(simhash.fingerprints(frame, 2, 4, True))
    ids = {r.fp: i for i, r in enumerate(prints.orderBy("place").collect())}
    none = prints.select(F.col("fp").alias("node"), F.col("fp").alias("root")).limit(0)
    got = {frozenset((ids[r.a], ids[r.b])) for r in simhash._prefix_pairs(frame, prints, none, 2, 0.8).collect()}
    want = {
        frozenset((i, j)) for i, j in itertools.combinations(sorted(ids.values()), 2) if sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
    }
    assert len(want) > 50 and want <= got
