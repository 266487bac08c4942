"""The conversation trie against SQL, a dictionary of prefixes, and shards and queues of a few entries."""

import hashlib
import random
import re
import zlib

import pytest
from sqlcheck import mismatch

from storelytics.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(conv, []).append((turn is not None, turn or 0, tie, role, text))
    convs = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    members, ends = {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        # As SQL's remainder: towards zero.
        lead = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        path = tuple(convs.get(lead, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    kids, leaves, saved = {}, {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        saved[path] = saved.get(path, 0) + (len(members[path]) - 1) * words
        leaves[path] = leaves.get(path, 0) or 1
        if path:
            up = path[:-1]
            kids[up], leaves[up], saved[up] = kids.get(up, 0) + 1, leaves.get(up, 0) + leaves[path], saved.get(up, 0) + saved[path]
    return sorted((
        min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids.get(p, 0), leaves[p], saved[p],
        hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest(),
    ) for p, cs in members.items())


def got(spark, rows, **bounds):
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, prefix_trie.trie(*prefix_trie.rebuilt(frame), **bounds).collect()))


def test_the_sample_equals_sql(spark):
    assert mismatch(spark, "op11_conversation_prefix_trie") == []


def made(seed, convs, longest):
    """Conversations that share beginnings across and within groups, some of them copies."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-50, 50 + convs), convs):
        for t in range(rng.choice([0, 1, 2, 3, 3, 4, longest])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", None, "bot"]) if t > 2 else "user", f"turn {rng.randint(0, 1 + t // 2)}"))
    return rows


@pytest.mark.parametrize("seed,shard,queued", [(1, 7, 2), (2, 16, 1), (3, 1 << 14, 1 << 16)])
def test_random_conversations_in_small_shards(spark, seed, shard, queued):
    rows = made(seed, 60, 12)
    assert got(spark, rows, shard_rows=shard, queued=queued) == brute(rows)


def test_one_conversation_of_a_third_of_all_rows(spark):
    """A chain over many shards and a first turn that all others share."""
    rows = [(7, i, "user", f"w{i} x") for i in range(400)]
    rows += [(100 + c, i, "user", "hello" if i == 0 else f"{c} {i}") for c in range(400) for i in range(2)]
    assert got(spark, rows, shard_rows=50, queued=10) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "a", "b"), (1, None, None, None), (1, None, None, None), (1, 0, "user", ""), (2, 5, "1:", "x"), (3, 5, "1", ":x"),
        (4, 1, "user", "long " * 200_000), (20, 1, "user", "a\tb\nc"), (21, 1, "user", "a\tb\nc"), (22, 1, "user", "a\tb\nc"), (22, 1, "user", "é 😀"),
    ]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "a", "b")]) == []


def test_columns_of_any_name(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "2 AS digest", "3 AS piece", "4 AS shard", "5 AS `at`")
    assert sorted(map(tuple, prefix_trie.trie(*prefix_trie.rebuilt(frame)).collect())) == brute(rows)


def test_the_queue_spills_and_keeps_order():
    rng, queue, left = random.Random(0), prefix_trie.Queue(3), {}
    for key in range(50):
        for _ in range(rng.randint(0, 9)):
            later = rng.randint(key, 60)
            value = rng.random()
            queue.push((later,), (value,))
            left.setdefault(later, []).append((value,))
        assert sorted(queue.take((key,))) == sorted(left.pop(key, []))


def test_ends_of_a_crowded_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(1, 5, 6, c) for c in range(1, 500)] + [(2, 5, 6, 9)]
    found = {r.depth: r.ends_sha256 for r in prefix_trie.ends(spark.createDataFrame(rows, "depth long, ha long, hb long, conv_id long")).collect()}
    assert found == {1: hashlib.sha256(",".join(map(str, range(1, 500))).encode()).hexdigest(), 2: hashlib.sha256(b"9").hexdigest()}
