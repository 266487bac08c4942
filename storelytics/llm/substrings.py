"""Substring dedup with suffix automata over routed reference shards.

A window is ``length`` words in a row of one text; a word goes if any window over it also starts anywhere else. Comparing
every text with the automaton of every shard would grow with the square of the corpus, so texts and shards meet by anchors:

1. Within each window the ``GRAM``-word run of least hash is its anchor. Equal windows have equal anchors, so only windows
   of an anchor that occurs twice can repeat. Neighbouring windows of one anchor form a region, at most 2 x length words.
2. Equal regions of an anchor are counted before they move; one of them stands for all, with their number as weight.
3. The distinct regions of an anchor are a reference shard. A task builds the shard's generalized suffix automaton,
   sums the weights of each state's occurrences along the suffix links, then streams the regions through it. The matching
   statistic at a word is the longest run ending there that occurs twice or more; from ``length`` on, its window goes.
4. An anchor with over ``SHARD_REGIONS`` distinct regions (a common passage in ever new surroundings) is refined: its windows
   are shards of their own, known by 128 bits of hash; their automaton is one path, so the summed weight answers.
5. The windows found are joined back to all occurrences of their region and merged into spans per document.

No group is ever larger than a shard, and what the driver sees is nothing. Windows are judged on the input. Null and empty texts
have no words. Rows are told apart by their place, so repeated rows are copies of each other and null ids are no matter;
``docs`` must be a table at rest. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelytics.llm.common import cut

LENGTH = 35
GRAM = 16
SHARD_REGIONS = 50

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` values; runs are put together from halves."""
    if n == 1:
        return h
    half = _grams(h, n // 2)
    rest = _grams(h, n - n // 2) if n % 2 else half
    return _mixed(half[: len(h) - n + 1] * _BASE + rest[n // 2 : n // 2 + len(h) - n + 1])


def _regions(words: list[bytes], length: int, gram: int):
    """Arrays (anchor, region, first window, windows) of a text's regions."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    grams = _grams(h, gram)
    wide = np.lib.stride_tricks.sliding_window_view(grams, length - gram + 1)
    place = np.concatenate([wide[i : i + 65536].argmin(axis=1) for i in range(0, len(wide), 65536)]) + np.arange(len(wide))
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:], [len(place)])) - 1
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_mixed(h) * _powers(_BASE, len(h)), dtype=np.uint64)))
    region = _mixed((sums[last + length] - sums[first]) * _powers(_BACK, len(h))[first] + (last - first).astype(np.uint64))
    return grams[place[first]].view(np.int64), region.view(np.int64), first, last - first + 1


def regions(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(_row, anchor, region, first, windows) of every text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, text in zip(batch.column("_row").to_pylist(), batch.column("text")):
                words = (text.as_py() or "").encode("utf-8", "replace").split()
                if len(words) >= length:
                    found.append(_regions(words, length, gram))
                    rows.append(np.full(len(found[-1][0]), row, np.int64))
            if found:
                anchor, region, first, windows = (np.concatenate(x) for x in zip(*found))
                columns = [np.concatenate(rows), anchor, region, first.astype(np.int32), windows.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_row", "anchor", "region", "first", "windows"])

    return _placed(docs, "text").mapInArrow(scan, "_row bigint, anchor bigint, region bigint, first int, windows int")


def _placed(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("_row"), *columns)


class Automaton:
    """Generalized suffix automaton of weighted word sequences."""

    def __init__(self, texts: list[tuple[list[bytes], int]]):
        self.next, self.link, self.size, weight = [{}], [-1], [0], [0]
        for words, n in texts:
            last = 0
            for w in words:
                last = self._extend(last, w, weight)
                weight[last] += n
        # Weights of occurrences flow from longer states to their suffixes.
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            weight[self.link[v]] += weight[v]
        # The longest suffix of each state that occurs twice or more.
        self.twice = [0] * len(self.size)
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            self.twice[v] = self.size[v] if weight[v] > 1 else self.twice[self.link[v]]

    def _extend(self, last: int, w: bytes, weight: list[int]) -> int:
        nexts, link, size = self.next, self.link, self.size
        q = nexts[last].get(w)
        if q is not None:
            return q if size[q] == size[last] + 1 else self._clone(last, w, q, weight)
        made = len(size)
        nexts.append({})
        link.append(0)
        size.append(size[last] + 1)
        weight.append(0)
        p = last
        while p >= 0 and w not in nexts[p]:
            nexts[p][w] = made
            p = link[p]
        if p >= 0:
            q = nexts[p][w]
            link[made] = q if size[q] == size[p] + 1 else self._clone(p, w, q, weight)
        return made

    def _clone(self, p: int, w: bytes, q: int, weight: list[int]) -> int:
        nexts, link, size = self.next, self.link, self.size
        made = len(size)
        nexts.append(dict(nexts[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        weight.append(0)
        link[q] = made
        while p >= 0 and nexts[p].get(w) == q:
            nexts[p][w] = made
            p = link[p]
        return made

    def statistics(self, words: list[bytes]) -> Iterator[int]:
        """Per word of an inserted text: the longest run ending there that occurs twice or more."""
        state = 0
        for w in words:
            state = self.next[state][w]
            yield self.twice[state]


def _fetch(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Words of the regions that stand for their like; windows of refined anchors as 128-bit keys instead.

    ``wanted``: (_row, anchor, region, first, windows, n, refine).
    """
    lists = wanted.groupBy("_row").agg(F.collect_list(F.struct("anchor", "region", "first", "windows", "n", "refine")).alias("w"))

    def scan(batches):
        names = ["anchor", "region", "n", "words", "at", "key"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary()]
        for batch in batches:
            rows = []
            for text, listed in zip(batch.column("text"), batch.column("w")):
                words = (text.as_py() or "").encode("utf-8", "replace").split()
                for r in listed.as_py():
                    a, m = r["first"], r["windows"]
                    if not r["refine"]:
                        rows.append((r["anchor"], r["region"], r["n"], b" ".join(words[a : a + m + length - 1]), None, None))
                        continue
                    for i in range(m):
                        key = xxhash.xxh3_128_digest(b" ".join(words[a + i : a + i + length]))
                        rows.append((r["anchor"], r["region"], r["n"], None, i, key))
                    if len(rows) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    joined = _placed(docs, "text").join(lists, "_row").select("text", "w")
    return joined.mapInArrow(scan, "anchor bigint, region bigint, n bigint, words string, at int, key binary")


def _matched(shards: DataFrame, length: int) -> DataFrame:
    """(anchor, region, at): places in each region where a repeated window starts, from the shards' automata."""

    def solve(group):
        texts = [(words, n) for _, n, words in group]
        automaton = Automaton(texts)
        for region, _, words in group:
            at = [i - length + 1 for i, s in enumerate(automaton.statistics(words)) if s >= length]
            if at:
                yield region, at

    def scan(batches):
        def emit(out):
            anchor, region, at = zip(*out)
            columns = [pa.array(anchor, pa.int64()), pa.array(region, pa.int64()), pa.array(at, pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, ["anchor", "region", "at"])

        key, group, out = None, [], []
        for batch in batches:
            for anchor, region, n, words in zip(*(batch.column(c).to_pylist() for c in ("anchor", "region", "n", "words"))):
                if anchor != key and group:
                    out += [(key, *r) for r in solve(group)]
                    group = []
                key = anchor
                group.append((region, n, words.encode().split()))
            if len(out) > 10_000:
                yield emit(out)
                out = []
        if group:
            out += [(key, *r) for r in solve(group)]
        if out:
            yield emit(out)

    dealt = shards.select("anchor", "region", "n", "words").repartition("anchor").sortWithinPartitions("anchor", "region")
    return dealt.mapInArrow(scan, "anchor bigint, region bigint, at array<int>")


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_regions: int = SHARD_REGIONS) -> DataFrame:
    """(_row, starts): the places of all windows that start elsewhere too, for rows that have any."""
    every = cut(regions(docs, length, gram))
    twice = cut(every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
    every = cut(every.join(twice, "anchor", "left_semi"))
    distinct = cut(
        every.groupBy("anchor", "region")
        .agg(F.count("*").alias("n"), F.min(F.struct("_row", "first", "windows")).alias("one"))
        .select("anchor", "region", "n", "one.*")
    )
    refined = cut(
        distinct.groupBy("anchor").agg(F.count("*").alias("c")).filter(F.col("c") > shard_regions).select("anchor", F.lit(True).alias("refine"))
    )
    wanted = distinct.join(refined, "anchor", "left").withColumn("refine", F.coalesce("refine", F.lit(False)))
    fetched = cut(_fetch(docs, wanted, length))
    single = fetched.filter("key is not null").select("anchor", "region", "n", "at", "key")
    again = cut(single.groupBy("key").agg(F.sum("n").alias("w")).filter("w > 1").select("key"))
    refound = single.join(again, "key", "left_semi").groupBy("anchor", "region").agg(F.collect_list("at").alias("at"))
    marks = cut(_matched(fetched.filter("words is not null"), length).unionByName(refound))
    found = every.join(marks, ["anchor", "region"]).select("_row", F.explode(F.transform("at", lambda i: i + F.col("first"))).alias("s"))
    return found.groupBy("_row").agg(F.collect_list("s").alias("starts"))


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_regions: int = SHARD_REGIONS) -> DataFrame:
    """(doc_id, n_words, n_removed, text): every document, its kept words joined by one space."""

    def scan(batches):
        for batch in batches:
            n, gone, kept = [], [], []
            for text, starts in zip(batch.column("text"), batch.column("starts")):
                words = (text.as_py() or "").encode("utf-8", "replace").split()
                cover = np.zeros(len(words) + 1, np.int64)
                if starts.is_valid:
                    at = starts.values.to_numpy()
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + length, -1)
                stays = np.cumsum(cover[:-1]) == 0
                n.append(len(words))
                gone.append(len(words) - int(stays.sum()))
                kept.append(b" ".join(words if not gone[-1] else [w for w, s in zip(words, stays.tolist()) if s]))
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "text"])

    found = cut(spans(docs, length, gram, shard_regions))
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = _placed(docs, "doc_id", "text").join(found.hint("merge"), "_row", "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(scan, f"doc_id {kind}, n_words bigint, n_removed bigint, text string")
