"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped to score.

Counting goes through shards of hashes. A task cuts its tokens into chunks, sorts and counts each chunk's hashes, and sends
one block per shard; a shard's task merges the blocks of all. First the tokens are counted (``uni``), then pairs of token and
predecessor (``bi``), dealt by the predecessor so that its totals meet in one shard; a predecessor with over a quarter of a
shard's share of tokens is dealt by the pair. There are at most four such words per shard. Number and size of shards
follow from the count of tokens, so no task grows with the corpus.

The arrays are files in the shared folder: per shard the sorted 64-bit hashes and a column per count. Workers map
them (a store without a file system is copied to an unlinked local file first), so their memory holds only pages in use. Counts
are stored and not probabilities, since the discounts depend on the counts of all shards.

P(w | v) = (c(vw) - D(c(vw))) / c(v) + g(v) P(w);  P(w) = (n(w) - E(n(w))) / B + e / (V + 1)

with n(w) the number of distinct predecessors of w, B the distinct pairs, V the distinct tokens, D and E the three modified
discounts of pairs and of n, g and e the mass they set free. The uniform part covers unknown tokens. A text is its
lower-cased words and one end; the word before the first is a start mark that is never predicted.

Null and empty texts are one end token. A null ``doc_id`` is not held out. Repeated rows count as often as they come. A model
without training text gives every token probability 1. Other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelytics import session
from storelytics.llm.common import cut, memo

SHARD_TOKENS = 1_000_000
CHUNK_TOKENS = 1_000_000
SCORE_TOKENS = 250_000
# Words hold no white space, so these marks are no word's hash.
START, END = xxhash.xxh64_intdigest(b" start"), xxhash.xxh64_intdigest(b" end")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _tokens(text: str | None) -> np.ndarray:
    """Hashes of the words and the end."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def _before(tokens: np.ndarray) -> np.ndarray:
    """The token before each, the start mark before the first of a text; texts follow each other, parted by ends."""
    out = np.empty_like(tokens)
    out[0] = START
    out[1:] = np.where(tokens[:-1] == np.uint64(END), np.uint64(START), tokens[:-1])
    return out


def _pair(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    x = before * _MIX + tokens
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(8)) % np.uint64(shards)).astype(np.int64)


def _pair_shard(before, pairs, hot, shards):
    busy = np.isin(before, hot) if len(hot) else np.zeros(len(before), bool)
    return _shard(np.where(busy, pairs, before), shards)


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[np.ndarray]:
    """Token hashes of whole texts, about ``limit`` at a time."""
    held, size = [], 0
    for batch in batches:
        for text in batch.column("text"):
            held.append(_tokens(text.as_py()))
            size += len(held[-1])
            if size >= limit:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``keys`` in order, with the sums of their rows of ``values``."""
    order = np.argsort(keys[:, 0], kind="stable") if keys.shape[1] == 1 else np.lexsort(keys.T[::-1])
    keys, values = keys[order], values[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    at = np.flatnonzero(first)
    return keys[at], (np.add.reduceat(values, at, axis=0) if len(at) else values)


_BLOCK = "kind string, shard int, keys binary, counts binary"


def _blocks(kind: str, keys: np.ndarray, values: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """One row per shard: its sorted keys and their counts, column by column, which packs well."""
    order = np.argsort(shard, kind="stable")
    keys, values, shard = keys[order], values[order], shard[order]
    at = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
    ends = [*at[1:].tolist(), len(shard)]
    rows = [(kind, int(shard[a]), keys[a:b].T.tobytes(), values[a:b].T.tobytes()) for a, b in zip(at.tolist(), ends)]
    kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["kind", "shard", "keys", "counts"])


def _merge(blocks: DataFrame, widths: dict[str, tuple[int, int]], done, schema: str) -> DataFrame:
    """``done(kind, shard, keys, counts)`` for every shard of every kind; ``widths`` are columns of keys and counts.

    Blocks of a shard are merged as they come, so a task holds one shard's distinct keys and a few blocks.
    """

    def fold(kind, held):
        k, v = widths[kind]
        keys = np.concatenate([np.frombuffer(x, np.uint64).reshape(k, -1).T for x, _ in held])
        counts = np.concatenate([np.frombuffer(y, np.int64).reshape(v, -1).T for _, y in held])
        return _summed(keys, counts)

    def scan(batches):
        now, held, size = None, [], 0
        for batch in batches:
            for kind, shard, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("kind", "shard", "keys", "counts"))):
                if (kind, shard) != now and held:
                    yield from done(*now, *fold(now[0], held))
                    held, size = [], 0
                now = (kind, shard)
                held.append((keys, counts))
                size += len(keys)
                if size > 16 << 20:
                    held, size = [tuple(x.T.tobytes() for x in fold(kind, held))], 0
        if held:
            yield from done(*now, *fold(now[0], held))

    return blocks.repartition("kind", "shard").sortWithinPartitions("kind", "shard").mapInArrow(scan, schema)


def _put(folder: str, name: str, keys: np.ndarray, columns: np.ndarray) -> None:
    """One array file: three numbers, the keys, then the columns in the narrowest integers that hold them. Written aside, then renamed."""
    where, path = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
    where.create_dir(path, recursive=True)
    aside = f"{path}/.{name}-{os.getpid()}-{os.urandom(4).hex()}"
    packed = np.ascontiguousarray(columns.T).astype(np.min_scalar_type(int(columns.max(initial=0))))
    with where.open_output_stream(aside) as out:
        out.write(np.array([len(keys), columns.shape[1] if columns.ndim > 1 else 1, packed.itemsize], np.int64).tobytes())
        out.write(keys.tobytes())
        out.write(packed.tobytes())
    where.move(aside, f"{path}/{name}")


def _mapped(folder: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and columns (one per row) of an array file; empty if no key fell into the shard."""
    where, path = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
    if where.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
        return np.empty(0, np.uint64), np.empty((0, 0), np.int64)
    if isinstance(where, fs.LocalFileSystem):
        raw = np.memmap(f"{path}/{name}", np.uint8, "r")
    else:
        with tempfile.NamedTemporaryFile() as local:
            with where.open_input_stream(f"{path}/{name}") as source:
                while block := source.read(8 << 20):
                    local.write(block)
            local.flush()
            raw = np.memmap(local.name, np.uint8, "r")
    n, width, size = raw[:24].view(np.int64).tolist()
    return raw[24 : 24 + 8 * n].view(np.uint64), raw[24 + 8 * n :].view(f"u{size}").reshape(width, n)


@dataclass(frozen=True)
class Model:
    """Where the arrays are, how they are dealt, and the few numbers all of them share."""

    folder: str
    shards: int
    hot: tuple[int, ...]
    tokens: int
    types: int
    pairs: int
    pair_discounts: tuple[float, float, float]
    type_discounts: tuple[float, float, float]
    spare: float

    def find(self, kind: str, hashes: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Count columns of each hash, zeros where it is not stored."""
        open_ = memo("kneser_ney")
        if open_.get("folder") != self.folder:
            open_.clear()
            open_["folder"] = self.folder
        width = {"uni": 2, "ctx": 4, "bi": 1}[kind]
        out = np.zeros((width, len(hashes)), np.int64)
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if not len(part):
                continue
            name = f"{kind}-{shard[part[0]]}"
            if name not in open_:
                open_[name] = _mapped(self.folder, name)
            keys, columns = open_[name]
            at = np.searchsorted(keys, hashes[part])
            ok = np.flatnonzero(at < len(keys))
            ok = ok[keys[at[ok]] == hashes[part[ok]]]
            if len(ok):
                out[:, part[ok]] = columns[:, at[ok]]
        return out

    def token_scores(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, base, score) of each token; texts follow each other, parted by ends."""
        hot = np.array(self.hot, np.uint64)
        words, at = np.unique(tokens, return_inverse=True)
        count, before_n = self.find("uni", words, _shard(words, self.shards))
        base = np.log10((count + 1) / (self.tokens + self.types + 1))
        e = np.array([0.0, *self.type_discounts])
        single = (before_n - e[np.minimum(before_n, 3)]) / max(self.pairs, 1) + self.spare / (self.types + 1)
        before = _before(tokens)
        pairs, first, pair_at = np.unique(_pair(before, tokens), return_index=True, return_inverse=True)
        seen = self.find("bi", pairs, _pair_shard(before[first], pairs, hot, self.shards))[0][pair_at]
        contexts, context_at = np.unique(before, return_inverse=True)
        total, one, two, more = self.find("ctx", contexts, _shard(contexts, self.shards))
        d = np.array([0.0, *self.pair_discounts])
        free = np.where(total > 0, (d[1] * one + d[2] * two + d[3] * more) / np.maximum(total, 1), 1.0)[context_at]
        p = (seen - d[np.minimum(seen, 3)]) / np.maximum(total, 1)[context_at] + free * single[at]
        return (count > 0)[at], base[at], np.log10(p)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of things counted once to four times.

    Where a class is missing the closed form is undefined or out of range; it then falls back to half the absolute discount.
    """
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    closed = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else -1.0 for k in (1, 2, 3)]
    return tuple(c if 0 < c < k else y * k / 2 or 0.5 for k, c in zip((1, 2, 3), closed))


def _counted_once_to_four(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


def train(docs: DataFrame, shard_tokens: int = SHARD_TOKENS) -> Model:
    """Count ``docs`` (text) and write the model's arrays to the shared folder."""
    spark = docs.sparkSession
    folder = session.scratch_path(spark, "bigrams")
    text = docs.select("text")
    # The number of shards must not depend on what a task sees, so it comes from the characters of all texts.
    letters = text.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(8, -(-letters // (6 * shard_tokens)))

    def uni(batches):
        for tokens in _chunks(batches, CHUNK_TOKENS):
            keys, counts = np.unique(tokens, return_counts=True)
            yield _blocks("uni", keys[:, None], counts.astype(np.int64)[:, None], _shard(keys, shards))

    def as_block(kind, shard, keys, counts):
        yield _blocks(kind, keys, counts, np.full(len(keys), shard))

    merged = cut(_merge(text.mapInArrow(uni, _BLOCK), {"uni": (1, 1)}, as_block, _BLOCK))
    tokens, types = (x or 0 for x in merged.mapInArrow(_totals, "n bigint, types bigint").agg(F.sum("n"), F.sum("types")).first())
    busy = merged.mapInArrow(_above(tokens / (4 * shards)), "word bigint").collect()  # under 4 per shard
    # The start mark comes before every text.
    hot = tuple(sorted({START, *(r.word & (2**64 - 1) for r in busy)}))

    def bi(batches):
        of = np.array(hot, np.uint64)
        for tokens in _chunks(batches, CHUNK_TOKENS):
            before = _before(tokens)
            keys, counts = _summed(np.stack([before, tokens], axis=1), np.ones((len(tokens), 1), np.int64))
            yield _blocks("bi", keys, counts, _pair_shard(keys[:, 0], _pair(keys[:, 0], keys[:, 1]), of, shards))

    def bi_done(_, shard, keys, counts):
        pairs, n = _pair(keys[:, 0], keys[:, 1]), counts[:, 0]
        order = np.argsort(pairs)
        _put(folder, f"bi-{shard}", pairs[order], n[order])
        classes = np.stack([n, n == 1, n == 2, n > 2], axis=1).astype(np.int64)
        contexts, sums = _summed(keys[:, :1], classes)
        yield _blocks("ctx", contexts, sums, _shard(contexts[:, 0], shards))
        words, seen = _summed(keys[:, 1:], np.ones((len(keys), 1), np.int64))
        yield _blocks("sfx", words, np.concatenate([np.zeros_like(seen), seen], axis=1), _shard(words[:, 0], shards))
        numbers = np.array([_counted_once_to_four(n)], np.int64)
        yield _blocks("num", np.array([[0]], np.uint64), numbers, np.array([0]))

    counted = cut(_merge(text.mapInArrow(bi, _BLOCK), {"bi": (2, 1)}, bi_done, _BLOCK))

    def widen(batches):  # token counts as rows of (count, distinct predecessors), to meet the latter
        for batch in batches:
            for shard, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "keys", "counts"))):
                n = np.frombuffer(counts, np.int64)
                yield _blocks("sfx", np.frombuffer(keys, np.uint64)[:, None], np.stack([n, np.zeros_like(n)], axis=1), np.full(len(n), shard))

    def last_done(kind, shard, keys, counts):
        if kind == "num":
            yield pa.RecordBatch.from_arrays([pa.array(["pairs"]), pa.array([counts[0].tolist()], pa.list_(pa.int64())), pa.array([0], pa.int64())], ["of", "n", "pairs"])
            return
        _put(folder, f"{'uni' if kind == 'sfx' else kind}-{shard}", keys[:, 0], counts)
        if kind == "sfx":
            n = counts[:, 1]
            yield pa.RecordBatch.from_arrays([pa.array(["types"]), pa.array([_counted_once_to_four(n)], pa.list_(pa.int64())), pa.array([int(n.sum())], pa.int64())], ["of", "n", "pairs"])

    blocks = counted.unionByName(merged.mapInArrow(widen, _BLOCK))
    numbers = cut(_merge(blocks, {"ctx": (1, 4), "sfx": (1, 2), "num": (1, 4)}, last_done, "of string, n array<bigint>, pairs bigint"))
    sums = {
        r.of: r for r in numbers.groupBy("of").agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(4)], F.sum("pairs").alias("pairs")).collect()
    }
    once = {k: [sums[k][f"n{i}"] for i in range(4)] if k in sums else [0] * 4 for k in ("pairs", "types")}
    pairs = sums["types"].pairs if "types" in sums else 0
    of_types = _discounts(once["types"])
    more = types - once["types"][0] - once["types"][1]
    spare = (of_types[0] * once["types"][0] + of_types[1] * once["types"][1] + of_types[2] * more) / pairs if pairs else 1.0
    return Model(folder, shards, hot, tokens, types, pairs, _discounts(once["pairs"]), of_types, spare)


def _totals(batches):
    """Tokens and distinct tokens of each block of token counts."""
    for batch in batches:
        counts = [np.frombuffer(c, np.int64) for c in batch.column("counts").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array(list(map(len, counts)), pa.int64())], ["n", "types"])


def _above(limit: float):
    """The words counted more than ``limit`` times."""

    def scan(batches):
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                busy = np.frombuffer(keys, np.int64)[np.frombuffer(counts, np.int64) > limit]
                yield pa.RecordBatch.from_arrays([pa.array(busy)], ["word"])

    return scan


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """(*keep, n_tokens, n_known, base_score, score) per row; the scores are log10 probabilities of the whole text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held, sizes, size, out = batch.column("text"), [], [], 0, []
            for i in range(len(texts)):
                held.append(_tokens(texts[i].as_py()))
                sizes.append(len(held[-1]))
                size += sizes[-1]
                if size >= SCORE_TOKENS or i == len(texts) - 1:
                    known, base, p = model.token_scores(np.concatenate(held))
                    at = np.cumsum([0, *sizes])[:-1]
                    out.append([np.add.reduceat(x, at) for x in (np.ones(len(p), np.int64), known.astype(np.int64), base, p)])
                    held, sizes, size = [], [], 0
            if out:
                columns = [pa.array(np.concatenate(c)) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, "n_tokens", "n_known", "base_score", "score"])

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*kinds, "n_tokens bigint, n_known bigint, base_score double, score double"])
    return docs.select(*keep, "text").mapInArrow(scan, schema)


def held_out(column: str = "doc_id", of: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % of == remainder, F.lit(False))


def scored(docs: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Train on all but the held-out documents and score all of them."""
    marked = docs.select("doc_id", "text", held_out().alias("held_out"))
    model = train(marked.filter(~F.col("held_out")), shard_tokens)
    return score(marked, model, "doc_id", "held_out").withColumn("train_tokens", F.lit(model.tokens).cast("long"))
