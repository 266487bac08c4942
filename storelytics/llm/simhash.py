"""Near-duplicate documents by SimHash and BK-trees.

Every text becomes a SimHash fingerprint: one bit per bit of its shingles' hashes, set if over half of them have it. By ``blocks``
repeated shingles count as often as they occur, by ``samples`` once.
Equal fingerprints are one node from then on, so copies are never compared. Nodes are dealt to shards; the nodes of
a shard form a BK-tree, whose children are keyed by their integer Hamming distance to the parent, and a query
follows only the edges within the radius of its own distance. What is within the radius of a node both are linked to is not
compared again, so a dense group costs a shard no comparison of all pairs. Shards are made of bits of the fingerprint, by one of two rules:

* ``blocks`` (small radius r): the bits are cut into r + 2 blocks. Fingerprints at r or fewer differing bits agree
  in at least two blocks, so shards by pairs of blocks lose no link.
* ``samples`` (similarity): random samples of the bits, of as many bits as leave a shard about ``SHARD_TEXTS`` nodes. There are so many samples
  that a pair of texts at the similarity agrees in none of them with probability ``MISSED`` at most. They are drawn from ``DRAWN`` lanes of
  64 bits, of which the trees get the first ``lanes``; more bits make the samples less alike. ``ROUND`` samples are searched at a time, so
  the shuffle files on disk are those of one round however many samples there are.

The samples and the radius may lose a pair, and lose more of texts of few shingles, whose bits differ more. So prefixes of the sets find what the trees do
not: in any one order of all shingles, two sets of the similarity share one of their first few, so many as their sizes tell (``_prefix_pairs``). Pairs that share
one and are in no component of candidates together are kept if the numbers of their shingles in buckets of hashes, which differ by no more
than the sets do, allow the similarity. Neither step loses a pair. The order puts shingles last that batches of texts often hold; it decides what
is compared and not what is found.

By similarity the trees give candidates only: their radius is the distance expected at that similarity and ``SPREAD`` standard deviations
more. Inside each component of candidates the sets of shingles (distinct 64-bit hashes) are then compared in full, and only texts whose
Jaccard similarity is reached are linked. A component of over ``SET_NODES`` sets or ``SET_BYTES`` of hashes is dealt into
chunks, each two of which meet in one task.

The shard trees go to their queries by a shuffle on the shard, not through the driver: together they hold all
fingerprints. A shard of over ``SHARD_NODES`` nodes is dealt into chunks, with one tree for each two of them, so no task
holds more than a bounded tree. Each tree returns a star per local component, not its pairs; the stars are joined up by
``components``.

Null and empty texts have no words and get the fingerprint zero, linked like any other. A null ``doc_id`` keeps its row and
links but names no component unless all of it are null. Repeated rows are equal nodes. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelytics.llm.common import cut
from storelytics.llm.components import components

SEED = 42
SHARD_NODES = 4096
DRAWN = 8
SHARD_TEXTS, MISSED, ROUND = 32, 0.002, 24
SPREAD = 4
COMMON, BUCKETS, PAIRS, SLACK = 2**18, 128, 2_000_000, 1e-9
SET_NODES, SET_BYTES = 2048, 16_000_000
GROUP = ["key", "i", "j"]
_CHUNK = 16384


def _shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of ASCII-lower-cased words, as unsigned 64-bit integers, repeats included."""
    joined = b" ".join((text or "").encode("utf-8", "replace").lower().split())
    if not joined:
        return np.empty(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    if len(gaps) < words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)][words - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(ends))


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A further independent 64-bit hash of each value."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bits(hashes: np.ndarray, lanes: int) -> bytes:
    """The fingerprint, most significant bit first."""
    out = []
    for lane in range(lanes):
        total = np.zeros(64, np.int64)
        for i in range(0, len(hashes), _CHUNK):
            part = hashes[i : i + _CHUNK]
            part = part if lane == 0 else _mixed(part, lane)
            total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint16)
        out.append(np.packbits(2 * total > len(hashes)).tobytes())
    return b"".join(out)


def _samples(nodes: int, angle: float) -> list[np.ndarray]:
    """Places of the sampled bits for ``nodes`` fingerprints, whose bits differ with probability ``angle`` in pairs that count."""
    bits = 64 * DRAWN
    size = min(40, max(0, math.ceil(math.log2(max(nodes, 1) / SHARD_TEXTS))))
    apart = np.arange(bits + 1)
    ways = np.array([math.lgamma(bits + 1) - math.lgamma(d + 1) - math.lgamma(bits - d + 1) for d in apart.tolist()])
    chance = np.exp(ways + apart * math.log(angle) + (bits - apart) * math.log1p(-angle))
    agree = np.prod([np.maximum(bits - apart - i, 0) / (bits - i) for i in range(size)], axis=0)  # 1 without bits
    count = 1
    while (chance * (1 - agree) ** count).sum() > MISSED:
        count += 1
    rng = np.random.default_rng(SEED)
    return [np.sort(rng.choice(bits, size, replace=False)) for _ in range(count)]


def _blocks(prints: np.ndarray, radius: int) -> list[np.ndarray]:
    """Keys of 64-bit fingerprints: each two of ``radius + 2`` blocks of bits."""
    edges = np.linspace(0, 64, radius + 3).astype(int)
    blocks = [(prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]
    pairs = combinations(range(radius + 2), 2)
    return [_mixed((blocks[i] << np.uint64(32)) | blocks[j], 1000 + n).view(np.int64) for n, (i, j) in enumerate(pairs)]


def _bucket_counts(hashes: np.ndarray) -> bytes:
    """How many of a set's shingles each bucket of hashes holds. Larger sets have more buckets, a power of two."""
    buckets = max(BUCKETS, 1 << max(0, len(hashes) // 16 - 1).bit_length())
    return np.bincount((hashes & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets).astype(np.uint16).tobytes()


def _may_reach(a: bytes, b: bytes, similarity: float) -> bool:
    """False only for two sets that by ``_bucket_counts`` differ in too many shingles for the similarity."""
    a, b = (np.frombuffer(x, np.uint16).astype(np.int64) for x in (a, b))
    width = min(len(a), len(b))
    apart = np.abs(a.reshape(-1, width).sum(axis=0) - b.reshape(-1, width).sum(axis=0)).sum()
    return apart <= (1 - similarity) / (1 + similarity) * (a.sum() + b.sum()) + SLACK


def fingerprints(docs: DataFrame, words: int, lanes: int, sets: bool) -> DataFrame:
    """(place, fp, drawn, counts, common): fingerprints of 64 x ``lanes`` bits and, for ``sets``, the ``DRAWN`` lanes that samples are taken from.

    For sets each distinct shingle counts once, as in Jaccard similarity, and a fingerprint is followed by 128 bits that tell its
    set of shingles from others of equal fingerprint. ``counts`` are those of ``_bucket_counts``; the first row of a batch lists
    as ``common`` the shingles that three or more of the batch's sets hold. Otherwise repeats count.
    ``place`` orders the rows: by doc_id, null ones last, then by their place in ``docs``.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, drawn, counts, held = [], [], [], {}
            for text in batch.column("text"):
                hashes = _shingle_hashes(text.as_py(), words)
                hashes = np.unique(hashes) if sets else hashes
                bits = _bits(hashes, max(lanes, DRAWN) if sets else lanes)
                prints.append(bits[: 8 * lanes] + (xxhash.xxh128_digest(hashes.tobytes()) if sets else b""))
                drawn.append(bits[: 8 * DRAWN] if sets else None)
                counts.append(_bucket_counts(hashes) if sets else None)
                if sets:
                    held[prints[-1]] = hashes
            found, times = np.unique(np.concatenate([np.empty(0, np.uint64), *held.values()]), return_counts=True)
            common = ([found[times > 2].view(np.int64)] if sets else [None]) + [None] * (len(prints) - 1)
            columns = [batch.column("doc_id"), batch.column("row"), *[pa.array(x, pa.binary()) for x in (prints, drawn, counts)]]
            columns.append(pa.array(common[: len(prints)], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "fp", "drawn", "counts", "common"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    found = placed.mapInArrow(scan, f"doc_id {kind}, row bigint, fp binary, drawn binary, counts binary, common array<bigint>")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row")
    return found.select(place.alias("place"), "fp", "drawn", "counts", "common")


def _block_keys(nodes: DataFrame, radius: int) -> DataFrame:
    """(key, fp): each node once per pair of blocks."""

    def scan(batches):
        for batch in batches:
            prints = np.frombuffer(b"".join(batch.column("fp").to_pylist()), ">u8").astype(np.uint64)
            for keys in _blocks(prints, radius):
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("fp")], ["key", "fp"])

    return nodes.mapInArrow(scan, "key bigint, fp binary")


def _sample_keys(nodes: DataFrame, samples: list[np.ndarray]) -> DataFrame:
    """(key, fp): each node of ``nodes`` (fp, drawn) once per sample, by the sample's number and the bits it takes."""

    def scan(batches):
        for batch in batches:
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column("drawn").to_pylist()), np.uint8)).reshape(-1, 64 * DRAWN)
            for number, sample in samples:
                keys = number << 40 | bits[:, sample].astype(np.int64) @ (1 << np.arange(len(sample), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("fp")], ["key", "fp"])

    samples = list(enumerate(samples))
    return nodes.mapInArrow(scan, "key bigint, fp binary")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return reduce(np.add, np.bitwise_count(a ^ b).T, np.zeros(len(a), np.int64))


class Forest:
    """One BK-tree per group of consecutive rows, all built and searched level by level.

    ``prints`` is (rows, lanes) of 64-bit words, ``roots[i]`` the first row of row i's group and its tree's root.
    """

    def __init__(self, prints: np.ndarray, roots: np.ndarray):
        self.prints, self.roots = prints, roots
        rows = np.flatnonzero(roots != np.arange(len(roots)))
        node, slots, children = roots[rows], [], []
        self.width = 64 * prints.shape[1] + 1
        self.passed: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # each row, a node above it, their distance
        while len(rows):
            apart = _distance(prints[rows], prints[node])
            self.passed.append((rows, node, apart.astype(np.int32)))
            slot = node * self.width + apart
            taken, first, where = np.unique(slot, return_index=True, return_inverse=True)
            slots.append(taken)
            children.append(rows[first])
            stay = np.ones(len(rows), bool)
            stay[first] = False
            rows, node = rows[stay], rows[first][where[stay]]
        slots = np.concatenate(slots) if slots else np.empty(0, np.int64)
        order = np.argsort(slots, kind="stable")
        self.slots, self.children = slots[order], (np.concatenate(children) if children else slots)[order]

    def above(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, node) pairs within the radius, of each row and the nodes on its way down."""
        for rows, nodes, apart in self.passed:
            yield rows[apart <= radius], nodes[apart <= radius]

    def links(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs that with those of ``above`` connect all rows within the radius of each other.

        Only edges within the radius of the distance are followed. From a node within the radius those up to the radius are left out too:
        the rows behind them are linked to that node already.
        """
        node = self.roots[queries]
        while len(queries):
            apart = _distance(self.prints[queries], self.prints[node])
            near = (apart <= radius) & (queries != node)
            yield queries[near], node[near]
            base = node * self.width
            low = np.searchsorted(self.slots, base + np.where(apart <= radius, radius + 1, apart - radius))
            high = np.searchsorted(self.slots, base + np.minimum(apart + radius, self.width - 1), "right")
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            queries, node = np.repeat(queries, n), self.children[at]


def _local_roots(forest: Forest, radius: int) -> np.ndarray:
    """The least row each row is connected to inside its tree. Queries go in blocks, so the frontier stays small."""
    label = np.arange(len(forest.roots))
    sizes = np.bincount(forest.roots, minlength=len(label))[forest.roots]
    block = np.cumsum(sizes) // 400_000
    queries = np.flatnonzero(sizes > 1)
    parts = np.split(queries, np.flatnonzero(np.diff(block[queries])) + 1)
    for a, b in chain(forest.above(radius), *(forest.links(part, radius) for part in parts)):
        while len(a):
            la, lb = label[a], label[b]
            apart = la != lb
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            if not len(a):
                break
            low = np.minimum(la, lb)
            np.minimum.at(label, np.maximum(la, lb), low)
            while np.any((jumped := label[label]) != label):
                label = jumped
    return label


def _stars(shards: DataFrame, group: list[str], lanes: int, radius: int) -> DataFrame:
    """(a, b): node a and the root of its component inside a shard's tree."""

    def solve(columns, prints):
        change = np.zeros(len(prints), bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        roots = np.maximum.accumulate(np.where(change, np.arange(len(prints)), 0))
        words = np.ascontiguousarray(np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1)[:, :lanes])
        label = _local_roots(Forest(words, roots), radius)
        moved = np.flatnonzero(label != np.arange(len(label)))
        ends = [pa.array([prints[i] for i in rows.tolist()], pa.binary()) for rows in (moved, label[moved])]
        return pa.RecordBatch.from_arrays(ends, ["a", "b"])

    def scan(batches):
        kept, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in group]
            kept = columns if kept is None else [np.concatenate(x) for x in zip(kept, columns)]
            held += batch.column("fp").to_pylist()
            if len(held) < 16 * SHARD_NODES:
                continue
            same = np.logical_and.reduce([c == c[-1] for c in kept])
            end = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last group may go on
            if end:
                yield solve([c[:end] for c in kept], held[:end])
                kept, held = [c[end:] for c in kept], held[end:]
        if held:
            yield solve(kept, held)

    return shards.select(*group, "fp").mapInArrow(scan, "a binary, b binary")


def links(shards: DataFrame, lanes: int, radius: int, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(a, b): stars of the components found in the shard trees of ``shards`` (key, fp), a written table or keys of one."""
    heavy = cut(
        shards.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > shard_nodes)
        .select("key", F.ceil(F.col("n") / shard_nodes).cast("int").alias("chunks"))
    )
    return _stars(_dealt(shards, heavy), GROUP, lanes, radius)


def _dealt(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """``rows`` (key, fp, ...) by key, sorted; those of a key in ``heavy`` (key, chunks) once for each two chunks (i, j)."""
    chunk = F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("chunks"))).cast("int")
    dealt = (
        rows.join(heavy, "key", "left")
        .withColumn("_mine", chunk)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
        .withColumns({"i": F.least("_mine", "_other"), "j": F.greatest("_mine", "_other")})
        .select(*GROUP, *[c for c in rows.columns if c != "key"])
    )
    return dealt.repartition(*GROUP).sortWithinPartitions(*GROUP, "fp")


def _alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The least row each set is connected to by sets of ``similarity`` or more; each set is ascending without repeats."""
    label = np.arange(len(sets))
    sizes = np.array([len(x) for x in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return label * (both / max(1, sizes.sum() - both) < similarity)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders = np.repeat(label, sizes)[np.argsort(codes, kind="stable")]
    upto = np.cumsum(np.bincount(codes))
    for row, mine in enumerate(np.split(codes, np.cumsum(sizes)[:-1])):
        if not label.any():
            break
        n = upto[mine] - np.where(mine, upto[mine - 1], 0)
        both = np.bincount(holders[np.repeat(upto[mine] - np.cumsum(n), n) + np.arange(n.sum())], minlength=len(sets))
        found = np.unique(label[(both / np.maximum(1, sizes + sizes[row] - both) >= similarity) | (label == label[row])])
        if len(found) > 1:
            label[np.isin(label, found)] = found[0]
    return label


def _first(sizes: np.ndarray | int, share: float) -> np.ndarray:
    """How many first shingles of a set one must look at, to meet any set that has ``share`` of its shingles."""
    return np.asarray(sizes - np.ceil(share * sizes - SLACK) + 1).astype(np.int64)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The columns of many whole groups at a time, with the groups' first rows. Rows are sorted by the first ``keys`` columns."""
    held, rows, enough = [], 0, 65_536
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows < enough:
                continue
        if not rows:
            continue
        columns = [np.concatenate(x) for x in zip(*held)]
        starts = np.append(0, np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:keys]])) + 1)
        end = rows if batch is None else int(starts[-1])  # the last group may go on
        if end:
            yield [c[:end] for c in columns], starts[starts < end]
        held, rows = [[c[end:] for c in columns]], rows - end
        enough = max(65_536, 2 * rows)


def _prefix_pairs(docs: DataFrame, prints: DataFrame, found: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): all fingerprints whose sets reach the similarity and that are not in one component of ``found`` (node, root), and some more.

    Of two sets of the similarity s both hold s / (1 + s) of the sum of their sizes; that is at least 2s / (1 + s) of the smaller and s of the larger set.
    In one order of all shingles the first that both hold is therefore among the first of each that hold more than the rest of it.
    """
    batches = prints.select(F.explode("common").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    most = batches.orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    common, times = most["key"].to_numpy().view(np.uint64), most["n"].to_numpy()
    order = np.argsort(common)
    common, times = common[order], times[order].astype(np.int32)
    smaller, both_hold = 2 * similarity / (1 + similarity), similarity / (1 + similarity)

    def listed(batches):
        for batch in batches:
            keys, sizes = [], []
            for text in batch.column("text"):
                hashes = np.unique(_shingle_hashes(text.as_py(), words))
                take = int(_first(len(hashes), similarity)) if len(hashes) else 0
                at = np.searchsorted(common, hashes)
                often = (common[np.minimum(at, len(common) - 1)] == hashes) if len(common) else np.zeros(len(hashes), bool)
                rare, late = hashes[~often], hashes[often]
                if len(rare) < take:
                    rare = np.append(rare, late[np.argsort(times[at[often]], kind="stable")])
                keys.append(rare[:take].view(np.int64))
                sizes.append(len(hashes))
            n = np.array([len(k) for k in keys], np.int64)
            spread = [np.repeat(batch.column(c).to_numpy(), n) for c in ("row", "part")]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            columns = [np.concatenate([np.empty(0, np.int64), *keys]), spread[0], np.repeat(np.array(sizes, np.int32), n), at.astype(np.int32), spread[1]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "fp", "size", "at", "part"])

    def shared(batches):
        for columns, starts in _whole_groups(batches, 1):
            least, most = (f.reduceat(columns[4], starts) for f in (np.minimum, np.maximum))
            rows = np.repeat(least != most, np.diff(np.append(starts, len(columns[0]))))
            yield pa.RecordBatch.from_arrays([pa.array(c[rows]) for c in columns], ["key", "fp", "size", "at", "part"])

    def paired(batches):
        for columns, starts in _whole_groups(batches, len(GROUP)):
            node, size, at, part = columns[len(GROUP) :]
            n = np.diff(np.append(starts, len(node)))
            start, n = np.repeat(starts, n), np.repeat(n, n)
            rows = np.flatnonzero(at < _first(size, smaller))
            for mine in np.split(rows, np.flatnonzero(np.diff(np.cumsum(n[rows]) // PAIRS)) + 1):
                k = n[mine]
                a = np.repeat(mine, k)
                b = np.repeat(start[mine] - np.cumsum(k) + k, k) + np.arange(k.sum())
                fit = (part[a] != part[b]) & (size[a] <= size[b]) & (size[a] >= similarity * size[b] - SLACK)
                a, b = a[fit], b[fit]
                fit = np.minimum(size[a] - at[a], size[b] - at[b]) >= both_hold * (size[a] + size[b]) - SLACK
                a, b = node[a[fit]], node[b[fit]]
                if len(a):
                    ends = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

    def reached(batches):
        for batch in batches:
            fits = [_may_reach(a, b, similarity) for a, b in zip(*[batch.column(c).to_pylist() for c in ("counts_a", "counts_b")])]
            yield pa.RecordBatch.from_arrays([batch.column("fp_a"), batch.column("fp_b")], ["a", "b"]).filter(pa.array(fits, pa.bool_()))

    first = cut(prints.groupBy("fp").agg(F.min("place.row").alias("row")))
    rooted = first.join(found.select(F.col("node").alias("fp"), "root").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    parts = first.select(F.col("fp").alias("root"), F.col("row").alias("part"))
    nodes = cut(rooted.join(parts.hint("merge"), "root").select("row", "part"))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "text").join(nodes.hint("merge"), "row")
    kind = "key bigint, fp bigint, size int, at int, part bigint"
    prefixes = texts.select("row", "part", "text").mapInArrow(listed, kind)
    kept = cut(prefixes.repartition("key").sortWithinPartitions("key").mapInArrow(shared, kind))
    heavy = cut(
        kept.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > SHARD_NODES)
        .select("key", F.ceil(F.col("n") / SHARD_NODES).cast("int").alias("chunks"))
    )
    pairs = cut(_dealt(kept, heavy).mapInArrow(paired, "a bigint, b bigint").distinct())
    for end in ("a", "b"):
        sets = prints.select(F.col("place.row").alias(end), F.col("fp").alias(f"fp_{end}"), F.col("counts").alias(f"counts_{end}"))
        pairs = pairs.join(sets.hint("merge"), end)
    return cut(pairs.select("fp_a", "fp_b", "counts_a", "counts_b").mapInArrow(reached, "a binary, b binary"))


def _verified(docs: DataFrame, prints: DataFrame, candidates: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): stars of the texts of ``similarity`` or more inside each component of ``candidates`` (a, b)."""

    def hashed(batches):
        for batch in batches:
            sets = [np.unique(_shingle_hashes(x.as_py(), words)).tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("fp"), pa.array(sets, pa.binary())], ["key", "fp", "hashes"])

    def solve(held):
        label = _alike([np.frombuffer(x, np.uint64) for _, x in held], similarity)
        moved = np.flatnonzero(label != np.arange(len(label)))
        ends = [pa.array([held[i][0] for i in rows.tolist()], pa.binary()) for rows in (moved, label[moved])]
        return pa.RecordBatch.from_arrays(ends, ["a", "b"])

    def compared(batches):
        last, held = None, []
        for batch in batches:
            for *group, fp, hashes in zip(*[x.to_pylist() for x in batch.columns]):
                if group != last:
                    if len(held) > 1:
                        yield solve(held)
                    last, held = group, []
                held.append((fp, hashes))
        if len(held) > 1:
            yield solve(held)

    found = cut(components(cut(candidates.distinct())))
    members = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    first = prints.groupBy("fp").agg(F.min("place.row").alias("row"))
    rows = cut(first.join(members.select(F.col("node").alias("fp"), F.col("root").alias("key")), "fp"))
    # As for the copies: texts of candidates grow with the corpus, so the join is a shuffle at every size.
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "text").join(rows.hint("merge"), "row")
    sets = cut(texts.select("key", "fp", "text").mapInArrow(hashed, "key binary, fp binary, hashes binary"))
    chunks = F.ceil(F.greatest(F.count("*") / SET_NODES, F.sum(F.length("hashes")) / SET_BYTES)).cast("int")
    heavy = cut(sets.groupBy("key").agg(chunks.alias("chunks")).filter("chunks > 1"))
    return _dealt(sets, heavy).mapInArrow(compared, "a binary, b binary")


def _classes(prints: DataFrame, stars: DataFrame) -> DataFrame:
    """(place, fp, least): each row with the least place in its fingerprint's component."""
    nodes = cut(prints.groupBy("fp").agg(F.min("place").alias("first")))
    found = components(cut(stars.distinct()))
    members = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    known = members.join(nodes.withColumnRenamed("fp", "node"), "node")
    linked = known.groupBy("root").agg(F.min("first").alias("linked"))
    linked = cut(members.join(linked, "root").select(F.col("node").alias("fp"), "linked"))
    least = cut(nodes.join(linked, "fp", "left").select("fp", F.coalesce("linked", "first").alias("least")))
    return prints.select("place", "fp").join(least, "fp")


def _components(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("place.id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("least.id").alias("component_id")
    )


def linked_fingerprints(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): exact components of 64-bit fingerprints at ``radius`` or fewer bits."""
    prints = cut(fingerprints(docs, words, 1, False).select("place", "fp"))
    shards = cut(_block_keys(prints.select("fp").distinct(), radius))
    return _components(_classes(prints, links(shards, 1, radius)))


def _near(docs: DataFrame, words: int, similarity: float, lanes: int) -> DataFrame:
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * lanes
    radius = math.ceil(bits * angle + SPREAD * math.sqrt(bits * angle * (1 - angle)))
    prints = cut(fingerprints(docs, words, lanes, True))
    nodes = cut(prints.select("fp", "drawn").distinct())
    samples = _samples(nodes.count(), angle)
    rounds = [
        cut(links(_sample_keys(nodes, samples[i : i + ROUND]), lanes, radius).distinct()) for i in range(0, len(samples), ROUND)
    ]
    found = cut(components(cut(reduce(DataFrame.unionByName, rounds).distinct())))
    others = _prefix_pairs(docs, prints, found, words, similarity)
    stars = _verified(docs, prints, found.toDF("a", "b").unionByName(others), words, similarity)
    return _classes(prints, stars).withColumn("fp", F.substring("fp", 1, bits // 8))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for texts of ``similarity`` (Jaccard, sets of shingles of ``words`` words) or more.

    Sets of Jaccard similarity s have a cosine of 2s / (1 + s), whose angle is the expected share of differing bits. ``docs`` must be
    a table at rest.
    """
    return _components(_near(docs, words, similarity, lanes))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = 4) -> DataFrame:
    """The first row of each group, by doc_id and then by place, all columns kept. ``docs`` must be a table at rest."""
    copies = _near(docs, words, similarity, lanes).filter("place <> least").select(F.col("place.row").alias("_row"))
    return docs.withColumn("_row", F.monotonically_increasing_id()).join(copies.hint("merge"), "_row", "left_anti").drop("_row")
