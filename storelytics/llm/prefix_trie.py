"""Conversations as a prefix trie, its subtree totals by time-forward processing.

A node is a distinct sequence of first turns. It is known by its depth and 128 bits that are combined from a hash of each turn at its place,
so the hashes of all prefixes are a running combination, and a conversation of any length is cut into pieces whose
combinations are carried over like running sums: no task holds a whole conversation. A node's name is its least member and its depth.

``totals`` sums over subtrees. Nodes are sorted by name and cut into shards of ``SHARD`` nodes. Within a shard they are sorted by reverse
level order, Spark's sort doing that outside memory, and every node sends its totals forward to its parent through a priority queue in the same
order; the queue spills sorted runs beyond ``QUEUED`` entries. A node whose parent lies in another shard is a shard root. What shard roots
send is summed per parent, and those parents, linked to the next such node above them, are a far smaller forest whose subtree totals are
found in the same way, with larger shards each time, until one shard is left. A second pass through the shards then starts from what
arrives from outside. A node with a million children gets one sum from each shard.

Null roles and texts are empty ones, a null turn comes first, turns of one number go by their MD5. Rows without conv_id belong to no conversation
and have no node. Repeated rows are turns of their own. Texts are hashed whole, however long. An empty table has no nodes, not even a
root. Of the input only conv_id, turn, role and text are read, so other columns may be called anything.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from storelytics.functions.ids import dense_ids
from storelytics.llm.common import SPACE_WORDS, cut

SHARD, GROWTH, QUEUED, CHUNK = 1 << 10, 4, 1 << 16, 4096
NOTHING = hashlib.sha256(b"").hexdigest()
_BEFORE = Window.unboundedPreceding, -1


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, piece, at, digest, words): turns in order; a conversation's turns lie in pieces, in order of ``piece`` and ``at``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = cut(conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.size(F.regexp_extract_all(text, F.lit(SPACE_WORDS), F.lit(0))).cast("long").alias("words"),
    ))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    place = F.monotonically_increasing_id()
    return cut(turns.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.shiftright(place, 33).alias("piece"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), "digest", "words"
    ))


def pieces(turns: DataFrame) -> DataFrame:
    """(conv_id, piece, first, before): where each piece begins and how many of the conversation's turns lie before it."""
    sizes = turns.groupBy("conv_id", "piece").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("piece").rowsBetween(*_BEFORE))
    return sizes.withColumn("before", F.coalesce(before, F.lit(0)))


def _hashes(depth: Column, digest: Column) -> tuple[Column, Column]:
    """Two hashes of a turn at its depth, each from its own half of the digest."""
    return F.xxhash64(depth, F.substring(digest, 1, 16)), F.xxhash64(F.substring(digest, 17, 16), depth)


def rebuilt(conversations: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their group: (members, conversations).

    Conversation c takes the first h turns of conversation c - c % ``group`` and its own after its first h; h is a checksum of c modulo
    ``heads``. Members are (conv_id, depth, ha, hb, pa, pb, words, end): a row per rebuilt turn, the hashes of the prefix that ends there
    and of the one before. Conversations are (conv_id, turns).
    """
    turns = ordered(conversations)
    parts = cut(pieces(turns))
    lengths = parts.groupBy("conv_id").agg(F.sum("n").alias("own"))
    leader = F.col("conv_id") - F.col("conv_id") % group
    spoken = F.col("at") - F.col("first") + F.col("before")
    first = turns.filter(F.col("conv_id") % group == 0).join(parts, ["conv_id", "piece"]).withColumn("depth", (spoken + 1).cast("long"))
    a, b = _hashes(F.col("depth"), F.col("digest"))
    lead = first.filter(F.col("depth") < heads).groupBy(F.col("conv_id").alias("leader")).agg(
        F.sort_array(F.collect_list(F.struct("depth", a.alias("a"), b.alias("b"), "words"))).alias("lead")
    )
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    whole = lengths.withColumn("leader", leader).withColumn("h", h).join(lead, "leader", "left")
    head = F.slice(F.coalesce("lead", F.array().cast(lead.schema["lead"].dataType)), F.lit(1), F.col("h").cast("int"))
    convs = cut(whole.select("conv_id", "own", "h", head.alias("head")).withColumn(
        "turns", F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    ))

    def mixed(of: str, upto) -> Column:
        return F.aggregate(F.slice("head", F.lit(1), upto), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x[of]))

    of_head = convs.select("conv_id", "turns", "head", F.posexplode("head").alias("i", "x")).select(
        "conv_id", F.col("x.depth").alias("depth"), mixed("a", F.col("i") + 1).alias("ha"), mixed("b", F.col("i") + 1).alias("hb"),
        mixed("a", F.col("i")).alias("pa"), mixed("b", F.col("i")).alias("pb"), F.col("x.words").alias("words"),
        (F.col("x.depth") == F.col("turns")).alias("end"),
    )
    about = parts.join(convs.select("conv_id", "h", F.size("head").alias("kept"), "turns"), "conv_id")
    own = turns.join(about, ["conv_id", "piece"]).withColumn("spoken", spoken).filter("spoken >= h").withColumn(
        "depth", F.col("spoken") - F.col("h") + F.col("kept") + 1
    ).select("conv_id", "piece", "at", "depth", a.alias("a"), b.alias("b"), "words", (F.col("depth") == F.col("turns")).alias("end"))
    so_far = Window.partitionBy("conv_id", "piece").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    running = cut(own.withColumns({"ha": F.bit_xor("a").over(so_far), "hb": F.bit_xor("b").over(so_far)}))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(*_BEFORE)
    sums = running.groupBy("conv_id", "piece").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    carried = sums.withColumns({c: F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)) for c in "ab"})
    carried = carried.join(convs.select("conv_id", mixed("a", F.size("head")).alias("xa"), mixed("b", F.size("head")).alias("xb")), "conv_id").select(
        "conv_id", "piece", F.col("a").bitwiseXOR(F.col("xa")).alias("ca"), F.col("b").bitwiseXOR(F.col("xb")).alias("cb")
    )
    ha, hb = F.col("ha").bitwiseXOR(F.col("ca")), F.col("hb").bitwiseXOR(F.col("cb"))
    of_own = running.join(carried, ["conv_id", "piece"]).select(
        "conv_id", "depth", ha.alias("ha"), hb.alias("hb"), ha.bitwiseXOR(F.col("a")).alias("pa"), hb.bitwiseXOR(F.col("b")).alias("pb"), "words", "end"
    )
    return cut(of_head.unionByName(of_own)), convs.select("conv_id", "turns")


def ends(members: DataFrame) -> DataFrame:
    """(depth, ha, hb, ends_sha256) from (depth, ha, hb, conv_id): the hash of each node's conversations in order, comma-joined.

    Ids are joined to texts of up to ``CHUNK`` ids side by side; only those texts of a node come together, and stream through one hash.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids = None, None, []

        def closed(out):
            if ids:
                out.append((*node, first, ",".join(map(str, ids))))

        for batch in batches:
            out: list[tuple] = []
            for depth, a, b, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, a, b) != node or len(ids) >= CHUNK:
                    closed(out)
                    node, first, ids = (depth, a, b), conv, []
                ids.append(conv)
            yield _rows(out, CHUNKS)
        out = []
        closed(out)
        yield _rows(out, CHUNKS)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for depth, a, b, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, a, b) == node:
                    state.update(b"," + text.encode())
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (depth, a, b), hashlib.sha256(text.encode())
            yield _rows(out, HASHED)
        if node is not None:
            yield _rows([(*node, state.hexdigest())], HASHED)

    node = ["depth", "ha", "hb"]
    order = [*node, "conv_id"]
    CHUNKS, HASHED = "depth long, ha long, hb long, first long, ids string", "depth long, ha long, hb long, ends_sha256 string"
    texts = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, CHUNKS)
    return texts.repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(hashed, HASHED)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [(n, pa.string() if t == "string" else pa.int64()) for n, t in (f.split() for f in schema.split(", "))]
    columns = list(zip(*rows)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], [n for n, _ in kinds])


class Queue:
    """A priority queue of (key, values) that keeps ``limit`` entries in memory and spills the rest as sorted runs.

    Runs are unnamed files that end with their task; no other task sees them.
    """

    def __init__(self, limit: int):
        self.limit, self.heap, self.heads = limit, [], []
        self.pushed = 0

    def push(self, key: tuple, values: tuple) -> None:
        if len(self.heap) >= self.limit:
            self._spill()
        self.pushed += 1
        heapq.heappush(self.heap, (key, self.pushed, values))

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        for entry in sorted(self.heap):
            pickle.dump(entry, file)
        file.seek(0)
        self.heap = []
        self._advance(file)

    def _advance(self, file) -> None:
        try:
            heapq.heappush(self.heads, (*pickle.load(file), file))
        except EOFError:
            file.close()

    def take(self, key: tuple) -> list[tuple]:
        """Remove the values of all entries of ``key``, which must not lie behind any other."""
        found = []
        while self.heap and self.heap[0][0] == key:
            found.append(heapq.heappop(self.heap)[2])
        while self.heads and self.heads[0][0] == key:
            *_, values, file = heapq.heappop(self.heads)
            found.append(values)
            self._advance(file)
        return found


# A node's key, its parent's key, whether the parent lies in the same shard; what it brings along and, of notes, what came from outside.
STREAM = ["shard", "depth", "conv_id", "is_node", "up_depth", "up_conv", "inside", "leaves", "saved", "children"]
SENT = "is_root long, depth long, conv_id long, up_depth long, up_conv long, leaves long, saved long"


def _forward(batch: pa.RecordBatch, state: dict, limit: int, sent: list | None, done: list | None) -> None:
    """Take the rows of one batch, which are in reverse level order shard by shard, and pass totals to parents.

    ``sent`` gets what shard roots send and, for each noted node, the node above its shard root; ``done`` gets each node's totals.
    """
    for shard, depth, conv, is_node, up_depth, up_conv, inside, leaves, saved, children in zip(*(batch.column(c).to_pylist() for c in STREAM)):
        if state.get("shard") != shard:
            state.update(shard=shard, queue=Queue(limit), noted={})
        queue, noted, key = state["queue"], state["noted"], (-depth, conv)
        if not is_node:
            queue.push(key, (leaves, saved, children, key if sent is not None else None))
            if sent is not None:
                noted[key] = [key]
            continue
        group = None
        for more_leaves, more_saved, more_children, more in queue.take(key):
            leaves, saved, children = leaves + more_leaves, saved + more_saved, children + more_children
            if more is not None:
                if group is None:
                    group = more
                else:  # the smaller list of noted nodes goes into the larger
                    small, group = sorted((group, more), key=lambda g: len(noted[g]))
                    noted[group] += noted.pop(small)
        if done is not None:
            done.append((children, leaves, saved))
        if inside:
            queue.push((-up_depth, up_conv), (leaves, saved, 1, group))
        elif sent is not None:
            if up_depth is not None:
                sent.append((1, depth, conv, up_depth, up_conv, leaves, saved))
            sent += [(0, -d, c, up_depth, up_conv, 0, 0) for d, c in (noted.pop(group) if group is not None else ())]


def _stream(nodes: DataFrame, notes: DataFrame | None, *more: str) -> DataFrame:
    """Nodes and notes, each shard in reverse level order, a node's notes before it."""
    rows = nodes.select(*[c for c in STREAM if c not in ("is_node", "children")], F.lit(True).alias("is_node"), F.lit(0).cast("long").alias("children"), *more)
    if notes is not None:
        rows = rows.unionByName(notes.withColumn("is_node", F.lit(False)), allowMissingColumns=True)
    rows = rows.select(*STREAM, *more)
    return rows.repartition("shard").sortWithinPartitions("shard", F.col("depth").desc(), "conv_id", "is_node")


def totals(nodes: DataFrame, *more: str, shard_rows: int = SHARD, queued: int = QUEUED) -> DataFrame:
    """``nodes`` (conv_id, depth, up_conv, up_depth, leaves, saved and the columns ``more``) with ``children`` and the sums over subtrees.

    A node is named by conv_id and depth; its parent (null for a root) is another row of less depth.
    """
    numbered = dense_ids(nodes, "_n", ["conv_id", "depth"])
    sharded = cut(numbered.withColumn("shard", F.floor((F.col("_n") - 1) / shard_rows)).drop("_n"))
    above = sharded.select(F.col("conv_id").alias("up_conv"), F.col("depth").alias("up_depth"), F.col("shard").alias("up_shard"))
    placed = sharded.join(above, ["up_conv", "up_depth"], "left")
    placed = cut(placed.withColumn("inside", F.coalesce(F.col("shard") == F.col("up_shard"), F.lit(False))))
    away = placed.filter("up_shard <> shard")
    targets = cut(away.groupBy(F.col("up_shard").alias("shard"), F.col("up_depth").alias("depth"), F.col("up_conv").alias("conv_id")).agg(F.count("*").alias("children")))
    notes = None
    if not targets.isEmpty():
        zero = F.lit(0).cast("long")
        marks = targets.select("shard", "depth", "conv_id", zero.alias("leaves"), zero.alias("saved"), zero.alias("children"))

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state: dict = {}
            for batch in batches:
                sent: list[tuple] = []
                _forward(batch, state, queued, sent, None)
                yield _rows(sent, SENT)

        sent = cut(_stream(placed, marks).mapInArrow(first, SENT))
        arrived = sent.filter("is_root = 1").groupBy(F.col("up_depth").alias("depth"), F.col("up_conv").alias("conv_id")).agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
        )
        links = sent.filter("is_root = 0").select("conv_id", "depth", "up_conv", "up_depth")
        across = totals(links.join(arrived, ["conv_id", "depth"]), shard_rows=shard_rows * GROWTH, queued=queued)
        notes = cut(targets.join(across.select("conv_id", "depth", "leaves", "saved"), ["conv_id", "depth"]))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            done: list[tuple] = []
            _forward(batch, state, queued, None, done)
            kept = batch.filter(batch.column("is_node"))
            children, leaves, saved = [pa.array(c, pa.int64()) for c in (list(zip(*done)) or ([], [], []))]
            yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in KEPT], children, leaves, saved], [*KEPT, "children", "leaves", "saved"])

    KEPT = ["conv_id", "depth", "up_conv", "up_depth", *more]
    kinds = [f"{c} {nodes.schema[c].dataType.simpleString()}" for c in KEPT]
    return _stream(placed, notes, *more).mapInArrow(second, ", ".join([*kinds, "children long", "leaves long", "saved long"]))


def trie(members: DataFrame, conversations: DataFrame, shard_rows: int = SHARD, queued: int = QUEUED) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row per node.

    ``members`` and ``conversations`` as from ``rebuilt``, tables at rest.
    """
    node = ["depth", "ha", "hb"]
    zero = F.lit(0).cast("long")
    inner = members.groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"), F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.first("words").alias("words"),
        F.count("*").alias("n_convs"), F.count_if("end").alias("n_ends"),
    )
    top = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("turns") == 0).alias("n_ends"))
    root = top.filter("n_convs > 0").select(*[zero.alias(c) for c in (*node, "pa", "pb", "words")], "conv_id", "n_convs", "n_ends")
    ended = members.filter("end").select(*node, "conv_id").unionByName(
        conversations.filter("turns = 0").select(*[zero.alias(c) for c in node], "conv_id")
    )
    named = cut(inner.unionByName(root).join(ends(ended), node, "left"))
    least = top.first()["conv_id"]
    above = named.filter("depth > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("ha").alias("pa"), F.col("hb").alias("pb"), F.col("conv_id").alias("up_conv")
    )
    # Every first turn is a child of the root, whose name needs no join.
    low = named.filter("depth < 2").withColumn("up_conv", F.when(F.col("depth") == 1, F.lit(least).cast("long")))
    linked = named.filter("depth > 1").join(above, ["depth", "pa", "pb"]).unionByName(low)
    nodes = linked.select(
        "conv_id", "depth", "up_conv", F.when(F.col("depth") > 0, F.col("depth") - 1).alias("up_depth"),
        (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        "n_convs", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
    return totals(nodes, "n_convs", "ends_sha256", shard_rows=shard_rows, queued=queued).select(
        "conv_id", "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256",
    )
