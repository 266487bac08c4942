"""Token ids of documents in ORC files.

Texts are dealt by ranges of ``doc_id`` and encoded in that order, so file order is document order. The id lists are integer
streams with run-length encoding; stripes are read side by side, row indexes and Bloom filters on ``doc_id`` let a lookup skip
stripes and row groups from the footers alone. Each row carries its place: the file's number in the high bits, its row
in the low 33.

White space always parts tokens in the word tokenizers this serves (``encode`` checks that white space itself gives no token), so the ids
of a text are those of its words in a row. Words are split and told apart by Arrow, batch by batch; each distinct word a worker does
not remember is encoded once, and the ids are put together by offsets. Where the tokenizer's pattern parts a word from the marks behind it
and its normaliser lowers case (``_Encoded.parted``), the word is remembered in lower case and the marks by themselves. The memory is
bounded by bytes, so a word of any length and a corpus of any vocabulary fit; texts of any length pass whole. The number of ranges grows with the input, files do not.

Null and empty texts hold only the end id. Null ids come first; repeated ids are ordered by a hash of their text. Other
columns are left out. An empty table gives files without rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from storelytics import session
from storelytics.llm.common import cut, memo

# What a worker's memory of words may hold, an estimate in bytes; how many words go to the tokenizer or are put together at once.
KEPT_BYTES = 64 << 20
ENTRY_BYTES = 150
AT_ONCE = 20_000
# The pattern after which a letter or digit and a following mark never share a token, what it is known to follow, and such marks.
APART = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMALISED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Letters that stay one letter in any normal form and case; others may end in a sign that joins the marks.
PLAIN_END = "[0-9A-Za-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{FF}]$"
# Bytes of input a range, and so a file, may hold before there are more ranges than the session has shuffle partitions.
RANGE_BYTES = 128 << 20


class _Encoded:
    """Words to their ids: a memory bounded by bytes in front of the tokenizer, which gets new words in long runs.

    A run is the words with a special token between them. Special tokens are cut out of a text before anything else is done with
    it, so each word is encoded as if it stood alone, at a fraction of the cost. Words that hold such a token go by themselves.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(file)
        if self._ids([" \t\n\v\f\r"])[0]:
            raise ValueError("white space gives tokens: this tokenizer cannot be run word by word")
        with open(file, encoding="utf-8") as declared:
            model = json.load(declared)
        added = model.get("added_tokens", [])
        split = ((model.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.parted = (
            (model.get("normalizer") or {}).get("normalizers") == NORMALISED
            and split == {"type": "Split", "pattern": {"Regex": APART}, "behavior": "Removed", "invert": True}
        )
        self.special = [t["content"] for t in added]
        plain = [t for t in added if t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])]
        self.between = (plain[0]["content"], plain[0]["id"]) if plain else None
        self.slots: dict[str, int] = {}
        self.held = 0
        self.sizes, self.seen, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<i4")

    def _forget(self) -> None:
        """Keep the words that came in most batches, up to half of what may be held."""
        common = np.argsort(-self.seen, kind="stable")
        bytes_of = np.fromiter(map(len, self.slots), np.int64, len(self.slots)) + 4 * self.sizes + ENTRY_BYTES
        kept = np.zeros(len(self.slots), bool)
        kept[common[np.cumsum(bytes_of[common]) <= KEPT_BYTES // 2]] = True
        self.ids = self.ids[np.repeat(kept, self.sizes)]
        self.sizes, self.seen = self.sizes[kept], self.seen[kept]
        self.slots = dict(zip(compress(self.slots, kept), range(len(self.sizes))))
        self.held = self._bytes(self.slots, len(self.ids))

    @staticmethod
    def _bytes(words, ids: int) -> int:
        return sum(map(len, words)) + 4 * ids + ENTRY_BYTES * len(words)

    def _ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _run(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all their ids in a row."""
        text, number = self.between or ("\n", None)
        run = text.join(words)
        if number is None or run.count(text) >= len(words) or any(s in run for s in self.special if s != text):
            lists = self._ids(words)
            return np.array([len(x) for x in lists], np.int64), np.array([i for x in lists for i in x], "<i4")
        ids = np.array(self._ids([run])[0], "<i4")
        ends = np.flatnonzero(ids == number)
        bounds = np.concatenate(([-1], ends, [len(ids)]))
        return np.diff(bounds) - 1, np.delete(ids, ends)

    def known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slot of each distinct word, sizes by slot, ids in the order of slots; words not known before are learned."""
        if self.held > KEPT_BYTES:
            self._forget()
        new = [w for w in words if w not in self.slots]
        all_sizes, all_ids = [self.sizes], [self.ids]
        for at in range(0, len(new), AT_ONCE):
            run = new[at : at + AT_ONCE]
            sizes, ids = self._run(run)
            self.slots.update(zip(run, range(len(self.slots), len(self.slots) + len(run))))
            all_sizes.append(sizes)
            all_ids.append(ids)
            self.held += self._bytes(run, len(ids))
        self.sizes, self.ids = np.concatenate(all_sizes), np.concatenate(all_ids)
        self.seen = np.append(self.seen, np.zeros(len(new), np.int64))
        slots = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        self.seen[slots] += 1
        return slots, self.sizes, self.ids


    def words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all their ids in a row."""
        if not self.parted:
            return joined(*self.known(words.to_pylist()))
        words = words.cast(pa.string())
        # A special token's spelling is left as it is, and what would become one in lower case too.
        low = pc.ascii_lower(words)
        core = pc.ascii_rtrim(low, MARKS)
        whole = pc.invert(pc.match_substring_regex(core, PLAIN_END))
        for token in self.special:
            whole = pc.or_(whole, pc.match_substring(low, token.lower()))
        low, core = pc.if_else(whole, words, low), pc.if_else(whole, words, core)
        # Word, marks, word, marks, as ranges of the same bytes.
        ends = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1]
        bounds = np.empty(2 * len(low) + 1, np.int32)
        bounds[::2] = ends
        bounds[1::2] = ends[:-1] + np.asarray(pc.binary_length(core))
        halves = pa.StringArray.from_buffers(2 * len(low), pa.py_buffer(bounds), low.buffers()[2]).dictionary_encode()
        slots, sizes, ids = self.known(halves.dictionary.to_pylist())
        order = slots[np.asarray(halves.indices)]
        sizes_of, flat = joined(order, sizes, ids)
        return sizes_of.reshape(-1, 2).sum(axis=1), flat


def joined(order: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of the slots in ``order`` and their ids in a row; ``ids`` holds those of all slots one after the other."""
    starts = np.concatenate(([0], np.cumsum(sizes)))
    total = np.concatenate(([0], np.cumsum(sizes[order])))
    out = np.empty(total[-1], "<i4")
    for a in range(0, len(order), 10 * AT_ONCE):
        some = order[a : a + 10 * AT_ONCE]
        first, last = total[a], total[min(a + 10 * AT_ONCE, len(order))]
        out[first:last] = ids[np.repeat(starts[some] - total[a : a + len(some)], sizes[some]) + np.arange(first, last)]
    return np.diff(total), out


def _texts(text: pa.Array, encoded: _Encoded, end_id: int) -> pa.ListArray:
    """The ids of each text and the end id."""
    # White space as the tokenizer's patterns have it, but for signs beyond ASCII, which it may see within a word.
    words = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    spelled = words.flatten().dictionary_encode()
    sizes, ids = encoded.words(spelled.dictionary)
    # The end id is one more word, and stands behind the last one of each text.
    at = np.asarray(words.offsets)[1:] - words.offsets[0].as_py()
    order = np.insert(np.asarray(spelled.indices), at, len(sizes))
    sizes, out = joined(order, np.append(sizes, 1), np.append(ids, np.array([end_id], "<i4")))
    total = np.concatenate(([0], np.cumsum(sizes)))
    offsets = np.concatenate(([0], total[at + np.arange(1, len(at) + 1)]))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))


def encode(docs: DataFrame, file: str, end_id: int) -> DataFrame:
    """(doc_id, ids): token ids of each text and the end id, rows in the order they come."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = memo("token_files")
        if file not in kept:
            kept[file] = _Encoded(file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _texts(batch.column("text"), kept[file], end_id)], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, ids array<int>")


def _size(docs: DataFrame) -> int:
    """Bytes of the table as the planner knows them from its files, or of its texts where it knows nothing."""
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def write(docs: DataFrame, path: str, file: str, end_id: int, stripe_mb: int = 64) -> None:
    """Encode ``docs`` and write ORC files of (doc_id, place, ids) in ascending doc_id order."""
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-_size(docs) // RANGE_BYTES))
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie")).repartitionByRange(ranges, "doc_id", "_tie")
    placed = encode(ranged.sortWithinPartitions("doc_id", "_tie"), file, end_id).select(
        "doc_id", F.monotonically_increasing_id().alias("place"), "ids"
    )
    placed.write.options(**{
        "compression": "zstd", "orc.stripe.size": str(stripe_mb << 20), "orc.row.index.stride": "10000",
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
    }).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id bigint, place bigint, ids array<int>").orc(path)


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Rows of the given documents; the filter reaches the ORC footers, indexes and Bloom filters."""
    return read(spark, path).filter(F.col("doc_id").isin(ids))


def index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: where each document begins in the row of all ids.

    Running sums go file by file; the ids before a file are a sum over one row per file.
    """

    def scan(batches):
        for batch in batches:
            lists = batch.column("ids")
            raw, at = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B"), lists.offsets.to_pylist()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:])]
            size = np.diff(np.array(at, np.int64))
            columns = [batch.column("doc_id"), batch.column("place"), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "n_tokens", "ids_crc32"])

    rows = cut(
        read(spark, path).mapInArrow(scan, "doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint")
        .withColumn("_file", F.expr("shiftright(place, 33)"))
    )
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_file").agg(F.sum("n_tokens").alias("_n"))
    files = sums.select("_file", F.coalesce(F.sum("_n").over(before.orderBy("_file")), F.lit(0)).alias("_first"))
    within = F.coalesce(F.sum("n_tokens").over(before.partitionBy("_file").orderBy("place")), F.lit(0))
    return rows.withColumn("_in", within).join(files, "_file").select(
        "doc_id", (F.col("_first") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32"
    )


def written_index(docs: DataFrame, file: str, end_id: int = 2) -> DataFrame:
    """Write the files to the shared folder and give their index."""
    path = session.scratch_path(docs.sparkSession, "tokens")
    write(docs, path, file, end_id)
    return index(docs.sparkSession, path)
