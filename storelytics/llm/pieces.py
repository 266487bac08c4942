"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into one transducer: the normaliser maps a space to the piece mark and puts one in front, each piece is a path of
its characters with its id as output, and a character that is a piece of no kind goes over arcs that put out its bytes. Composed with
an input it is a lattice of segmentations; the encoding is the path of least weight in the tropical semiring.

Unigram models weigh an arc by the piece's negative score. Merge models have no such weights: their segmentation is the one the
merges leave standing. That is a condition on neighbours, since a sequence of pieces is what the merges leave of a text if and only if
each two neighbours are what the merges leave of these two. So each pair of arcs weighs nothing if it is stable and
infinitely much if not, which is found out once per pair and remembered; every prefix then has one path of
finite weight. The ids equal the library's own.

Where no piece holds the mark or a line break after another character, paths part there, and pieces of text are composed
one by one; so they are before a punctuation mark that no piece holds after a letter. A bounded memory per worker keeps common
parts. Of a batch of texts, Arrow tells the stretches from one run of spaces to the next apart; each distinct one is composed once, and the ids are put
together by offsets. Otherwise a text is composed whole.

Decoding puts the pieces' bytes in a row, batch by batch; texts whose bytes are not those they came from are decoded one by one.

Null and empty texts have no ids. ``decode`` turns ids back: marks to spaces, byte runs to characters (U+FFFD for what is no
UTF-8), without the mark put in front; null ids give a null text. Models with a character map or with user-defined or unused pieces are refused.
Repeated rows are encoded alike; all columns are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from storelytics.llm.common import memo
from storelytics.llm.token_files import joined

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
LETTERS, MARKS = "A-Za-zÀ-ÖØ-ɏ", '!"#$%&\'()*+,-./:;<=>?@[\\]^_`{|}~'
WORDS_KEPT = 250_000
PAIRS_KEPT = 400_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message in wire format; values are integers or bytes."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, raw[at : at + size]
        at += size


class Transducer:
    """The compiled model. ``encode`` gives ids, ``decode`` text."""

    def __init__(self, file: str):
        with open(file, "rb") as source:
            message = list(_fields(source.read()))
        pieces = []
        for raw in (v for n, v in message if n == 1):
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(raw))
            pieces.append((piece[1].decode(), float(np.frombuffer(piece[2], "<f4")[0]), piece[3]))
        trainer = dict(_fields(next((v for n, v in message if n == 2), b"")))
        normaliser = {3: 1, 4: 1, 5: 1} | dict(_fields(next((v for n, v in message if n == 3), b"")))
        if normaliser.get(2) or {k for *_, k in pieces} & {USER, UNUSED} or trainer.get(3, 1) not in (1, 2):
            raise ValueError("character maps, user-defined and unused pieces and word or character models are not supported")
        self.merges = trainer.get(3, 1) == 2
        self.prefix, self.squeeze, self.space = bool(normaliser[3]), bool(normaliser[4]), MARK if normaliser[5] else " "
        self.arcs = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.weight = {p: -s for p, s, k in pieces if k == NORMAL}
        self.unknown = next(i for i, (*_, k) in enumerate(pieces) if k == UNKNOWN)
        self.bytes = [i for i, (*_, k) in enumerate(pieces) if k == BYTE]
        self.longest = max(map(len, self.arcs))
        self.fallback = max(self.weight.values()) + 10
        self.coded = {p: np.array(i, "<i4").tobytes() for p, i in self.arcs.items()}
        self.begun = {p[:n]: p[:n] in self.arcs for p in self.arcs for n in range(2, len(p) + 1)}  # what pieces begin with
        self.output = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, _, k in pieces
        ]
        breaks = self.space + ("" if any("\n" in p for p in self.arcs) else "\n")
        inside = any(c in p.lstrip(c) for p in self.arcs for c in self.space)
        # Marks that no piece holds behind a letter; parts end there as well.
        behind = {b for p in self.arcs for a, b in zip(p, p[1:]) if re.match(f"[{LETTERS}]", a)}
        marks = "".join(f"\\{c}" for c in MARKS if c not in behind)
        more = f"[^{breaks}](?:[^{marks}{breaks}]+|(?<![{LETTERS}])[{marks}])*" if marks else f"[^{breaks}]+"
        self.parts = None if inside else re.compile(f"{self.space}*{more}|{self.space}+|\n")
        self.stable: dict[str, dict[str, bool]] = {}  # by the arc before and the arc behind it
        self.pairs = 0
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _left_standing(self, text: str) -> list[str]:
        """What the merges leave of a short text: the best-scored joint piece first, the leftmost of equals."""
        parts, weight = list(text), self.weight
        joint = [weight.get(a + b, math.inf) for a, b in zip(parts, parts[1:])]
        while joint and (least := min(joint)) < math.inf:
            i = joint.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joint[i]
            if i:
                joint[i - 1] = weight.get(parts[i - 1] + parts[i], math.inf)
            if i < len(joint):
                joint[i] = weight.get(parts[i] + parts[i + 1], math.inf)
        return parts

    def _follows(self, left: str, right: str) -> bool:
        """Whether the arc pair has finite weight in a merge model; ``left`` is empty at the start."""
        known = self.stable.get(left, {}).get(right)
        if known is None:
            if self.pairs >= PAIRS_KEPT:
                self.stable.clear()
                self.pairs = 0
            both = left + right  # two neighbours that are a piece together do not stay apart
            known = not (left and both in self.weight) and self._left_standing(both) == ([left, right] if left else [right])
            self.stable.setdefault(left, {})[right] = known
            self.pairs += 1
        return known

    def _path(self, text: str) -> list[str]:
        """The arcs of the shortest path through the lattice of ``text``."""
        return self._stable_path(text) if self.merges else self._lightest_path(text)

    def _lightest_path(self, text: str) -> list[str]:
        """Weights added along the path and the least kept at each place."""
        weight, best = self.weight, [(0.0, "")]
        for j in range(1, len(text) + 1):
            found = (math.inf, "")
            for i in range(max(0, j - self.longest), j):
                arc = text[i:j]
                w = weight.get(arc, self.fallback if i == j - 1 else math.inf)
                if best[i][0] + w < found[0]:
                    found = (best[i][0] + w, arc)
            best.append(found)
        out, j = [], len(text)
        while j:
            out.append(best[j][1])
            j -= len(out[-1])
        return out[::-1]

    def _stable_path(self, text: str) -> list[str]:
        """Weights are nothing or infinite, so the first path of finite weight is the shortest: longer arcs are tried
        first, and a place from which the end was not reached is not entered again after the same arc.
        """
        stable, follows, begun, end, none = self.stable, self._follows, self.begun, len(text), {}
        path, before, at, dead, left, new = [], "", 0, set(), [], True
        while at < end:
            if new:  # the arcs from here, the longest last; a character is one at any rate
                arcs, stop = [text[at]], at + 2
                while stop <= end and (whole := begun.get(arc := text[at:stop])) is not None:
                    if whole:
                        arcs.append(arc)
                    stop += 1
                left.append(arcs)
            after = stable.get(before, none)
            new = False
            while arcs:
                arc = arcs.pop()
                known = after.get(arc)
                if (follows(before, arc) if known is None else known) and not (dead and (at + len(arc), arc) in dead):
                    path.append(arc)
                    at += len(arc)
                    before = arc
                    new = True
                    break
            else:
                if not path:
                    raise ValueError(f"no path of finite weight through {text!r}")
                left.pop()
                arcs, arc = left[-1], path.pop()
                dead.add((at, arc))
                at -= len(arc)
                before = path[-1] if path else ""
        return path

    def _ids(self, text: str) -> bytes:
        coded = self.coded
        return b"".join([coded.get(arc) or self._spelled(arc) for arc in self._path(text)])

    def _spelled(self, arc: str) -> bytes:
        """The ids of a character that is no piece."""
        return np.array([self.bytes[b] for b in arc.encode()] if self.bytes else [self.unknown], "<i4").tobytes()

    def _part(self, text: str) -> bytes:
        ids = self.recent.get(text)
        if ids is None:
            ids = self.older.get(text) or self._ids(text)
            if len(self.recent) >= WORDS_KEPT:
                self.recent, self.older = {}, self.recent
            self.recent[text] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers."""
        text = text or ""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return b""
        text = (" " if self.prefix else "") + text
        text = text.replace(" ", self.space)
        return b"".join(map(self._part, self.parts.findall(text))) if self.parts else self._ids(text)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each text begin and end, and all ids in a row."""
        if not self.parts:
            rows = [self.encode(t) for t in texts.to_pylist()]
            return np.concatenate(([0], np.cumsum([len(r) // 4 for r in rows], dtype=np.int64))), np.frombuffer(b"".join(rows), "<i4")
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.squeeze:
            texts = pc.utf8_trim(pc.replace_substring_regex(texts, " +", " "), " ")
        empty = pc.equal(pc.binary_length(texts), 0)
        if self.space != " ":
            texts = pc.replace_substring(texts, self.space, " ")  # both are the same from here on
        if self.prefix:
            texts = pc.if_else(empty, texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        # Stretches begin with a text or a run of spaces, and are ranges of the same bytes.
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: at[-1]]
        begins = np.zeros(len(raw) + 1, bool)
        begins[1:-1] = (raw[1:] == 32) & (raw[:-1] != 32)
        begins[at] = True
        begins = np.flatnonzero(begins[at[0] :]) + at[0]
        spelled = pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), pa.py_buffer(raw)).dictionary_encode()
        found = [b"".join(map(self._part, self.parts.findall(x.replace(" ", self.space)))) for x in spelled.dictionary.to_pylist()]
        sizes, ids = joined(
            np.asarray(spelled.indices), np.array([len(x) // 4 for x in found], np.int64), np.frombuffer(b"".join(found), "<i4")
        )
        return np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(begins, at)], ids

    def gives_back(self, texts: pa.Array, at: np.ndarray, ids: np.ndarray) -> list[bool]:
        """Whether decoding the ids gives each text, but for marks, which come back as spaces."""
        whole = pa.array(self.output, pa.large_binary()).take(pa.array(ids))
        ends = np.frombuffer(whole.buffers()[1], np.int64)[at].tolist()
        raw = memoryview(whole.buffers()[2] or b"").cast("B")
        out = []
        for text, a, b, i, j in zip(texts.to_pylist(), ends, ends[1:], at.tolist(), at[1:].tolist()):
            text = (text or "").replace(MARK, " ")  # as the spaces it is encoded like
            first = a + (self.prefix and b > a and raw[a] == 32)
            out.append(raw[first:b] == text.encode() or self.decode(ids[i:j].tolist()) == text)
        return out

    def decode(self, ids) -> str:
        text = b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _transducer(file: str) -> Transducer:
    kept = memo("pieces")
    if file not in kept:
        kept[file] = Transducer(file)
    return kept[file]


def encode(docs: DataFrame, file: str, checked: bool = False) -> DataFrame:
    """``docs`` with ``ids``; if ``checked``, with ``n_bytes`` (ids that stand for single bytes) and ``round_trip``, whether decoding gives the text back."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _transducer(file)
        is_byte = np.zeros(len(model.output), bool)
        is_byte[model.bytes] = True
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            at, flat = model.encode_all(texts)
            added = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))]
            if checked:
                marks = np.concatenate(([0], np.cumsum(is_byte[flat])))
                added += [pa.array(marks[at[1:]] - marks[at[:-1]]), pa.array(model.gives_back(texts, at, flat), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

    names = ["ids", "n_bytes", "round_trip"][: 3 if checked else 1]
    kinds = [T.ArrayType(T.IntegerType()), T.LongType(), T.BooleanType()]
    docs = docs.drop(*names)
    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds)]]))


def decode(rows: DataFrame, file: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the text of their ids."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _transducer(file)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = pa.array([None if x is None else model.decode(x) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, text])

    rows = rows.drop(text)
    return rows.mapInArrow(scan, T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())]))
