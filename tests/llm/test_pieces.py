"""The piece transducer against the library, round trips, and a unigram model against brute force."""

import itertools
import math
import random

import public_tokenizers
import sentencepiece

from storelytics.llm import pieces, queries

FILE = public_tokenizers.path("piece_bpe_32k.model")


def test_the_sample_equals_the_library(spark):
    got = {r.doc_id: r for r in queries.queries()["op3_sentencepiece_encoding"](spark, "/root/testdata/sf0.01").collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=FILE)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].ids == lib.encode(r.text) and got[r.doc_id].round_trip and got[r.doc_id].n_tokens == len(got[r.doc_id].ids)


def test_odd_texts_equal_the_library():
    rng, lib, mine = random.Random(1), sentencepiece.SentencePieceProcessor(model_file=FILE), pieces.Transducer(FILE)
    parts = ["a", "b", "e", "t", "h", "▁", " ", "  ", "\n", "é", "ü", "日", "😀", "\t", "\x00", "ing", "tion", "aa", "__", "==", "####", "http://", "\r\n", "1", "́"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids = memoryview(mine.encode(text)).cast("i").tolist()
        assert ids == lib.encode(text), text
        assert mine.decode(ids) == text.replace("▁", " ")


def test_rows(docs):
    rows = [(1, None), (2, ""), (3, " a  b\n"), (3, " a  b\n"), (None, "x"), (5, "�\u0000"), (6, "word " * 60_000), (7, "é" * 20_000)]
    found = pieces.encode(docs(*rows), FILE, checked=True)
    assert all(r.round_trip for r in found.collect()) and {r.doc_id for r in found.collect() if r.ids == []} == {1, 2}
    back = pieces.decode(found, FILE).select("doc_id", "text")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert pieces.encode(docs((1, "a")).limit(0), FILE).count() == 0
    assert pieces.decode(found.selectExpr("doc_id", "cast(NULL AS array<int>) AS ids"), FILE).first().text is None


def wire(number, value):
    if isinstance(value, int):
        return bytes([number << 3, value])
    return bytes([number << 3 | 2, len(value)]) + value


def test_a_unigram_model_takes_the_lightest_path(tmp_path):
    import struct

    scores = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -3.2, "bab": -7.0, "aba": -5.5}
    body = wire(1, wire(1, b"<unk>") + wire(3, 2))
    for p, s in scores.items():
        body += wire(1, wire(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s))
    body += wire(2, wire(3, 1)) + wire(3, wire(1, b"identity") + wire(4, 0))
    file = tmp_path / "unigram.model"
    file.write_bytes(body)
    model = pieces.Transducer(str(file))
    names = ["<unk>", *scores]
    for n in range(1, 7):
        for text in map("".join, itertools.product("ab", repeat=n)):
            full = "▁" + text
            best = math.inf
            for cuts in itertools.product([0, 1], repeat=len(full) - 1):
                at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(full)]
                best = min(best, -sum(scores.get(full[a:b], -math.inf) for a, b in zip(at, at[1:])))
            ids = memoryview(model.encode(text)).cast("i").tolist()
            assert math.isclose(-sum(scores[names[i]] for i in ids), best) and model.decode(ids) == text


def test_batches_equal_the_library():
    import pyarrow as pa

    rng, lib, mine = random.Random(3), sentencepiece.SentencePieceProcessor(model_file=FILE), pieces.Transducer(FILE)
    parts = ["a", "th", "▁", " ", "  ", "\n", "é", "日", "😀", "\x00", "ing", "__", "####", "\r\n", "1", ".", ",", "'s", "».", "…", "$$", '"', "-", "don't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(2000)] + [None, "", " ", "▁ "]
    for some in (pa.array(texts), pa.array(texts, pa.large_string()).slice(5, 900), pa.array([], pa.string())):
        at, ids = mine.encode_all(some)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [lib.encode(t or "") for t in some.to_pylist()]
        assert all(mine.gives_back(some, at, ids))
    at, ids = mine.encode_all(pa.array(["one two", "three", None]))
    assert mine.gives_back(pa.array(["one two", "thread", None]), at, ids) == [True, False, True]


def test_a_word_is_composed_once_whatever_mark_is_behind_it(monkeypatch):
    import pyarrow as pa

    mine, composed = pieces.Transducer(FILE), []
    monkeypatch.setattr(mine, "_path", lambda text, path=mine._path: composed.append(text) or path(text))
    mine.encode_all(pa.array(["a stone stone. stone, stone###", "stone!? stone"]))
    assert composed.count("▁stone") == 1 and not [c for c in composed if "stone" in c and c != "▁stone" and c[0] == "▁"]
