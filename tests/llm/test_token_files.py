"""Token files against the tokenizer run over whole texts."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from storelytics import session
from storelytics.llm import queries, token_files

FILE = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    """Sorted (doc_id, start, n_tokens, crc) for rows in order."""
    tok, start, out = Tokenizer.from_file(FILE), 0, []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_the_sample(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = queries.queries()["op9_token_id_output"](spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, got.collect())) == brute(map(tuple, rows))


def test_edge_texts_and_lookup(spark, docs):
    texts = [None, "", "  \t", "Hello, WORLD's!", "ΣΑΣ ὈΔΥΣΣΕΎΣ Σ", "é ́e", "<|endoftext|> x<|startoftext|>y", "a b\x1cc", "日本 😀", "x" * 100_000]
    rows = list(enumerate(texts)) + [(40, "w " * 150_000)]
    path = session.scratch_path(spark, "tokens")
    token_files.write(docs(*reversed(rows)), path, FILE, 2)
    assert sorted(map(tuple, token_files.index(spark, path).collect())) == brute(rows)
    found = token_files.lookup(spark, path, [3, 40, 99])
    assert sorted(r.doc_id for r in found.collect()) == [3, 40]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()


def test_repeated_null_and_no_rows(spark, docs):
    got = token_files.written_index(docs((3, "a"), (3, "a"), (None, "b c"), (1, None)), FILE).collect()
    assert sorted((str(r.doc_id), r.start, r.n_tokens) for r in got) == [("1", 3, 1), ("3", 4, 2), ("3", 6, 2), ("None", 0, 3)]
    assert token_files.written_index(docs((1, "a")).limit(0), FILE).count() == 0


def test_words_in_runs_equal_the_tokenizer(monkeypatch):
    import random

    import pyarrow as pa

    monkeypatch.setattr(token_files, "AT_ONCE", 7)
    rng, tok, mine = random.Random(2), Tokenizer.from_file(FILE), token_files._Encoded(FILE)
    assert mine.between is not None
    parts = ["a", "The", "ing", "1", "22", ",", ".", "!", "#", "'s", "'", "<", "|", "<|endoftext|>", "é", "É", "ß", "—", "\x1c", "\x7f", "~", "Z", "don't", "_", " ", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(600)] + [None, ""]
    for at in range(0, len(texts), 50):
        some = texts[at : at + 50]
        got = token_files._texts(pa.array(some, pa.string()), mine, 2).to_pylist()
        assert got == [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in some]


def test_a_sliced_batch():
    import pyarrow as pa

    mine = token_files._Encoded(FILE)
    whole = pa.array(["one two", "three", None, "four five six"])
    assert token_files._texts(whole.slice(1, 3), mine, 2).to_pylist() == token_files._texts(whole, mine, 2).to_pylist()[1:]


def test_memory_is_bounded_by_bytes(monkeypatch):
    """Words of 100 kB and a vocabulary without end leave no more behind than allowed."""
    import pyarrow as pa

    monkeypatch.setattr(token_files, "KEPT_BYTES", 1 << 20)
    mine = token_files._Encoded(FILE)
    for i in range(30):
        token_files._texts(pa.array([f"{i}" * 100_000, " ".join(f"w{i}x{j}" for j in range(2_000))]), mine, 2)
        assert mine.held <= 2 << 20
        assert sum(map(len, mine.slots)) + 4 * len(mine.ids) <= mine.held and len(mine.slots) == len(mine.sizes) == len(mine.seen)


def test_words_are_remembered_without_case_and_closing_marks():
    import pyarrow as pa

    tok, mine = Tokenizer.from_file(FILE), token_files._Encoded(FILE)
    texts = ["Stone stone. STONE, stone### stone!?", "x<|ENDOFTEXT|> <|EndOfText|>. y<|endoftext|>.", "e\u0301. \u0130. a\u2026. 1.5. it's. it'S, don't\"", ". ## \u00df. \u00c9. \u03a3.", None, ""]
    assert token_files._texts(pa.array(texts), mine, 2).to_pylist() == [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert sum("stone" in w.lower() for w in mine.slots) == 1
    assert token_files._texts(pa.array([None, ""], pa.string()), token_files._Encoded(FILE), 2).to_pylist() == [[2], [2]]
    assert token_files._texts(pa.array(texts, pa.large_string()), mine, 2).to_pylist() == token_files._texts(pa.array(texts), mine, 2).to_pylist()
