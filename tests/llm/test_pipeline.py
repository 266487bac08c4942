"""Every stage of the pipeline against brute force on its own input, and the whole on odd rows."""

import itertools

import pytest
import public_tokenizers
import sentencepiece
from test_decontaminate import brute as brute_hits
from test_line_dedup import brute as brute_lines

import corpus_pipeline as cp
from storelytics.llm import rule_ensemble
from storelytics.llm.common import cut, table

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """The rows after each stage, the input first."""
    docs = table(spark, FOLDER, "documents")
    out = [docs.collect()]
    for _, stage in cp.STAGES:
        docs = cut(stage(spark, docs, FOLDER))
        out.append(docs.collect())
    return out


def texts(rows):
    return [(r.doc_id, r.text) for r in rows]


def test_quality_takes_what_the_score_says(spark, steps):
    scores = rule_ensemble.scored(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"))
    want = {r.doc_id for r in scores.collect() if r.predicted}
    got = {r.doc_id for r in steps[1]}
    assert got == want and 800 < len(got) < 1000


def test_lines(steps):
    want = {i: (t, len(t)) for i, _, _, t in brute_lines(texts(steps[1]), 3, 35)}
    assert {r.doc_id: (r.text, r.n_chars) for r in steps[2]} == want


def test_near_copies(steps):
    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {r.doc_id: shingles(r.text) for r in steps[2]}
    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = {p for ids in holders.values() for p in itertools.combinations(sorted(ids), 2)}
    alike = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in pairs}
    kept = {r.doc_id for r in steps[3]}
    near = [p for p, j in alike.items() if j >= 0.9]
    assert near and not [p for p in near if p[0] in kept and p[1] in kept]
    # What went has something alike that is smaller in number; a chain may lead further.
    gone = set(sets) - kept
    assert all(any(j >= 0.65 for p, j in alike.items() if i in p) for i in gone)


def test_benchmark(spark, steps):
    items = [tuple(r) for r in table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    clean = {i for i, *_, bad in brute_hits(texts(steps[3]), items) if not bad}
    assert {r.doc_id for r in steps[4]} == clean and len(clean) < len(steps[3])


def test_tokens(steps):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert len(steps[5]) == len(steps[4]) and all(r.ids == lib.encode(r.text) for r in steps[5])


def test_tokens_are_decoded(steps):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert steps[5] and all(r.round_trip == (lib.decode(r.ids) == r.text.replace("\u2581", " ")) for r in steps[5])


def test_run_is_the_stages_in_a_row(spark, steps):
    got = cp.run(spark, FOLDER).select("doc_id", "ids").collect()
    assert abs(len(got) - len(steps[5])) <= 3


def test_odd_rows(spark, docs, tmp_path):
    rows = [(1, None), (2, ""), (None, "a b c"), (4, "x " * 50_000), (5, "same text here\n" * 4), (5, "same text here\n" * 4), (6, "unlike the others")]
    folder = str(tmp_path)
    docs(*rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "unlike the others")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r.doc_id for r in cp.run(spark, folder).collect()}
    assert got == {1, None, 4, 5}
    empty = str(tmp_path / "none")
    docs(*rows).limit(0).write.parquet(f"{empty}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert cp.run(spark, empty).count() == 0
