"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir), where ``docs`` is a table at rest with the columns of ``documents``, and returns the documents
it keeps; ``run`` writes every stage's result and reads it again for the next. The last stage adds the ids and, from
decoding them again, whether they give the text back. Null, empty and
very long texts, repeated rows and empty tables pass through as the operators' modules say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelytics.llm import decontaminate, line_dedup, pieces, rule_ensemble, simhash
from storelytics.llm.common import cut, table, tune

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of ``docs``, gives at least 0.3."""
    return rule_ensemble.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs that an earlier one has, of three lines or of 35 words; ``n_chars`` follows the text."""
    tune(spark)
    return line_dedup.dedup(docs, run=3, long_words=35).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    tune(spark)
    return simhash.keep_one(docs, words=5, similarity=0.8).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of a benchmark item."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"), n=10).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their text, how many stand for single bytes, and whether decoding gives the text back."""
    tune(spark)
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), checked=True)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs


# A fitted classifier and fingerprints of sketches are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None
