"""Registered queries of the tokenizing operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelytics.llm import pieces, token_files
from storelytics.llm.common import table


def op3_sentencepiece_encoding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), checked=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "n_bytes", "round_trip", "ids")


def op9_token_id_output(spark: SparkSession, folder: str) -> DataFrame:
    file = public_tokenizers.path("word_bpe_49k.json")
    return token_files.written_index(table(spark, folder, "documents"), file, end_id=2)


QUERIES = {"op3_sentencepiece_encoding": op3_sentencepiece_encoding, "op9_token_id_output": op9_token_id_output}

ORACLE: dict[str, str] = {}
