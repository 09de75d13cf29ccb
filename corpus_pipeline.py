"""A corpus from raw documents to token ids: toxic documents go, boilerplate lines go, one of near copies stays, sources
are mixed to their target weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the docs of the
next. All but the last return the columns of documents. Labels come from the table labels in sf_dir.

Nulls: null texts count as empty, except that lines are not taken from them. Documents without an id are told apart by
their text. Repeated rows are copies of each other; different texts under one id are different documents, and all stay
unless they are near copies. Of near copies that tie, the smallest id stays. Texts are whole at any length. Extra columns go through all stages but
the last, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.llm import line_dedup, mixing, sentencepiece_codec, similar, toxicity
from litmill.llm._base import shared_folder, table


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = line_dedup.strip(docs, copies_once=True)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digest(docs, sentencepiece_codec.default_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_documents),
    ("line dedup", boilerplate_lines),
    ("SimHash near-dedup", near_copies),
    ("mixing sources", mixed_sources),
    ("SentencePiece", token_ids),
]

#: SQL can't express the learnt toxicity scores nor the encoding; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
