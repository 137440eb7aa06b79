"""Corpus pipeline: from raw documents to token records.

``STAGES`` are run in order; each stage's rows are written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of
``documents``, whatever other columns there are and however they are called.

Null texts count as empty ones. Rows without an id are kept by the near-dedup,
repeated rows of a kept document stay together until the mix counts them as one
document, texts of any length are used whole, and an empty table passes through
all stages as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, mixing, quality, simhash, token_files
from quarry.llm.common import free_name, staged
from quarry.session import ensure_checkpoint_dir, read_table, ship_package


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.5) go."""
    _ready(spark)
    labels = read_table(spark, sf_dir, "labels").where(quality.fold("doc_id") != 1)
    model = quality.train(docs, labels)
    name = free_name(docs, "score")
    return quality.score(docs, model, score_col=name, at_least=0.5).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays, that with the smallest id."""
    _ready(spark)
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    _ready(spark)
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    _ready(spark)
    return mixing.mixed_documents(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token record files, read back: doc_id, start, n_tokens, ids_crc32."""
    _ready(spark)
    return token_files.round_trip(docs)


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontaminate", decontamination),
    ("mix", source_mix),
    ("tokens", token_records),
]

#: Training, SimHash classes and tokenisation can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    _ready(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
