"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import (codes, decontaminate, dual_tree, language, line_templates, mixing, paragraphs, quality, sharding, simhash,
               token_files, topk, warc)

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.taken(read_table(spark, sf, "documents"))


def op2_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs.repeated(read_table(spark, sf, "documents"))


def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_templates.dropped_lines(read_table(spark, sf, "documents"))


def op4_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.round_trip(read_table(spark, sf, "documents"))


def op5_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf, "embeddings"))


def op6_simhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf, "documents"))


def op7_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


def op8_shard(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf, "documents"))


def op9_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf, "pages"))


def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    model = quality.train(docs, labels.where(quality.fold("doc_id") != 1))
    held = F.coalesce(quality.fold("doc_id") == 1, F.lit(False)).alias("held_out")
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op11_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    model = language.train(docs.where(language.learned("doc_id")))
    found = language.identify(docs.select("doc_id", "text"), model, columns=["doc_id"])
    return found.select("doc_id", (~language.learned("doc_id")).alias("held_out"), "lang_pred", "score")


def op12_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return dual_tree.search(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return codes.compress(read_table(spark, sf, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_mix_sources, op2_substring_dedup, op3_line_dedup, op4_token_files, op5_exact_topk,
                            op6_simhash_dedup, op7_decontaminate, op8_shard, op9_warc, op10_quality,
                            op11_language, op12_ranked_search, op13_vector_codes)}

ORACLES: dict[str, str] = {
    "op1_mix_sources": mixing.TAKEN_SQL,
    "op3_line_dedup": line_templates.DROPPED_SQL,
    "op5_exact_topk": topk.TOP_K_SQL,
    "op9_warc": warc.ROUND_TRIP_SQL,
    "op11_language": language.IDENTIFIED_SQL,
    "op12_ranked_search": dual_tree.SEARCH_SQL,
    "op13_vector_codes": codes.COMPRESS_SQL,
}
