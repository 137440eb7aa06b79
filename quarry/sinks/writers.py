"""Sinks (K1-K6). All writes are DataFrame writes: partitioned folders,
no per-record files from the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sections(sections: DataFrame, out_dir: str, mode: str = "overwrite") -> None:
    """K1: section texts, one folder per chapter (``chapter=chNN``), keeping
    ``text_location`` (``chNN/secNN.txt``) as a column."""
    sections.select("chapter", "section", "text_location", "text").write.mode(mode) \
        .partitionBy("chapter").parquet(out_dir)


def write_description(toc: DataFrame, out_path: str, mode: str = "overwrite") -> None:
    """K2: nested description: one record per chapter with its sections in
    order (a chapter is a bounded menu entry)."""
    sec = F.struct(F.col("section_no"), F.lit("section").alias("type"), F.col("section_name").alias("name"),
                   "url", "text_location")
    nested = toc.groupBy("page_id", "chapter_no", "chapter_name").agg(
        F.sort_array(F.collect_list(sec)).alias("_s"))
    out = nested.select("page_id", "chapter_no", F.lit("chapter").alias("type"), F.col("chapter_name").alias("name"),
                        F.transform("_s", lambda s: s.dropFields("section_no")).alias("sections"))
    out.write.mode(mode).json(out_path)


def write_dataset(datasets: DataFrame, out_path: str, mode: str = "overwrite") -> None:
    """K2: one JSON object a page, ``{"dataset": [chapter, ...]}`` with the
    chapters of :func:`..operators.extract.toc_dataset` and their sections."""
    datasets.select("dataset").write.mode(mode).json(out_path)


def write_generation_outputs(parsed: DataFrame, out_dir: str, mode: str = "overwrite") -> None:
    """K3: the raw completion is kept for every input; parsed dialogs only
    where parsing succeeded. One table, two filtered writes."""
    parsed.select("source_path", "content").write.mode(mode).parquet(f"{out_dir}/model_output")
    parsed.where(F.col("parsed").isNotNull()).select("source_path", "parsed").write.mode(mode).json(
        f"{out_dir}/qa_pairs")


def write_splits(splits: DataFrame, out_dir: str, mode: str = "overwrite") -> None:
    """K4: train/test JSON lines per agent (``agent=/split=`` folders)."""
    splits.select("agent", "split", "input_text", "target_text").write.mode(mode) \
        .partitionBy("agent", "split").json(out_dir)


def append_results(results: DataFrame, out_dir: str) -> None:
    """K5/K6: append-only result records; run totals belong in a separate
    table, so a ``Total Time`` text line never lands among the records."""
    results.write.mode("append").json(out_dir)


def answer_record(model: str | F.Column, response: str = "response", time_col: str = "inference_time") -> F.Column:
    """K6 record text: ``Model Name: m`` / ``Response: r`` /
    ``Inference Time: t.tt seconds`` followed by a blank line."""
    m = F.lit(model) if isinstance(model, str) else model
    return F.concat(F.lit("Model Name: "), m, F.lit("\nResponse: "), F.col(response),
                    F.lit("\nInference Time: "), F.format_string("%.2f", F.col(time_col)), F.lit(" seconds\n"))


def append_answer_text(answers: DataFrame, out_dir: str, model: str | F.Column) -> None:
    """K6: append free-text answer records (one text row per record)."""
    answers.select(answer_record(model).alias("value")).write.mode("append").text(out_dir)
