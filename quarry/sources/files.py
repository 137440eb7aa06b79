"""File sources: dialog files, JSONL (strict / tolerant), text folders, logs.

All readers return DataFrames with the file path kept as a column, so
ordering by path is an explicit key and never relies on partition order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import rank_within
from .dialog_files import scan_dialogs

QA_SCHEMA = "input_text string, target_text string"


def read_dialog_files(spark: SparkSession, directory: str, chapters: list[str] | None = None,
                      pattern: str = "*.json", on_error: str = "raise") -> DataFrame:
    """Every ``**/*.json`` under ``directory`` (each a list of
    dialogs), optionally only files whose path contains one of ``chapters``.
    Returns one row per message with the order key
    ``(path, dialog_idx, turn)``.

    A large file is read by several tasks, see :mod:`.dialog_files`. With
    ``on_error="raise"`` a malformed file fails the job and is named in the
    error; ``"drop"`` leaves it out, :func:`.dialog_files.scan_dialogs` gives
    the rejected files as a table."""
    if on_error not in ("raise", "drop"):
        raise ValueError("on_error is 'raise' or 'drop'")
    messages, rejects = scan_dialogs(spark, directory, chapters, pattern)
    if on_error == "drop":
        return messages
    # the first bad file is one aggregated row: no filter moves below it, and no column pruning removes it
    first = rejects.agg(F.min(F.struct("path", "reason")).alias("w"))
    error = F.raise_error(F.concat(F.lit("malformed dialog file "), "w.path", F.lit(": "), "w.reason")).cast("boolean")
    failing = first.where(F.when(F.col("w").isNotNull(), error).otherwise(F.lit(False)))
    return messages.unionByName(failing.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in messages.schema.fields]))


def read_jsonl_strict(spark: SparkSession, path: str, schema: str = QA_SCHEMA) -> DataFrame:
    """JSON lines; a malformed line fails the job (blank lines are
    skipped)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str = QA_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejected lines as two lazy DataFrames. Each line is
    checked with ``try_parse_json`` (null only for malformed JSON, so a valid
    record with null fields stays good); good lines are parsed with the
    schema. Blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    ok = F.expr("try_parse_json(value)").isNotNull()
    good = lines.where(ok).select(F.from_json("value", schema).alias("_r")).select("_r.*")
    bad = lines.where(~ok).select(F.col("value").alias("_corrupt_record"))
    return good, bad


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with file name and 1-based line number per file.

    Line numbers come from the two-level rank over ``(file, position)``;
    the position inside a file is its byte offset order as read."""
    df = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("_blk"), "value")
    df = df.withColumn("_seq", F.monotonically_increasing_id())
    ranked = rank_within(df, order=["_blk", "_seq"], group=["file_path"], rank_col="line_no")
    return ranked.drop("_blk", "_seq")


def read_result_lines(spark: SparkSession, path: str):
    """Result file lines; lines not starting with ``{`` are skipped, bad
    JSON is reported with its line number."""
    from ..operators.evalrun import parse_result_lines
    return parse_result_lines(read_lines(spark, path))


def read_sections(spark: SparkSession, directory: str, pattern: str = "*.txt") -> DataFrame:
    """Whole ``.txt`` files with their folder and file name."""
    df = (spark.read.option("wholetext", True).option("recursiveFileLookup", True)
          .option("pathGlobFilter", pattern).text(directory))
    path = F.col("_metadata.file_path")
    return df.select(path.alias("path"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder"),
                     F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def first_sections(df: DataFrame, max_entries: int | None, folder: str = "folder", name: str = "name") -> DataFrame:
    """Sort by ``(folder, name)``, ties by the remaining sortable
    columns, and keep the first ``max_entries`` (``0``/``None`` = all). The
    limit is the operator's feature; the result is sorted for any limit, and
    Spark chooses between per-partition top-n and a global sort."""
    rest = [c for c, t in df.dtypes if c not in (folder, name) and not t.startswith(("map", "variant"))]
    ordered = df.orderBy(folder, name, *rest)
    return ordered.limit(max_entries) if max_entries else ordered


def concat_offsets(df: DataFrame, folder: str, order: Sequence[str], text: str,
                   sep: str = "\n") -> DataFrame:
    """The concatenation of a folder's texts (``sep`` after each) as an
    ordered table: each piece keeps ``start_offset`` (characters before it in
    the folder's string) and ``piece_len``. The folder's string is never
    built in one task; any slice of it can be read back by offset."""
    d = df.withColumn("piece_len", F.char_length(text) + len(sep))
    r = rank_within(d, order=list(order), group=[folder], weight="piece_len", rank_col="piece_no",
                    prefix_col="start_offset")
    return r
