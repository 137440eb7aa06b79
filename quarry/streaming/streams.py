"""Structured Streaming versions of the three stream-like steps.

X1 running dialog history per conversation (keyed state),
X2 live per-arm summary of arriving result lines,
X3 training-log tail.

Files must land whole in the watched directory (file sources do not tail a
growing file). Checkpoints go under the session's checkpoint directory.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import py_strip
from ..operators import parse
from ..operators.evalrun import RESULT_SCHEMA

TURN_SCHEMA = "conv_id long, turn long, role string, text string"
HISTORY_SCHEMA = "conv_id long, turn long, n_history long, history_chars long, history array<struct<role:string,content:string>>"


def _ckpt(spark: SparkSession, name: str) -> str:
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    return os.path.join(base, "streams", f"{name}-{uuid.uuid4().hex[:8]}")


def dialog_history_stream(turns: DataFrame, keep_history: bool = True,
                          at_roles: tuple[str, ...] | None = ("user",)) -> DataFrame:
    """For each arriving message of ``at_roles``, the model input = the
    conversation's earlier messages + the current one. State per
    conversation holds the history (every role is appended); turns inside a
    micro-batch are applied in ``turn`` order. Output equals batch
    :func:`quarry.operators.dialogs.dialog_history`."""

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        roles, texts = (list(state.get[0]), list(state.get[1])) if state.exists else ([], [])
        out = []
        batch = pd.concat(list(pdfs)).sort_values("turn")
        for r in batch.itertuples(index=False):
            if keep_history:
                roles.append(r.role)
                texts.append(r.text)
                hist = [{"role": a, "content": b} for a, b in zip(roles, texts)]
            else:
                hist = [{"role": r.role, "content": r.text}]
            if not at_roles or r.role in at_roles:
                out.append({"conv_id": r.conv_id, "turn": r.turn, "n_history": len(hist),
                            "history_chars": sum(len(h["content"] or "") for h in hist), "history": hist})
        if keep_history:
            state.update((roles, texts))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "n_history", "history_chars", "history"])

    return turns.groupBy("conv_id").applyInPandasWithState(
        step, outputStructType=HISTORY_SCHEMA,
        stateStructType="roles array<string>, texts array<string>",
        outputMode="append", timeoutConf=GroupStateTimeout.NoTimeout)


def read_turns_stream(spark: SparkSession, directory: str, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(TURN_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(directory)


def result_summary_stream(spark: SparkSession, directory: str) -> DataFrame:
    """JSON result lines (``arm`` column added by the writer) summarised
    per arm; complete mode re-emits the whole (small) summary each batch.
    Lines that don't hold a JSON object (run totals, broken lines) are
    skipped, as in the batch loader. The median is exact: its state keeps a
    count per distinct time of an arm."""
    raw = spark.readStream.text(directory).where(py_strip("value").startswith("{") & F.expr("try_parse_json(value)").isNotNull())
    lines = raw.select(F.from_json(py_strip("value"), RESULT_SCHEMA + ", arm string").alias("r")).select("r.*")
    return lines.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.avg("inference_time").alias("time_mean"),
        F.min("inference_time").alias("time_min"), F.max("inference_time").alias("time_max"),
        F.percentile("inference_time", 0.5).alias("time_median"))


def train_log_stream(spark: SparkSession, directory: str) -> DataFrame:
    """Training-log lines parsed as they arrive (append mode)."""
    lines = spark.readStream.text(directory).select(
        F.col("_metadata.file_name").alias("file_name"), F.lit(0).cast("long").alias("line_no"), "value")
    return parse.parse_train_log(lines).drop("line_no")


def batch_sink(out_dir: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function whose commit key is the batch id: a
    micro-batch is the folder ``batch_id=<id>`` and a replay of it, after a lost
    driver for instance, replaces that folder, so no row lands twice."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}")
    return write


def read_sink(spark: SparkSession, out_dir: str, schema: StructType, mode: str = "append") -> DataFrame:
    """The rows of a folder written by :func:`batch_sink`: all batches, or in
    ``complete`` mode the last one, which holds the whole result."""
    # an empty batch of its own number, so that a stream without any batch reads as no rows
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id=-1")
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch_id", LongType())])).parquet(out_dir)
    if mode == "complete":
        last = rows.agg(F.max("batch_id")).first()[0]
        rows = rows.where(F.col("batch_id") == F.lit(-1 if last is None else last))
    return rows.drop("batch_id")


def run_to_table(df: DataFrame, name: str, mode: str = "append", out_dir: str | None = None,
                 checkpoint: str | None = None) -> DataFrame:
    """Drive a streaming query to completion over the files present now
    (``availableNow``) into a folder of Parquet batches, and return its rows.
    With ``out_dir`` and ``checkpoint`` given, a later call goes on where this
    one ended. Both default to new folders below the checkpoint directory."""
    spark = df.sparkSession
    base = _ckpt(spark, name)
    out_dir, checkpoint = out_dir or f"{base}/rows", checkpoint or f"{base}/state"
    q = (df.writeStream.foreachBatch(batch_sink(out_dir)).queryName(name).outputMode(mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return read_sink(spark, out_dir, df.schema, mode)
