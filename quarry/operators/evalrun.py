"""Evaluation results: loading, pairing, per-arm summaries, latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from .ranks import rank_within

RESULT_SCHEMA = ("query string, target_text string, response string, inference_time double, "
                 "answer_only string, bleu_score double, "
                 "rouge_score struct<rouge1:double,rouge2:double,rougeL:double,rougeLsum:double>")


def parse_result_lines(lines: DataFrame, value: str = "value", line_no: str = "line_no",
                       schema: str = RESULT_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """JSON result lines -> (good rows, rejects). Lines that do not
    start with ``{`` after stripping are skipped (a ``Total Time: ...`` line
    can land in result files); lines that fail to parse are returned as
    rejects with their line number instead of stopping the job."""
    s = py_strip(F.col(value))
    cand = lines.where(s.startswith("{"))
    # null only for malformed JSON: a valid record with a null query is good
    ok = F.try_parse_json(s).isNotNull()
    good = cand.where(ok).select(line_no, F.from_json(s, schema, {"mode": "PERMISSIVE"}).alias("_r")).select(line_no, "_r.*")
    bad = cand.where(~ok).select(line_no, F.col(value).alias("line"))
    return good, bad


def eval_join(queries: DataFrame, responses: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """Query i, target i and response i are paired by key, not position."""
    return queries.join(responses, on=id_col, how="inner")


def eval_summary(scored: DataFrame, arm: str = "arm", metric: str = "meteor",
                 time_col: str | None = None) -> DataFrame:
    """A7/A8/A13/V6 per arm: rows scored and invalid, metric min/max/mean/
    median over valid rows, and the same four of a time column when given.
    Invalid rows are counted per arm (the reference's shared counter is not
    reproduced). An arm without a valid row has null statistics. The scored rows
    are written once, as narrow rows, before the passes of the medians."""
    from .quantiles import exact_quantiles
    names = {metric: metric} | ({time_col: "time"} if time_col else {})
    v = F.col("valid")
    rows = scored.select(arm, "valid", *names).checkpoint()
    stats = rows.groupBy(arm).agg(F.count_if(v).alias("n_scored"), F.count_if(~v).alias("n_invalid"), *[
        f(F.when(v, F.col(c))).alias(f"{name}_{f.__name__.replace('avg', 'mean')}")
        for c, name in names.items() for f in (F.min, F.max, F.avg)])
    long = rows.where(v).select(arm, F.explode(F.create_map(*[
        x for c, name in names.items() for x in (F.lit(name), F.col(c).cast("double"))])).alias("_m", "_v"))
    med = exact_quantiles(long, "_v", [0.5], [arm, "_m"], staged=True).groupBy(arm).agg(*[
        F.max(F.when(F.col("_m") == name, F.col("q0500"))).alias(f"{name}_median") for name in names.values()])
    return stats.join(med, on=arm, how="left")


def eval_paired_arms(scored: DataFrame, arm_a: str, arm_b: str, id_col: str = "pair_id", arm: str = "arm",
                     metric: str = "meteor") -> DataFrame:
    """J7/M6 over stacked arms: the items valid in both arms, with the mean
    paired difference ``a - b``. The scores are read once: an id's two arms meet
    in one aggregation. An id has at most one row an arm."""
    def of(name: str):
        return F.max(F.when(F.col("valid") & (F.col(arm) == name), F.col(metric)))

    j = scored.where(F.col(arm).isin(arm_a, arm_b)).groupBy(id_col).agg(of(arm_a).alias("_a"), of(arm_b).alias("_b"))
    return j.where(F.col("_a").isNotNull() & F.col("_b").isNotNull()).agg(
        F.count(F.lit(1)).alias("n_common"), F.avg("_a").alias("mean_a"),
        F.avg("_b").alias("mean_b"), F.avg(F.col("_a") - F.col("_b")).alias("mean_diff"))


def eval_paired(a: DataFrame, b: DataFrame, id_col: str = "pair_id", metric: str = "meteor") -> DataFrame:
    """Items valid in both arms (``left_anti`` of each arm's invalid
    rows, by key), with the mean paired difference ``a - b``."""
    inval = a.where(~F.col("valid")).select(id_col).unionByName(b.where(~F.col("valid")).select(id_col))
    aa = a.join(inval, on=id_col, how="left_anti").select(id_col, F.col(metric).alias("_a"))
    bb = b.join(inval, on=id_col, how="left_anti").select(id_col, F.col(metric).alias("_b"))
    j = aa.join(bb, on=id_col, how="inner")
    return j.agg(F.count(F.lit(1)).alias("n_common"), F.avg("_a").alias("mean_a"),
                 F.avg("_b").alias("mean_b"), F.avg(F.col("_a") - F.col("_b")).alias("mean_diff"))


def batch_latency(df: DataFrame, value: str, order: list[str], batch_size: int,
                  group: list[str] = ()) -> DataFrame:
    """Consecutive batches of ``batch_size`` (per group); each row gets
    the batch mean ``sum / count`` -- the elapsed time of a batch divided by
    its size, shared by its rows. Batches are bounded, so the window is
    small."""
    r = rank_within(df, order=order, group=list(group), rank_col="_r")
    r = r.withColumn("batch", F.floor((F.col("_r") - 1) / batch_size).cast("long")).drop("_r")
    w = Window.partitionBy(*group, "batch")
    return r.withColumn("latency", F.sum(value).over(w) / F.count(F.lit(1)).over(w))


def arm_latency(df: DataFrame, arm: str, value: str) -> DataFrame:
    """Mean (and range) of per-row latency per arm."""
    return df.groupBy(arm).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("time_mean"),
                               F.min(value).alias("time_min"), F.max(value).alias("time_max"))


def result_records(answers: DataFrame, prediction: str, id_col: str = "pair_id", query: str = "input_text",
                   target: str = "target_text", response: str = "response",
                   time_col: str = "inference_time", with_answer_only: bool = True) -> DataFrame:
    """E2/E3 result record (D12) per answered question: query, target,
    response, inference time, ``answer_only`` (baseline arm), BLEU of the
    prediction and ``rouge_score`` (rouge1, rouge2, rougeL, rougeLsum).
    The metric columns come from one scoring pass keyed by ``id_col``."""
    from .metrics import score_all
    scored = score_all(answers.select(id_col, F.col(prediction).alias("_pred"), F.col(target).alias("_ref")),
                       id_col, "_pred", "_ref")
    rec = answers.join(scored, on=id_col, how="inner")
    cols = [id_col, F.col(query).alias("query"), F.col(target).alias("target_text"),
            F.col(response).alias("response"), F.col(time_col).alias("inference_time")]
    if with_answer_only:
        cols.append(F.col(prediction).alias("answer_only"))
    cols += [F.col("bleu").alias("bleu_score"),
             F.struct("rouge1", "rouge2", "rougeL", "rougeLsum").alias("rouge_score")]
    return rec.select(*cols)
