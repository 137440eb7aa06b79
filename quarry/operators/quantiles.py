"""Exact quantiles (linear interpolation) by radix selection.

For probability ``p`` and ``n`` values, ``h = (n - 1) p`` and the result is
``x[floor h] + (h - floor h) (x[floor h + 1] - x[floor h])`` (0-based), the
default of numpy, Spark ``percentile`` and DuckDB ``quantile_cont``.

No value is sorted or moved. A pass counts the values of each wanted range by
buckets (first by sign and leading bits of the magnitude, then by equal parts
of the range), with the least and greatest value of each bucket; the bucket
that holds the wanted rank is the next range. A pass shuffles at most
``PARTS`` counts a range and map task, whatever the table's size, and equal
values are one bucket, however many. It ends when each range holds one value:
after a pass by magnitude, the parts of ``2^-SPLITS`` of an octave halve
12 times a pass, so a double's 52 bits last five passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 4096
OCTAVE_PARTS = 16


def _name(p: float) -> str:
    return f"q{int(round(p * 1000)):04d}"


def _by_magnitude(v: Column) -> Column:
    """A bucket number that never falls as the value grows: sixteenths of
    octaves, mirrored for negative values; infinities and NaN have their own."""
    size = F.floor(F.log2(F.abs(v)) * OCTAVE_PARTS) + 1100 * OCTAVE_PARTS
    top = F.lit(4000 * OCTAVE_PARTS)
    return (F.when(F.isnan(v), top + 1).when(v == float("inf"), top).when(v == float("-inf"), -top)
            .when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size)).cast("long")


def _by_part(v: Column, lo: Column, hi: Column) -> Column:
    # halves first, so that the width of a range of either sign stays finite
    share = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    return F.when(hi > lo, F.floor(F.least(share, F.lit(1.0)) * PARTS)).otherwise(F.lit(0)).cast("long")


def _narrowed(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Per wanted rank the bucket that holds it, as the next range."""
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_rank").orderBy("_bucket"))
    left = F.col("_rank_left")
    return counts.withColumn("_upto", upto).where((left > F.col("_upto") - F.col("_n")) & (left <= F.col("_upto"))).select(
        *keys, "_rank", (left - F.col("_upto") + F.col("_n")).alias("_rank_left"), "_lo", "_hi")


def _values_at(values: DataFrame, keys: list[str], ranks: DataFrame) -> DataFrame:
    """``(keys, _rank, _lo)``: the value at each rank (from 1). ``values`` is a
    written table, read once a pass; of a pass, one number goes to the driver."""
    counts = values.groupBy(*keys, _by_magnitude(F.col("_v")).alias("_bucket")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ranges = _narrowed(counts.join(ranks.withColumn("_rank_left", F.col("_rank")), on=keys), keys).checkpoint()
    while True:
        wide = ranges.where(F.col("_lo") < F.col("_hi"))
        if wide.isEmpty():
            return ranges.select(*keys, "_rank", "_lo")
        done = ranges.where(~(F.col("_lo") < F.col("_hi")))
        # ranks in the same range are counted once
        spans = wide.select(*keys, F.col("_lo").alias("_from"), F.col("_hi").alias("_to")).distinct()
        inside = values.join(spans, on=keys).where(F.col("_v").between(F.col("_from"), F.col("_to")))
        counts = inside.groupBy(*keys, "_from", "_to", _by_part(F.col("_v"), F.col("_from"), F.col("_to")).alias("_bucket")).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        wanted = wide.select(*keys, F.col("_lo").alias("_from"), F.col("_hi").alias("_to"), "_rank", "_rank_left")
        ranges = _narrowed(counts.join(wanted, on=[*keys, "_from", "_to"]), keys).unionByName(done).checkpoint()


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], group: Sequence[str] = (),
                    staged: bool = False) -> DataFrame:
    """One row per group with a column per probability (``q0100`` for 0.1 ...).

    Nulls take no part; a null group is a group; NaN is the greatest value; no
    value gives no row (without a group, one row of nulls). ``staged``: the
    input is already a written table, else the values are written once."""
    group = list(group)
    # one key that is never null: a null group joins like any other
    key = F.struct(*[F.struct(F.col(g).isNull().alias("none"), F.col(g).alias("value")).alias(f"g{i}")
                     for i, g in enumerate(group)]) if group else F.lit(0)
    values = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    if group:
        values = values.withColumn("_g", F.to_json(key))
    else:
        values = values.withColumn("_g", key)
    if not staged:
        values = values.checkpoint()
    sizes = values.groupBy("_g").agg(F.count(F.lit(1)).alias("_size"), *[F.first(g).alias(g) for g in group])
    at = []
    for p in probs:
        h = (F.col("_size") - 1) * F.lit(float(p))
        at += [(F.floor(h) + 1).alias("_rank"), F.least(F.floor(h) + 2, F.col("_size")).alias("_rank")]
    ranks = sizes.select("_g", F.explode(F.array_distinct(F.array(*at))).alias("_rank"))
    found = _values_at(values.select("_g", "_v"), ["_g"], ranks)
    picked = sizes.join(found, on="_g")
    outs = []
    for p in probs:
        h = (F.col("_size") - 1) * F.lit(float(p))
        lo = F.max(F.when(F.col("_rank") == F.floor(h) + 1, F.col("_lo")))
        hi = F.max(F.when(F.col("_rank") == F.least(F.floor(h) + 2, F.col("_size")), F.col("_lo")))
        part = F.max(h - F.floor(h))
        outs.append(F.when((part == 0) | (lo == hi), lo).otherwise(lo + part * (hi - lo)).alias(_name(p)))
    if not group:
        return picked.agg(*outs)
    return picked.groupBy("_g").agg(*[F.first(g).alias(g) for g in group], *outs).drop("_g")


def summary(df: DataFrame, value: str, probs: Sequence[float] = (0.1, 0.5, 0.9),
            group: Sequence[str] = ()) -> DataFrame:
    """min, max, mean (one aggregation with partial combine) joined with the
    exact quantiles; both sides have one row per group. The values are written
    once, as narrow rows."""
    group = list(group)
    key = group or ["_k"]
    base = (df if group else df.withColumn("_k", F.lit(0))).select(*key, value).checkpoint()
    mm = base.groupBy(*key).agg(F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"),
                                F.avg(value).alias("mean"))
    qs = exact_quantiles(base, value, probs, key, staged=True)
    same = F.lit(True)
    for k in key:
        same = same & mm[k].eqNullSafe(qs[k])
    out = mm.join(qs, on=same, how="left").select(*[mm[k] for k in key], "min", "max", "mean", *[_name(p) for p in probs])
    return out.drop("_k") if not group else out
