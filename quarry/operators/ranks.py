"""Global rank and prefix sums without a single-partition window.

``Window.orderBy(x)`` with no ``partitionBy`` (or a partition key with a few
huge groups, such as three agents) moves every row of a group into one task.
The two-level scheme here keeps the work spread out:

1. range-partition on ``(group, order..., tiebreak)`` and sort inside each
   partition; ``monotonically_increasing_id`` then encodes
   ``(partition, position in partition)`` in sorted order;
2. aggregate a tiny ``(partition, group) -> count, weight`` table (at most
   partitions + groups rows, because ranges are contiguous);
3. turn it into per-partition offsets with a window over that small table and
   join the offsets back with a broadcast.

The order keys must be a total order (end them with a unique id). The staged
rows are checkpointed (reliable checkpoint, shared ``spark.checkpoint.dir``)
before the two reads, so the partition-encoded ids are computed exactly once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOW_BITS = (1 << 33) - 1


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def rank_within(df: DataFrame, order: Sequence[str | Column], group: Sequence[str] = (),
                weight: str | Column | None = None, rank_col: str = "rank",
                size_col: str | None = None, prefix_col: str | None = None,
                total_col: str | None = None, num_partitions: int | None = None,
                materialize: bool = True) -> DataFrame:
    """Add a 1-based ``rank_col`` per ``group`` following ``order``.

    Optional outputs: ``size_col`` (rows in the group), ``prefix_col`` (sum of
    ``weight`` over earlier rows of the group, exclusive) and ``total_col``
    (sum of ``weight`` over the group).
    """
    group = list(group)
    keys = [*_cols(group), *_cols(order)]
    # Without an explicit count the range exchange uses the shuffle
    # partitions and AQE may coalesce neighbouring ranges to the data size;
    # coalesced partitions are still contiguous ranges, so offsets hold.
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    staged = ranged.sortWithinPartitions(*keys)
    staged = staged.withColumn("__rk_mid", F.monotonically_increasing_id())
    staged = staged.withColumn("__rk_pid", F.shiftright("__rk_mid", 33)).withColumn(
        "__rk_loc", F.col("__rk_mid").bitwiseAND(F.lit(_LOW_BITS)))
    if weight is not None:
        wcol = F.col(weight) if isinstance(weight, str) else weight
        staged = staged.withColumn("__rk_w", wcol.cast("long"))
    if materialize:
        # The ids are read twice (offset table and rows). A reliable
        # checkpoint in the session's checkpoint directory computes them once,
        # so both reads agree even if a task is retried, and it cuts the
        # lineage for the stages that follow.
        staged = staged.checkpoint(eager=True)

    aggs = [F.count(F.lit(1)).alias("__rk_cnt"), F.min("__rk_loc").alias("__rk_first")]
    if weight is not None:
        aggs.append(F.sum("__rk_w").alias("__rk_wsum"))
    stats = staged.groupBy("__rk_pid", *group).agg(*aggs)
    w_before = Window.partitionBy(*group).orderBy("__rk_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*group)
    stats = stats.withColumn("__rk_off", F.coalesce(F.sum("__rk_cnt").over(w_before), F.lit(0)))
    if size_col:
        stats = stats.withColumn(size_col, F.sum("__rk_cnt").over(w_all))
    if weight is not None:
        stats = stats.withColumn("__rk_woff", F.coalesce(F.sum("__rk_wsum").over(w_before), F.lit(0)))
        if total_col:
            stats = stats.withColumn(total_col, F.sum("__rk_wsum").over(w_all))
    stats = stats.drop("__rk_cnt", "__rk_wsum")

    # stats has at most (partitions + groups) rows: one row per partition and
    # per group boundary inside a partition. Without groups that is bounded by
    # the partition count and is broadcast; with groups AQE chooses from the
    # measured size.
    side = stats if group else F.broadcast(stats)
    out = staged.join(side, on=["__rk_pid", *group], how="inner")
    out = out.withColumn(rank_col, F.col("__rk_off") + F.col("__rk_loc") - F.col("__rk_first") + 1)
    if weight is not None:
        # running weight inside a partition: a window keyed by the partition
        # id moves each partition to exactly one task (no hot key: ranges are
        # balanced by the range partitioner).
        wp = Window.partitionBy("__rk_pid", *group).orderBy("__rk_loc").rowsBetween(
            Window.unboundedPreceding, -1)
        out = out.withColumn("__rk_lw", F.coalesce(F.sum("__rk_w").over(wp), F.lit(0)))
        if prefix_col:
            out = out.withColumn(prefix_col, F.col("__rk_woff") + F.col("__rk_lw"))
    drop = ["__rk_mid", "__rk_pid", "__rk_loc", "__rk_first", "__rk_off", "__rk_woff", "__rk_w", "__rk_lw"]
    return out.drop(*[c for c in drop if c in out.columns])


def rank_by_hash(df: DataFrame, key: str, tiebreak: str, group: Sequence[str] = (), rank_col: str = "rank",
                 size_col: str | None = None, prefix_len: int = 4) -> DataFrame:
    """Rank by a uniform hexadecimal hash key (e.g. a seeded md5), ties by
    ``tiebreak``. The first ``prefix_len`` hex digits are a bucket that is
    monotone in the key and, because the key is uniform, holds about
    ``n / 16**prefix_len`` rows: rows are numbered inside their bucket with a
    window keyed by (group, bucket), and the bucket offsets come from a count
    table of at most ``16**prefix_len`` rows per group.

    Unlike :func:`rank_within` there is no range-sampling pass and no
    checkpoint: the input is shuffled once (the count table reuses that
    shuffle) and the result is deterministic, so a re-run task recomputes the
    same ranks. Choose ``prefix_len`` so a bucket fits a task (4 up to ~10^9
    rows per group, 5-6 beyond).
    """
    group = list(group)
    b = F.substring(F.col(key), 1, prefix_len)
    wb = Window.partitionBy(*group, "__hb")
    x = df.withColumn("__hb", b)
    x = x.withColumn("__hl", F.row_number().over(wb.orderBy(key, tiebreak))).withColumn(
        "__hn", F.count(F.lit(1)).over(wb))
    counts = x.groupBy(*group, "__hb").agg(F.max("__hn").alias("__hn"))
    wg = Window.partitionBy(*group).orderBy("__hb")
    offs = counts.withColumn("__ho", F.coalesce(
        F.sum("__hn").over(wg.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if size_col:
        offs = offs.withColumn(size_col, F.sum("__hn").over(Window.partitionBy(*group)))
    offs = offs.drop("__hn")
    # at most 16**prefix_len rows per group: broadcast when there is no group
    side = F.broadcast(offs) if not group else offs
    out = x.join(side, on=[*group, "__hb"], how="inner")
    out = out.withColumn(rank_col, F.col("__ho") + F.col("__hl"))
    return out.drop("__hb", "__hl", "__hn", "__ho")
