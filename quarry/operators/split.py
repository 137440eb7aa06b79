"""Splits, shards and batches (deterministic, keyed, no single-partition window)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import SPLIT_SEED, TRAIN_FRACTION_TENTHS
from .ranks import rank_by_hash, rank_within


def shuffle_key(id_col: str = "pair_id", seed: int = SPLIT_SEED) -> Column:
    """Seeded shuffle order: ``md5('<seed>|<id>')`` (hex), ties by id."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


def _train_limit(n: Column, train_tenths: int) -> Column:
    return F.floor(n * F.lit(train_tenths) / F.lit(10))


def split_random(df: DataFrame, group: Sequence[str] = ("agent",), id_col: str = "pair_id",
                 seed: int = SPLIT_SEED, train_tenths: int = TRAIN_FRACTION_TENTHS,
                 shuffle: bool = True, order: Sequence[str] = (), method: str = "range") -> DataFrame:
    """Per group, the first ``floor(n * tenths / 10)`` rows of the
    seeded shuffle order are train, the rest test (``shuffle=False``: the
    ``order`` columns decide). Adds ``split``, ``split_key`` and
    ``shuffle_rank`` (position in the shuffled order inside the group) and
    ``split_rank`` (position inside the row's own split).

    ``method='range'`` (default) ranks with :func:`rank_within`, whose
    checkpoint also serves the many later reads of a split;
    ``method='hash'`` uses :func:`rank_by_hash` (the md5 order is uniform):
    one shuffle, no sampling pass and no checkpoint -- the better choice when
    the split is written out once."""
    if shuffle:
        df = df.withColumn("split_key", shuffle_key(id_col, seed))
        if method == "hash":
            out = rank_by_hash(df, "split_key", id_col, group=group, rank_col="shuffle_rank", size_col="_n")
        else:
            out = rank_within(df, order=["split_key", id_col], group=group, rank_col="shuffle_rank", size_col="_n")
    else:
        out = rank_within(df, order=[*order, id_col], group=group, rank_col="shuffle_rank", size_col="_n")
    lim = _train_limit(F.col("_n"), train_tenths)
    out = out.withColumn("split", F.when(F.col("shuffle_rank") <= lim, "train").otherwise("test"))
    out = out.withColumn("split_rank", F.when(F.col("split") == "train", F.col("shuffle_rank"))
                         .otherwise(F.col("shuffle_rank") - lim))
    return out.drop("_n")


def split_hash(df: DataFrame, id_col: str = "pair_id", seed: int = SPLIT_SEED,
               train_tenths: int = TRAIN_FRACTION_TENTHS) -> DataFrame:
    """Scalable Bernoulli split: train iff the first 32 bits of the seeded md5
    fall under ``tenths/10`` of the range. No sort and no shuffle: a narrow
    projection over any number of partitions (sizes are ~80/20, not exact)."""
    h = F.conv(F.substring(shuffle_key(id_col, seed), 1, 8), 16, 10).cast("long")
    bound = (1 << 32) * train_tenths // 10
    return df.withColumn("split", F.when(h < F.lit(bound), "train").otherwise("test"))


def split_ordered(df: DataFrame, order: Sequence[str], group: Sequence[str] = (),
                  train_tenths: int = TRAIN_FRACTION_TENTHS) -> DataFrame:
    """First ``floor(n * tenths / 10)`` rows in ``order`` are train."""
    out = rank_within(df, order=list(order), group=group, rank_col="pos", size_col="_n")
    lim = _train_limit(F.col("_n"), train_tenths)
    return out.withColumn("split", F.when(F.col("pos") <= lim, "train").otherwise("test")).drop("_n")


def shard_assign(df: DataFrame, num_replicas: int, order: Sequence[str] | None = None,
                 id_col: str = "pair_id", seed: int = SPLIT_SEED, shuffle: bool = True) -> DataFrame:
    """Replica ``r`` gets positions ``r, r+N, ...`` of the (shuffled)
    order; the remainder ``n mod N`` is dropped (``drop_last``). The shuffled
    order is a uniform md5 key, so it is ranked by hash buckets (one shuffle,
    no sampling pass)."""
    if shuffle:
        df = df.withColumn("_k", shuffle_key(id_col, seed))
        out = rank_by_hash(df, "_k", id_col, rank_col="_r", size_col="_n")
    else:
        out = rank_within(df, order=[*(order or []), id_col], rank_col="_r", size_col="_n")
    keep = F.col("_r") <= F.floor(F.col("_n") / num_replicas) * num_replicas
    out = out.where(keep).withColumn("shard", ((F.col("_r") - 1) % num_replicas).cast("int"))
    return out.drop("_r", "_n", *(["_k"] if shuffle else []))


def fixed_batches(df: DataFrame, batch_size: int, order: Sequence[str], drop_last: bool = False,
                  group: Sequence[str] = ()) -> DataFrame:
    """Consecutive batches of ``batch_size`` in ``order``."""
    out = rank_within(df, order=list(order), group=group, rank_col="_r", size_col="_n")
    out = out.withColumn("batch", F.floor((F.col("_r") - 1) / batch_size).cast("long"))
    out = out.withColumn("batch_pos", ((F.col("_r") - 1) % batch_size).cast("int"))
    if drop_last:
        out = out.where(F.col("_r") <= F.floor(F.col("_n") / batch_size) * batch_size)
    return out.drop("_r", "_n")


def length_batches(df: DataFrame, batch_size: int, length: str, id_col: str = "pair_id",
                   shuffle: bool = True, seed: int = SPLIT_SEED) -> DataFrame:
    """Sort by ``(length, id)``, cut into batches of ``batch_size``, drop the
    incomplete last batch, and (train) visit batches in a seeded shuffled
    order given by ``batch_order``."""
    out = fixed_batches(df, batch_size, order=[length, id_col], drop_last=True)
    if shuffle:
        bkey = F.md5(F.concat(F.lit(f"{seed}|batch|"), F.col("batch").cast("string")))
        # one row per batch (rows / batch_size); the md5 order is uniform, so
        # the batches are ranked by hash buckets, then joined back by key
        batches = out.select("batch").distinct().withColumn("_bk", bkey)
        batches = rank_by_hash(batches, "_bk", "batch", rank_col="batch_order").drop("_bk")
        out = out.join(batches, on="batch", how="inner")
        out = out.withColumn("batch_order", F.col("batch_order") - 1)
    else:
        out = out.withColumn("batch_order", F.col("batch"))
    return out
