"""Agent routing tables: assignment, per-agent counts, orchestrator union."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import AGENT_CHAPTERS
from .ranks import rank_within


def agent_dim(spark: SparkSession, mapping: dict[int, list] | None = None) -> DataFrame:
    """Small dimension ``(agent int, chapter string)`` from an agent map.
    Chapter entries may be names (``"ch03"``) or numbers (``3`` ->
    ``"ch03"``, the notebook's form). A chapter listed for two agents gives
    two rows (a pair then belongs to both, e.g. with the orchestrator set)."""
    mapping = mapping or AGENT_CHAPTERS
    rows = [(int(a), ch if isinstance(ch, str) else f"ch{int(ch):02d}") for a, chs in mapping.items() for ch in chs]
    return spark.createDataFrame(rows, "agent int, chapter string")


def assign_agents(pairs: DataFrame, dim: DataFrame | None = None, how: str = "left") -> DataFrame:
    """Agent by chapter. The map is a configuration table of a few dozen
    rows (its size is fixed by the map, not by the data), so it is broadcast
    and the pairs are never shuffled. Unmatched chapters get a null agent."""
    dim = dim if dim is not None else agent_dim(pairs.sparkSession)
    return pairs.join(F.broadcast(dim), on="chapter", how=how)


def count_by_agent(assigned: DataFrame, agent: str = "agent") -> DataFrame:
    """A1: pairs per agent (partial aggregation before the shuffle)."""
    return assigned.groupBy(agent).agg(F.count(F.lit(1)).alias("n_pairs"))


def orchestrator_union(splits: DataFrame, agent: str = "agent", split: str = "split",
                       order: str = "split_rank") -> DataFrame:
    """Train of agents 1..3 then test of agents 1..3, each in its own
    order, duplicates kept. Adds the 1-based global position ``orch_pos``."""
    split_no = F.when(F.col(split) == "train", 0).otherwise(1)
    df = splits.withColumn("_split_no", split_no)
    out = rank_within(df, order=["_split_no", agent, order, "pair_id"], rank_col="orch_pos",
                      size_col="orch_n")
    return out.drop("_split_no")


def orchestrator_split(splits: DataFrame, train_tenths: int = 8, **kw) -> DataFrame:
    """Re-split the ordered union at ``floor(0.8 n)``; ``moved`` marks rows
    whose split changed."""
    u = orchestrator_union(splits, **kw)
    new = F.when(F.col("orch_pos") <= F.floor(F.col("orch_n") * train_tenths / 10), "train") \
        .otherwise("test")
    return u.withColumn("orch_split", new).withColumn("moved", F.col("orch_split") != F.col("split"))
