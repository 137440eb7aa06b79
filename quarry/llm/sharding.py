"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition is ``shards`` piles of bytes; at first every group is one,
with all its bytes in one pile. The two partial partitions of the largest
spread (heaviest less lightest pile) are combined again and again, the heaviest
pile of one with the lightest of the other, until one is left: its piles are
the shards.

To spread the work, groups are hashed into cells of about ``cell`` groups and
each cell is differenced in a task of its own. What remains of a cell is again
a partial partition, ``shards`` numbers, so cells are combined by the same
rule, ``fan_in`` at a time, level by level up to one. Only pile totals move
between levels, and a pile of a cell keeps its name, so the way from a group to
its shard is a short chain of joins on (cell, pile).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import rank_within
from .common import crc_text, staged

OVERHEAD = 16


def difference(piles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of ``piles``) into one. Returns for
    every row and pile the pile of the result it went to, and the result's piles."""
    n, k = piles.shape
    slots = np.argsort(piles, axis=1, kind="stable")  # ascending place -> pile of the row
    sums: list[np.ndarray | None] = list(np.take_along_axis(piles, slots, 1))
    heap = [(-int(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    kids: list[tuple[int, int]] = []
    orders: list[np.ndarray] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = np.argsort(both, kind="stable")
        kids.append((a, b))
        orders.append(order)
        sums[a] = sums[b] = None
        sums.append(both[order])
        heapq.heappush(heap, (-int(sums[-1][-1] - sums[-1][0]), len(sums) - 1))
    # from the last combination back: where does each place of a node end up?
    to: dict[int, np.ndarray] = {len(sums) - 1: np.arange(k)}
    for no in range(len(kids) - 1, -1, -1):
        end = np.empty(k, np.int64)
        end[orders[no]] = to.pop(n + no)  # place before sorting -> final pile
        a, b = kids[no]
        to[a], to[b] = end, end[::-1]
    out = np.empty((n, k), np.int64)
    for i in range(n):
        out[i, slots[i]] = to[i]
    return out, sums[-1]


def assign_groups(groups: DataFrame, shards: int, key: str = "key", size: str = "size", cell: int = 20_000, fan_in: int = 256) -> DataFrame:
    """``(key, shard)`` for groups with unique keys: Karmarkar-Karp over all of them."""
    n = groups.count()
    cells = max(1, -(-n // cell))
    dealt = groups.select(F.col(key).alias("key"), F.col(size).cast("long").alias("size"),
                          F.pmod(F.xxhash64(key), F.lit(cells)).alias("cell"))

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], ignore_index=True)
        piles = np.zeros((len(pdf), shards), np.int64)
        piles[:, -1] = pdf["size"]
        to, total = difference(piles)
        return pd.DataFrame({"key": pdf["key"], "cell": pdf["cell"], "pile": to[:, -1], "bytes": total[to[:, -1]]})

    kind = groups.schema[key].dataType.simpleString()
    # pile totals ride along with the groups, so a cell is differenced once
    placed = staged(dealt.groupBy("cell").applyInPandas(leaf, f"key {kind}, cell bigint, pile bigint, bytes bigint"), "shard-leaf")
    level = placed.select("cell", "pile", "bytes").distinct()
    way = placed.select("key", "cell", "pile")
    while cells > 1:
        def combine(pdf: pd.DataFrame) -> pd.DataFrame:
            names = np.sort(pdf["cell"].unique())
            piles = np.zeros((len(names), shards), np.int64)
            row = np.searchsorted(names, pdf["cell"])
            piles[row, pdf["pile"]] = pdf["bytes"]
            to, total = difference(piles)
            end = to[row, pdf["pile"]]
            return pd.DataFrame({"cell": pdf["cell"], "pile": pdf["pile"], "up": pdf["up"], "end": end, "bytes": total[end]})

        up = level.withColumn("up", F.floor(F.col("cell") / fan_in).cast("long"))
        step = staged(up.groupBy("up").applyInPandas(combine, "cell bigint, pile bigint, up bigint, end bigint, bytes bigint"), "shard-level")
        way = way.join(step.select("cell", "pile", "up", "end"), ["cell", "pile"]).select("key", F.col("up").alias("cell"), F.col("end").alias("pile"))
        level = step.select(F.col("up").alias("cell"), F.col("end").alias("pile"), "bytes").distinct()
        cells = -(-cells // fan_in)
    return way.select("key", F.col("pile").cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", cell: int = 20_000) -> DataFrame:
    """Per row of ``docs``: ``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``.

    Law ``bytes``: sizes (UTF-8 bytes of the text plus 16, as framed in a
    shard file) are balanced; documents with equal texts are one indivisible
    group. Null texts are a group of their own beside the empty ones, of no
    bytes and CRC 0. ``slot`` numbers a shard's rows from 0 by group, id and
    arrival; with fewer groups than shards some shards stay empty. Repeated
    rows each have a slot. Rows are told apart by their place in a staged copy
    of ids and sizes, so null or repeated ids are no obstacle.
    """
    t = F.col(f"`{text_col}`")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        crc_text(t).alias("text_crc32"),
        F.coalesce(F.sha2(t, 256), F.lit("null")).alias("key"))
    rows = staged(rows, "shard-rows")
    groups = staged(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    where = staged(assign_groups(groups, shards, cell=cell), "shard-where")
    out = rows.join(where, "key")
    out = rank_within(out, ["key", "doc_id"], group=["shard"], rank_col="slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      (F.col("slot") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
