"""Exact top-k search by inner product with vector-approximation (VA) files.

The VA file holds, for each distinct vector, the number of the cell of every
component: the range between a component's smallest and largest value is cut
into ``cells`` equal cells. A query's score with any vector of a cell lies
within ``q . centre -+ |q| . half width``, so scanning the small cells gives a
lower and an upper bound of every score.

1. Scan: queries and VA file meet in blocks. Each block keeps, per query, the
   vectors whose upper bound reaches the block's k-th best lower bound. The
   k-th best lower bound over all blocks then drops most of what is left.
2. Read: the exact vectors of the ``2 k`` best upper bounds are read and scored;
   then all those whose upper bound still reaches the k-th exact score found,
   after which the k-th result is certain.

Components are integers, so bounds and scores are exact. Equal vectors are
scanned once: only the ``k + 1`` smallest distinct ids of each can be among the
results, each as often as it occurs, ``k`` times at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

QUERY_BLOCK = 8192
SCAN_BLOCK = 32768
#: Queries x vectors whose bounds are held at a time.
PAIRS_AT_ONCE = 1 << 22


def whole(vec: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component, x as double; null if the vector
    is null or has a null or non-finite component."""
    ok = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(ok, F.transform(vec, lambda x: F.floor(x.cast("double") * float(scale)).cast("long")))


def _bounds(q: np.ndarray, codes: np.ndarray, low: np.ndarray, width: np.ndarray):
    """Lower and upper bounds of all scores of ``q`` (rows) with the cells ``codes``, in doubles that hold them exactly."""
    centre2 = 2 * low + (2 * codes.astype(np.float64) + 1) * width - 1  # twice the mean of a cell's first and last integer
    mid = q @ centre2.T
    half = np.abs(q) @ (width - 1)
    return (mid - half[:, None]) / 2, (mid + half[:, None]) / 2


def va_scan(queries: DataFrame, va: DataFrame, low: np.ndarray, width: np.ndarray, k: int) -> DataFrame:
    """``(query_id, cls, lower, upper)``: per query the classes of each block that could be among its k best."""
    qn, cn = queries.count(), va.count()
    qb, cb = max(1, -(-qn // QUERY_BLOCK)), max(1, -(-cn // SCAN_BLOCK))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(qb).cast("long"))).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cb - 1).cast("long"))))
    c = va.withColumn("cb", F.pmod(F.xxhash64("cls"), F.lit(cb).cast("long"))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qb - 1).cast("long"))))

    def run(_, qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(qs) and len(cs):
            codes = np.frombuffer(b"".join(cs["code"]), np.uint8).reshape(len(cs), -1)
            cls, qid = cs["cls"].to_numpy(), qs["query_id"].to_numpy()
            only = np.where(cs["ids"] < 2, cs["low"], 0), (cs["ids"] < 2).to_numpy()
            mat = np.stack(qs["vec"].to_numpy()).astype(np.float64)
            step = max(1, PAIRS_AT_ONCE // len(cs))
            for at in range(0, len(qs), step):
                lo, up = _bounds(mat[at:at + step], codes, low, width)
                # a class that holds the query's own id only has no result
                alone = (only[0][None, :] == qid[at:at + step, None]) & only[1][None, :]
                if len(cs) > k:
                    sure = np.where(alone, -np.inf, lo)
                    bar = np.partition(sure, len(cs) - k, axis=1)[:, len(cs) - k]
                    r, j = np.nonzero(up >= bar[:, None])
                else:
                    r, j = (x.ravel() for x in np.indices(up.shape))
                out.append(pd.DataFrame({"query_id": qid[at + r], "cls": cls[j],
                                         "lower": lo[r, j], "upper": up[r, j], "alone": alone[r, j]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "cls": [], "lower": [], "upper": [], "alone": []})

    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, cls bigint, lower double, upper double, alone boolean"
    return q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(lambda key, a, b: run(key, a, b), kind)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, cells: int = 64, scale: int = 256, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, id_col, score)``: for each row whose id is divisible
    by ``every`` its k highest inner products with all other rows, ties to the
    smaller id; all of them if there are fewer.

    Vectors that are null or hold a null or non-finite component take no part,
    nor do rows without an id; vectors of another length than the longest's
    are compared as if filled with zeros. A repeated id counts as often as it
    occurs, but never for a query of the same id. Empty tables give an empty
    result."""
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole(F.col(f"`{vec_col}`"), scale).alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    v = staged(v, "topk-vectors")
    dim = v.agg(F.max(F.size("vec"))).first()[0] or 0
    fill = F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("vec"))
    v = v.withColumn("vec", F.concat("vec", fill))
    # equal vectors are a class; only its k + 1 smallest distinct ids can be results (one of them may be the query's own)
    first = Window.partitionBy("vec").orderBy("id")
    times = v.groupBy("vec", "id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("times"))
    kept = staged(times.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1), "topk-kept")
    classes = kept.groupBy("vec").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("ids"))
    classes = staged(classes.select(F.monotonically_increasing_id().alias("cls"), "low", "ids", "vec"), "topk-classes")
    ends = classes.agg(*[f(F.get("vec", F.lit(j))).alias(f"{n}{j}") for j in range(dim) for n, f in (("a", F.min), ("b", F.max))]).first() if dim else None
    empty = f"query_id bigint, rank int, {id_col} bigint, score bigint"
    if not dim or ends[0] is None:
        return vectors.sparkSession.createDataFrame([], empty)
    low = np.array([ends[f"a{j}"] for j in range(dim)], np.float64)
    high = np.array([ends[f"b{j}"] for j in range(dim)], np.float64)
    width = np.floor((high - low) / cells) + 1  # integers in a cell; the last cell holds the largest value
    cut = classes.select("cls", "low", "ids", F.transform("vec", lambda x, j: F.floor(
        (x - F.get(F.array(*[F.lit(int(a)) for a in low]), j)) / F.get(F.array(*[F.lit(int(w)) for w in width]), j)).cast("tinyint")).alias("c"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cls": b["cls"], "low": b["low"], "ids": b["ids"], "code": [np.asarray(c, np.uint8).tobytes() for c in b["c"]]})

    va = staged(cut.mapInPandas(pack, "cls bigint, low bigint, ids bigint, code binary"), "topk-va")
    asked = v.where(F.col("id") % every == 0).dropDuplicates(["id", "vec"])
    asked = staged(asked.select(F.col("id").alias("query_id"), "vec"), "topk-queries")

    seen = staged(va_scan(asked, va, low, width, k), "topk-scan")
    # the k-th best lower bound of a query over all blocks; a class of its own id alone does not count
    by_low = Window.partitionBy("query_id").orderBy(F.col("lower").desc(), "cls")
    bar = (seen.where("NOT alone").withColumn("_n", F.row_number().over(by_low)).where(F.col("_n") <= k)
           .groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("lower")).alias("bar")))
    seen = staged(seen.join(bar, "query_id", "left").where("bar IS NULL OR upper >= bar").select("query_id", "cls", "upper"), "topk-near")
    by_up = Window.partitionBy("query_id").orderBy(F.col("upper").desc(), "cls")
    ranked = staged(seen.withColumn("_n", F.row_number().over(by_up)), "topk-order")

    def read(wanted: DataFrame) -> DataFrame:
        exact = wanted.join(classes.select("cls", F.col("vec").alias("cv")), "cls").join(asked.select("query_id", F.col("vec").alias("qv")), "query_id")
        dot = F.aggregate(F.zip_with("qv", "cv", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b)
        return exact.select("query_id", "cls", dot.alias("score"))

    best = staged(read(ranked.where(F.col("_n") <= 2 * k)).distinct(), "topk-best")
    members = kept.join(classes.select("vec", "cls"), "vec").select("cls", F.col("id").alias("member"), F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("_one"))
    members = members.drop("_one")
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "member")

    def results(scored: DataFrame) -> DataFrame:
        r = scored.join(members, "cls").where("member <> query_id")
        return r.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)

    sure = results(best).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("kth"))
    more = ranked.where(F.col("_n") > 2 * k).join(sure, "query_id", "left").where("kth IS NULL OR upper >= kth")
    scored = best.union(read(more.select("query_id", "cls")).distinct())
    return results(scored).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("member").alias(id_col), "score")


#: DuckDB SQL for :func:`top_k` with its default parameters, over ``embeddings`` of equally long vectors.
TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
