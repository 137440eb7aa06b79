"""Helpers shared by the operators of this subpackage.

Intermediate tables that several later steps read are written once as Parquet
below the session's shared checkpoint folder (:func:`staged`), so a lost
executor costs a re-read and never a recomputation with other results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A word is a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Number of words of a text, as a long; 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarry-{kind}-{uuid.uuid4().hex}"


def staged(df: DataFrame, kind: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.
    Cuts the lineage; later readers still get column pruning."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a URI (``file:``, ``hdfs:``, ``s3:``, Spark's ``s3a:`` and ``s3n:``, ...) or of a plain path."""
    if path.startswith(("s3a://", "s3n://")):
        path = "s3" + path[3:]
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[len("file:"):]
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


#: Rows handed to a Python worker at a time. Texts are long: Spark's default of 10,000 rows takes hundreds of MB.
ROWS_PER_BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers in batches of ``ROWS_PER_BATCH`` rows, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ROWS_PER_BATCH:
        spark.conf.set(key, ROWS_PER_BATCH)


def batches_of_bytes(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of rows whose ``column`` holds about
    ``limit`` bytes; a longer value is a run by itself. No row is lost."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes + 1)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def byte_rows(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, empty for null."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def crc_text(c: Column) -> Column:
    """Unsigned CRC-32 of a text's UTF-8 bytes, that of no bytes (0) for null."""
    return F.crc32(F.coalesce(c, F.lit("")).cast("binary"))


def local_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` indices over the links ``a[i] - b[i]``."""
    lab = np.arange(n)
    while True:
        new = lab.copy()
        la, lb = lab[a], lab[b]
        m = np.minimum(la, lb)
        np.minimum.at(new, la, m)
        np.minimum.at(new, lb, m)
        while True:
            nn = new[new]
            if np.array_equal(nn, new):
                break
            new = nn
        if np.array_equal(new, lab):
            return lab
        lab = new


def components(edges: DataFrame, a: str = "a", b: str = "b", kind: str = "cc") -> DataFrame:
    """Connected components of the links ``a - b``: ``(node, root)``, root being
    the smallest node reachable. Nodes without a link to another node are absent.

    Alternating large-star and small-star steps: every step moves a node's
    links to its smallest neighbour, so stars form in a number of rounds that
    grows with the logarithm of the component's size. The minima are staged
    before the join, so both join sides come from plain exchanges whose large
    partitions (the hub of a star) Spark splits. Only two counters reach the
    driver in each round.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = staged(e, kind)
    last = None
    while True:
        # large star: larger neighbours of u go to the smallest of u's closed neighbourhood
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = staged(both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m")), kind)
        big = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = staged(big.where("u <> v").distinct(), kind)
        # small star: smaller neighbours of u, and u itself, go to the smallest of them
        m = staged(big.groupBy("u").agg(F.min("v").alias("m")), kind)
        small = big.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(m.select("u", F.col("m").alias("v")).union(small).distinct(), kind)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    star = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def need(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the named columns, so that other columns can't clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, names with dots included."""
    return [F.col(f"`{c}`") for c in df.columns]
