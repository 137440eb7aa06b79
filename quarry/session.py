"""Spark session, table loading and checkpoint-directory helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "quarry") -> SparkSession:
    """Session tuned for local runs. Whatever ``spark-submit`` (or
    ``PYSPARK_SUBMIT_ARGS``) has set wins over the defaults here; an explicit
    argument wins over both."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    defaults = {
        "spark.master": f"local[{cpus}]",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": cpus,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.driver.memory": os.environ.get("QUARRY_DRIVER_MEMORY", "16g"),
    }
    asked = {"spark.master": master, "spark.sql.shuffle.partitions": shuffle_partitions}
    conf = {k: v for k, v in defaults.items() if k not in _submitted()}
    conf |= {k: str(v) for k, v in asked.items() if v}
    spark = SparkSession.builder.appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def _submitted() -> set[str]:
    """Names of the settings that this application was submitted with."""
    if "PYSPARK_GATEWAY_PORT" not in os.environ and "PYSPARK_SUBMIT_ARGS" not in os.environ:
        return set()
    SparkContext._ensure_initialized()  # the JVM holds the submitted settings
    return {k for k, _ in SparkConf().getAll()}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in Python workers (UDFs, ``mapInPandas``
    and ``applyInPandas`` functions are pickled by module reference).
    Zips the package once per SparkContext and registers it with
    ``addPyFile``, which distributes it to every executor."""
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="quarry-py-"), "quarry.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg_dir):
            if "__pycache__" in d:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only when nothing is configured and the master is local (tests) a
    private folder is created; any other master raises, because executors
    could not share such a folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="quarry-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", conf_dir)
        except Exception:  # core confs may be read-only at run time
            pass
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
