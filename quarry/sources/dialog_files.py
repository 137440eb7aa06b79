"""Dialog files, read in parts.

A dialog file is one JSON list of dialogs, each a list of ``{role, content}``
messages, and may be larger than a task. Spark's text source reads it with
``]`` as record separator, so a large file is split like any other text file
and a record is the text up to the next ``]``. Whether that bracket is
structure or stands inside a string depends on all text before it:

1. A split's records are counted twice over, for a split that begins outside a
   string and for one that begins inside: quotes, and lists opened less lists
   closed. A split is a row of that table.
2. Prefix sums over a file's splits tell how each one begins, and sums over the
   records of a split (one window task a split, as large as Spark cuts files)
   tell it for each record.
3. The records of a dialog are put together again and parsed by themselves.

An escape never crosses a record: JSON has none that ends in ``]``. A file with
anything but a list of dialogs of objects is rejected as a whole and its first
defect reported; the other files are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.dialogs import DIALOG_FILE_SCHEMA, chapter_filter

DIALOG_SCHEMA = DIALOG_FILE_SCHEMA[len("array<"):-1]
_SPLIT = ["path", "block"]


def _source(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    return spark.read.option("lineSep", "]").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(directory)


def _records(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    rows = (_source(spark, directory, pattern)
            .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                    F.col("_metadata.file_size").alias("size"), "value"))
    # position in the split; only its order is used
    rows = rows.withColumn("pos", F.monotonically_increasing_id())
    bare = F.split(F.regexp_replace("value", r"(?s)\\.", "  "), '"')

    def opened(inside: int) -> Column:
        outside = F.filter(bare, lambda s, i: i % 2 == inside)
        return F.aggregate(outside, F.lit(0), lambda n, s: n + F.length(F.regexp_replace(s, r"[^\[]", "")))

    return rows.select("*", (F.size(bare) - 1).alias("quotes"), opened(0).alias("open0"), opened(1).alias("open1"))


def _depths(rows: DataFrame) -> DataFrame:
    """Records with ``structural`` (does the bracket behind it close a list) and ``depth`` behind it."""
    inside = Window.partitionBy(*_SPLIT).orderBy("pos")
    odd = F.sum("quotes").over(inside) % 2  # behind the record, of a split that begins outside
    r = rows.withColumn("odd", odd).withColumn("was", (F.col("odd") + F.col("quotes")) % 2)
    for start in (0, 1):
        opened = F.when(F.col("was") == start, F.col("open0")).otherwise(F.col("open1"))
        r = r.withColumn(f"step{start}", opened - F.when(F.col("odd") == start, 1).otherwise(0))
    r = r.select(*_SPLIT, "size", "value", "pos", "odd", "quotes", *[F.sum(f"step{s}").over(inside).alias(f"depth{s}") for s in (0, 1)])
    # one row a split: where the next one begins
    last = r.groupBy(*_SPLIT).agg(F.max_by("odd", "pos").alias("turn"), F.max_by("depth0", "pos").alias("d0"), F.max_by("depth1", "pos").alias("d1"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("start", F.coalesce(F.sum("turn").over(before), F.lit(0)) % 2)
    last = last.withColumn("d", F.when(F.col("start") == 0, F.col("d0")).otherwise(F.col("d1")))
    last = last.select(*_SPLIT, "start", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("base"))
    r = r.join(last, _SPLIT)
    return r.select(*_SPLIT, "size", "value", "pos", (F.col("odd") == F.col("start")).alias("structural"),
                    (F.col("base") + F.when(F.col("start") == 0, F.col("depth0")).otherwise(F.col("depth1"))).alias("depth"))


def _numbered(r: DataFrame) -> DataFrame:
    """Records with ``no``, the number of their dialog: how many lists of depth two were closed before."""
    inside = Window.partitionBy(*_SPLIT).orderBy("pos")
    closes = (F.col("structural") & (F.col("depth") == 1)).cast("int")
    r = r.withColumn("closes", closes).withColumn("seen", F.sum("closes").over(inside) - F.col("closes"))
    total = r.groupBy(*_SPLIT).agg(F.sum("closes").alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*_SPLIT, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("prior"))
    return r.join(total, _SPLIT).withColumn("no", F.col("prior") + F.col("seen"))


def scan_dialogs(spark: SparkSession, directory: str, chapters: list[str] | None = None, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """``(messages, rejects)``: ``(path, dialog_idx, turn, role, content)`` of
    the well-formed files, and ``(path, reason)`` of the others.

    Files are found in any depth; ``chapters`` keeps those whose path contains
    one of its strings (S2). An empty list has no dialog, an empty dialog no
    message, missing keys of a message are null, other keys are ignored."""
    rows = _records(spark, directory, pattern)
    if chapters:
        rows = chapter_filter(rows, chapters, path="path")
    r = _numbered(_depths(rows))
    parts = F.sort_array(F.collect_list(F.struct("block", "pos", "value")))  # the records of one dialog
    d = r.groupBy("path", "no").agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), "]").alias("text"), F.max("closes").alias("closed"), F.min("depth").alias("least"),
        F.max_by("depth", F.struct("block", "pos")).alias("depth"), F.max_by("structural", F.struct("block", "pos")).alias("structural"),
        F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("size").alias("size"))
    whole = Window.partitionBy("path")
    # the last record has a bracket behind it unless the bytes of all records and brackets are one more than the file's
    d = d.withColumn("extra", F.sum("bytes").over(whole) - F.col("size")).withColumn("last", F.max("no").over(whole))
    body = F.when(F.col("no") == 0, F.regexp_extract("text", r"(?s)^\s*\[\s*(\[.*)$", 1)).otherwise(F.regexp_extract("text", r"(?s)^\s*,\s*(\[.*)$", 1))
    d = d.withColumn("json", F.when(F.col("closed") == 1, F.concat(body, F.lit("]"))))
    # what follows the last dialog: the end of the outer list, blanks, and nothing else
    end = F.when(F.col("no") == 0, r"[")
    tail = F.regexp_replace("text", r"\s", "")
    ends_well = F.when(F.col("extra") == 1, tail == F.concat(F.coalesce(end, F.lit("")), F.lit("]"))).otherwise(
        (F.col("extra") == 0) & (tail == F.coalesce(end, F.lit(""))) & (F.col("depth") == 0) & F.col("structural"))
    checked = F.expr("try_parse_json(json)")
    reason = (F.when(F.col("closed") == 1, F.when(body == "", "no list of dialogs")
                     .when(checked.isNull(), "malformed JSON")
                     .when(~F.expr("schema_of_variant(try_parse_json(json))").rlike(r"^ARRAY<(OBJECT<.*>|VOID)>$"), "a dialog is not a list of messages")
                     .when(F.col("no") == F.col("last"), "the list of dialogs does not end"))
              .when(~F.coalesce(ends_well, F.lit(False)), "the list of dialogs does not end well"))
    d = d.withColumn("reason", reason)
    rejects = d.where("reason IS NOT NULL").groupBy("path").agg(F.min_by("reason", "no").alias("reason"))
    # Spark skips files without a byte; its own listing, which the driver holds anyway, still names them
    listed = _source(spark, directory, pattern).inputFiles()
    listed = spark.createDataFrame([(f,) for f in listed], "path string")
    listed = listed.select(F.regexp_replace("path", r"^(\w+):///", "$1:/").alias("path"))  # as in the files' metadata
    listed = chapter_filter(listed, chapters, path="path") if chapters else listed
    rejects = rejects.unionByName(listed.join(d.select("path").distinct(), "path", "left_anti").select("path", F.lit("empty file").alias("reason")))
    good = d.where("closed = 1").join(rejects.select("path"), "path", "left_anti")
    dialogs = good.select("path", F.col("no").cast("int").alias("dialog_idx"), F.from_json("json", DIALOG_SCHEMA).alias("dialog"))
    msgs = dialogs.select("path", "dialog_idx", F.posexplode("dialog").alias("turn", "m"))
    return msgs.select("path", "dialog_idx", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("content")), rejects
