"""Mixing sources to target weights by weighted fair queueing.

A budget of ``share`` times all words is dealt to the sources by weight. No
source gets more than ``repeats`` times its words; what exceeds that is dealt
again to the others by weight, until no target is above its bound.

Each source's documents are put in a random order (a hash of the id) and queue
up ``repeats`` times over. A queued copy's virtual finish time is the number of
words its source has queued up to and with it, divided by the source's target:
sources with a larger target advance more slowly per word and so are served
more often. All copies are range-sorted by finish time and the mix is cut at
the total budget.

Only ids, sizes and finish times are sorted and shuffled, never texts, and
running sums are taken per range and carried over by a small table of range
totals (:func:`quarry.operators.ranks.rank_within`), so a source with any share
of the rows spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import rank_within
from .common import columns, need, staged, word_count


def fair_targets(sources: DataFrame, budget: float, weight: str = "weight", bound: str = "bound") -> DataFrame:
    """Add ``target``: ``budget`` dealt by ``weight``, no target above its row's
    ``bound``. Each round fixes the targets that the current level would lift
    above their bounds; a round is one aggregation of the (small, staged) table
    of sources to a single row."""
    free = F.col(weight) > 0
    level = -1.0
    while True:
        at_bound = free & (F.col(weight) * F.lit(level) > F.col(bound)) if level >= 0 else F.lit(False)
        got = sources.agg(F.sum(F.when(at_bound, F.col(bound)).otherwise(0)).alias("fixed"),
                          F.sum(F.when(free & ~at_bound, F.col(weight)).otherwise(0)).alias("open")).first()
        if not got or not got["open"]:
            return sources.withColumn("target", F.col(bound).cast("double"))
        now = (budget - float(got["fixed"])) / float(got["open"])
        if now <= level:
            break
        level = now
    dealt = F.when(F.col(weight) * F.lit(level) > F.col(bound), F.col(bound).cast("double")).otherwise(F.col(weight) * F.lit(level))
    return sources.withColumn("target", dealt)


def id_hash(c: Column) -> Column:
    """The hash that shuffles a source's documents; a null id counts as an empty one."""
    return F.md5(F.coalesce(c.cast("string"), F.lit("")))


def queue(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, repeats: int = 2,
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None,
          tie: Column | None = None):
    """``(rows, budget)``: a staged row per document with its place in its
    source's order (by the id's hash, the id and ``tie``, by default the
    size), its source's words and target, and the words queued before it; and
    the total budget. Sources by code point, null last, take the weights in
    turn."""
    sized = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
                        (size if size is not None else word_count(f"`{text_col}`")).alias("size"),
                        *([] if tie is None else [tie.alias("tie")]))
    if tie is None:
        sized = sized.withColumn("tie", F.col("size"))
    sized = staged(sized.withColumn("h", id_hash(F.col("doc_id"))), "mix-size")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # a source's number: rank by code point, null last (one row per source)
    sources = rank_within(sources, [F.col("source").isNull(), F.col("source").cast("binary")], rank_col="no")
    w = F.array(*[F.lit(int(x)) for x in weights])
    sources = staged(sources.withColumn("weight", F.get(w, ((F.col("no") - 1) % len(weights)).cast("int")))
                     .withColumn("bound", F.col("source_size") * repeats), "mix-source")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget = share * total
    sources = fair_targets(sources, budget).select(F.col("source").alias("_s"), "no", "target")
    rows = sized.join(sources, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rank_within(rows, ["h", "doc_id", "tie"], group=["no"], weight="size", rank_col="place",
                       prefix_col="before", total_col="source_size")
    return staged(rows.select("doc_id", "source", "size", "tie", "source_size", "target", "no", "place", "before"), "mix-queue"), budget


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, repeats: int = 2,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None) -> DataFrame:
    """The mix: one row per document and copy that it takes, ``(doc_id,
    source, size, no, place, copy, finish, rank, start)``; ``rank`` is the
    place in the mix and ``start`` the words before it.

    The mix ends before the first copy that would pass the budget. Documents
    without a word take no room and are in the mix (once) if their finish time
    comes before the cut. Null texts count 0 words, a null source is a source
    of its own, null ids are ordered like an empty id, and repeated rows queue
    one after another. An empty table gives an empty mix.
    """
    rows, budget = queue(docs, weights, share, repeats, id_col, text_col, source_col, size)
    return _serve(rows, budget, repeats)


def _serve(rows: DataFrame, budget: float, repeats: int) -> DataFrame:
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("size") > 0, repeats).otherwise(1))))
    queued = F.col("before") + F.col("size") + (F.col("copy") - 1) * F.col("source_size")
    copies = copies.select("doc_id", "source", "size", "no", "place", "copy",
                           F.when(F.col("target") > 0, queued / F.col("target")).otherwise(0.0).alias("finish"))
    served = rank_within(copies, ["finish", "no", "place", "copy"], weight="size", rank_col="rank", prefix_col="start")
    return served.where(F.col("start") + F.col("size") <= F.lit(float(budget)))


def taken(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, repeats: int = 2,
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None) -> DataFrame:
    """Per row of ``docs``: ``(doc_id, size, source_size, target, taken)``,
    ``taken`` being the words the mix takes from it, repeats counted."""
    rows, budget = queue(docs, weights, share, repeats, id_col, text_col, source_col, size)
    used = _serve(rows, budget, repeats).groupBy("no", "place").agg(F.count(F.lit(1)).alias("copies"))
    out = rows.join(staged(used, "mix-used"), ["no", "place"], "left")
    return out.select("doc_id", "size", "source_size", "target", (F.coalesce("copies", F.lit(0)) * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, repeats: int = 2,
                    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them, with all their columns: a document
    appears as often as the mix takes it and not at all if it takes none of it.
    Rows that agree in id (or its absence), source and bytes of text count as
    one document of the words of them all; texts without a word count as
    texts of no bytes and are taken once at most.

    The mix ends at one finish time, so it takes the first documents of each
    source's order: up to one place for the first copies, to another for the
    second. Those places are a row per source, and a document's copies follow
    from its own id, source and bytes while it is read. Texts are shuffled only
    if the sources are too many for Spark to broadcast their rows.
    """
    t = F.col(f"`{text_col}`")
    tie = F.when(t.rlike(r"[^\x20\x09-\x0D]"), F.octet_length(t)).otherwise(0)
    sized = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
                        tie.alias("tie"), word_count(t).alias("size"))
    sized = sized.groupBy("doc_id", "source", "tie").agg(F.sum("size").alias("size"))
    rows, budget = queue(sized, weights, share, repeats, size=F.col("size"), tie=F.col("tie"))
    last = staged(_serve(rows, budget, repeats).groupBy("no", "copy").agg(F.max("place").alias("place")), "mix-last")

    def key(doc_id: Column, tie: Column) -> Column:
        return F.struct(id_hash(doc_id).alias("h"), doc_id.alias("id"), tie.alias("tie"))

    ends = rows.join(last, ["no", "place"]).withColumn("key", key(F.col("doc_id"), F.col("tie")))
    ends = ends.groupBy(F.col("source").alias("of")).agg(
        *[F.max(F.when(F.col("copy") == c, F.col("key"))).alias(f"end{c}") for c in range(1, repeats + 1)])
    ends = staged(ends, "mix-ends")
    names = [f"c{i}" for i in range(len(docs.columns))]
    where = dict(zip(docs.columns, names, strict=True))
    out = docs.select(*[c.alias(n) for c, n in zip(columns(docs), names, strict=True)], key(F.col(f"`{id_col}`"), tie).alias("key"))
    out = out.join(ends, F.col(where[source_col]).eqNullSafe(F.col("of")))
    taken = [(F.col("key") <= F.col(f"end{c}")) & (F.lit(c == 1) | (F.col("key.tie") > 0)) for c in range(1, repeats + 1)]
    copies = F.filter(F.array(*[F.when(x, c) for c, x in enumerate(taken, 1)]), lambda c: c.isNotNull())
    return out.withColumn("copy", F.explode(copies)).select(*names).toDF(*docs.columns)


#: DuckDB SQL for :func:`taken` with its default parameters, over a relation ``documents``.
TAKEN_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, encode(source)) AS no
  FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (no - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2 * source_size AS bound FROM src),
tot AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS budget FROM weighed),
steps AS (
  SELECT *, (budget - coalesce(sum(bound) OVER f, 0)::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0))::DOUBLE AS level
  FROM weighed, tot
  WINDOW f AS (ORDER BY bound / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT max(level) AS level FROM steps WHERE w * level <= bound),
targets AS (
  SELECT source, source_size, no,
         CASE WHEN lvl.level IS NULL OR w * lvl.level > bound THEN bound::DOUBLE ELSE w * lvl.level END AS target
  FROM weighed, lvl),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.no,
         row_number() OVER o AS place, sum(s.size) OVER (o ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
  WINDOW o AS (PARTITION BY t.no ORDER BY s.h, s.doc_id, s.size)),
copies AS (
  SELECT *, CASE WHEN target > 0 THEN (upto + (copy - 1) * source_size)::DOUBLE / target ELSE 0 END AS finish
  FROM (SELECT *, unnest(CASE WHEN size > 0 THEN [1, 2] ELSE [1] END) AS copy FROM placed)),
served AS (SELECT *, sum(size) OVER (ORDER BY finish, no, place, copy ROWS UNBOUNDED PRECEDING) AS used FROM copies),
used AS (SELECT no, place, count(*) AS copies FROM served, tot WHERE used <= budget GROUP BY no, place)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (coalesce(copies, 0) * size)::BIGINT AS taken
FROM placed LEFT JOIN used USING (no, place)
"""
