"""Line dedup with a log-template tree, in DataFrame operations only.

Lines that differ only in variable fields are one template; templates that
recur in ``min_docs`` documents or more are dropped everywhere.

A line's words are its runs of non-white-space characters; words with a digit
are variable and stand as ``<*>`` (the line's *mask*). The tree has a fixed
depth: a line goes to the node of its number of words and its first ``depth``
masked words, then up to ``levels`` times to a child by one further word. A node
is divided at the position whose frequent words (``min_docs`` documents or more)
cover most of its documents, half at least, the position with fewer such words
first; lines with another word there go to one child together. So families of
lines that begin alike part, however many meet in a node.

Inside every node of the path, the word that most documents have at a position
(at least half of them) is constant there, other positions are variable fields:
that is the node's general template. It counts if at least half of the positions
after the first ``depth`` are constant. Lines of the node that agree with it in
``similarity`` of their positions belong to it; a field agrees with any word.

A line is dropped if its mask recurs, or if it belongs to a general template
whose lines together recur. Lines without a word are never dropped.

Equal masks are merged before anything is grouped by leaf, counting is done in
two steps (per leaf, mask and document, then per leaf and mask), and only the
masks of leaves that recur are taken apart into words, so neither a line that
a third of all documents share nor a common leaf gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, staged

DEPTH = 3
LEVELS = 3
MIN_DOCS = 3
SIMILARITY = 0.8
WILD = "<*>"
_FIELD = r"[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
_SPACE = r"[\x20\x09-\x0D]+"


def mask(line: Column) -> Column:
    """The line's words, variable ones replaced, joined by single spaces."""
    fields = F.when(line.rlike("[0-9]"), F.regexp_replace(line, _FIELD, WILD)).otherwise(line)
    # most lines hold single spaces only: a replacement of every run would copy them for nothing
    single = F.when(fields.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(fields, _SPACE, " ")).otherwise(fields)
    return F.trim(single)


def masked_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, line_no, m, n, leaf words)`` of the lines that have a word."""
    lines = docs.select(F.col(f"`{id_col}`").alias("id"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n", -1)).alias("line_no", "line"))
    # the masking expressions run once: the generator keeps them from being merged into later uses
    lines = lines.select("id", "line_no", F.explode(F.array(mask(F.col("line")))).alias("m")).where("m <> ''")
    return lines


def leaf_of(m: Column, depth: int) -> Column:
    n = F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))) + 1
    return F.xxhash64(n, F.substring_index(m, " ", depth))


def recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS,
              similarity: float = SIMILARITY, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """``(occurrences, dropped masks)``: ``(id, line_no, leaf, mh)`` of every
    line, and ``(leaf, mh, n, template, docs)`` of the masks to drop, ``docs``
    being the number of documents of the mask or of the general template it
    belongs to, whichever is larger. ``mh`` is a 64-bit hash of the mask."""
    lines = masked_lines(docs, id_col, text_col)
    occ = lines.select("id", "line_no", leaf_of(F.col("m"), depth).alias("leaf"), F.xxhash64("m").alias("mh"))
    occ = staged(occ, "lines-occ")
    # a null id counts as one document
    per = occ.groupBy("leaf", "mh", "id").agg(F.lit(1).alias("one"))
    masks = staged(per.groupBy("leaf", "mh").agg(F.count(F.lit(1)).alias("docs")), "lines-masks")
    # a leaf's masks have at least as many documents together as its distinct documents: a cheap first bound
    leaves = masks.groupBy("leaf").agg(F.sum("docs").alias("s"), F.max("docs").alias("top"), F.count(F.lit(1)).alias("masks"))
    leaves = staged(leaves.where(F.col("s") >= min_docs), "lines-leaves")
    wanted = staged(masks.join(leaves.select("leaf"), "leaf"), "lines-wanted")
    # one text per wanted mask: partial aggregation merges copies before the exchange
    text = lines.select(leaf_of(F.col("m"), depth).alias("leaf"), F.xxhash64("m").alias("mh"), "m")
    text = text.join(wanted.select("leaf", "mh").hint("merge"), ["leaf", "mh"], "left_semi")
    text = text.groupBy("leaf", "mh").agg(F.min("m").alias("m"))
    text = staged(text.join(wanted, ["leaf", "mh"]).withColumn("w", F.split("m", " ")), "lines-text")

    several = leaves.where("masks > 1").select("leaf")
    node = staged(text.join(several, "leaf").select(F.col("leaf").alias("node"), "leaf", "mh", "docs", "w"), "lines-node0")
    likes = []
    for level in range(levels + 1):
        words = node.select("node", "docs", F.posexplode("w").alias("p", "word")).groupBy("node", "p", "word").agg(F.sum("docs").alias("c"), F.count(F.lit(1)).alias("masks"))
        words = staged(words, f"lines-words{level}")
        likes.append(_belonging(node, words, depth, similarity).withColumn("level", F.lit(level)))
        if level < levels:
            node = staged(_children(node, words, min_docs), f"lines-node{level + 1}")
    like = likes[0]
    for more in likes[1:]:
        like = like.unionByName(more)
    like = staged(like, "lines-like")
    spread = occ.join(like.select("node", "leaf", "mh"), ["leaf", "mh"]).groupBy("node", "id").agg(F.lit(1).alias("one"))
    spread = staged(spread.groupBy("node").agg(F.count(F.lit(1)).alias("gdocs")), "lines-spread")
    # a mask belongs to one node a level at most: the template of most documents, then the deepest
    best = like.join(spread, "node").groupBy("leaf", "mh").agg(F.max(F.struct("gdocs", "level", "general")).alias("b"))
    out = text.join(best, ["leaf", "mh"], "left")
    gdocs = F.coalesce(F.col("b.gdocs"), F.lit(0))
    out = out.select("leaf", "mh", F.size("w").alias("n"), F.when(F.col("docs") >= gdocs, F.col("m")).otherwise(F.col("b.general")).alias("template"),
                     F.greatest("docs", gdocs).alias("docs")).where(F.col("docs") >= min_docs)
    return occ, staged(out, "lines-dropped")


def _belonging(node: DataFrame, words: DataFrame, depth: int, similarity: float) -> DataFrame:
    """``(node, leaf, mh, general)`` of the masks that belong to their node's general template."""
    best = words.groupBy("node", "p").agg(F.max(F.struct("c", "word")).alias("b"), F.sum("c").alias("s"))
    best = best.select("node", F.struct("p", F.when(F.col("b.c") * 2 >= F.col("s"), F.col("b.word")).alias("word")).alias("x"))
    # a field is null here; at least half of the positions after the leading ones must be constant
    general = best.groupBy("node").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["word"]).alias("t"))
    rest = F.greatest(F.size("t") - depth, F.lit(0))
    constant = F.size(F.filter("t", lambda word, i: word.isNotNull() & (i >= depth)))
    general = general.where(constant * 2 >= rest)
    agree = F.size(F.filter(F.zip_with("w", "t", lambda a, b: b.isNull() | (a == b)), lambda same: same))
    like = node.join(general, "node").where(agree >= F.lit(similarity) * F.size("w") - F.lit(1e-9))
    return like.select("node", "leaf", "mh", F.array_join("t", " ", WILD).alias("general"))


def _children(node: DataFrame, words: DataFrame, min_docs: int) -> DataFrame:
    """The masks of the nodes that are divided, under their children; a node
    whose masks have one word, or mostly rare ones, at every position ends here.
    A child of one mask, or of too few documents, can't add anything and is left out."""
    often = F.col("c") >= min_docs
    at = words.groupBy("node", "p").agg(F.sum("c").alias("s"), F.sum(F.when(often, F.col("c")).otherwise(0)).alias("cover"), F.count_if(often).alias("kinds"),
                                        F.count(F.lit(1)).alias("all"), F.sum(F.when(often, 0).otherwise(F.col("masks"))).alias("others"))
    at = at.where((F.col("kinds") >= 1) & (F.col("all") >= 2) & (F.col("cover") * 2 >= F.col("s")))
    split = at.groupBy("node").agg(F.min(F.struct((-F.col("cover")).alias("cover"), "kinds", "p", "s", "others")).alias("x"))
    split = split.select("node", "x.p", ((F.col("x.s") + F.col("x.cover") >= min_docs) & (F.col("x.others") > 1)).alias("rest"))
    out = node.join(split, "node").withColumn("word", F.element_at("w", F.col("p") + 1))
    out = out.join(words.where(often).select("node", "p", "word", "c", "masks"), ["node", "p", "word"], "left")
    out = out.where(F.coalesce(F.col("masks") > 1, F.col("rest")))
    return out.select(F.xxhash64("node", "p", F.when(F.col("c").isNotNull(), F.col("word"))).alias("node"), "leaf", "mh", "docs", "w")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS,
                  similarity: float = SIMILARITY, levels: int = LEVELS) -> DataFrame:
    """``(id_col, line_no, n_words, template, template_docs)``, a row per line
    to drop; lines are numbered from 0. Null texts have no line. Documents of a
    null id are one document and are reported with it; repeated rows report
    their lines as often as they occur but count as one document. Very long texts
    are rows of lines like any other; an empty table gives no row; other columns
    are not read."""
    occ, masks = recurring(docs, id_col, text_col, depth, min_docs, similarity, levels)
    out = occ.join(masks, ["leaf", "mh"])
    return out.select(F.col("id").alias(id_col), "line_no", F.col("n").alias("n_words"), "template", F.col("docs").alias("template_docs"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS,
               similarity: float = SIMILARITY, levels: int = LEVELS) -> DataFrame:
    """``docs`` with the recurring lines taken out of their texts; rows and
    other columns, of any names, stay. A text of which every line goes becomes
    empty, a null text stays null."""
    occ, masks = recurring(docs, id_col, text_col, depth, min_docs, similarity, levels)
    key, gone = free_name(docs, "_id"), free_name(docs, "_gone")
    per = occ.join(masks.select("leaf", "mh"), ["leaf", "mh"]).groupBy("id").agg(F.collect_set("mh").alias(gone))
    per = staged(per.withColumnRenamed("id", key), "lines-gone")
    text = F.col(f"`{text_col}`")
    kept = F.filter(F.split(text, "\n", -1), lambda l: ~F.array_contains(gone, F.xxhash64(mask(l))))
    out = docs.join(per, F.col(f"`{id_col}`").eqNullSafe(F.col(key)), "left")
    text = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(kept, "\n"))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


#: DuckDB SQL for :func:`dropped_lines` with its default parameters, over a relation ``documents`` of unique ids.
DROPPED_SQL = r"""
WITH raw AS (
  SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
masked AS (
  SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(line, '[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS m
  FROM raw),
l AS (
  SELECT *, string_split(m, ' ') AS w, len(string_split(m, ' ')) || ' ' || array_to_string(list_slice(string_split(m, ' '), 1, 3), ' ') AS leaf
  FROM masked WHERE m <> ''),
masks AS (SELECT leaf, m, any_value(w) AS w, count(DISTINCT doc_id) AS docs FROM l GROUP BY leaf, m),
leaves AS (SELECT leaf, count(*) AS n_masks FROM masks GROUP BY leaf HAVING sum(docs) >= 3),
node0 AS (SELECT leaf AS node, leaf, m, w, docs FROM masks JOIN leaves USING (leaf) WHERE n_masks > 1),
""" + "".join(rf"""
words{k} AS (
  SELECT node, p, word, sum(docs) AS c FROM (SELECT node, docs, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM node{k}) GROUP BY ALL),
templates{k} AS (
  SELECT node, list(word ORDER BY p) AS t
  FROM (SELECT node, p, CASE WHEN c * 2 >= sum(c) OVER (PARTITION BY node, p) THEN word ELSE '' END AS word,
               row_number() OVER (PARTITION BY node, p ORDER BY c DESC, encode(word) DESC) AS nth FROM words{k}) WHERE nth = 1 GROUP BY node),
like{k} AS (
  SELECT node, leaf, m, array_to_string(list_transform(t, lambda x: CASE WHEN x = '' THEN '<*>' ELSE x END), ' ') AS general
  FROM node{k} JOIN templates{k} USING (node)
  WHERE 2 * len(list_filter(t[4:], lambda x: x <> '')) >= len(t[4:])
    AND len(list_filter(list_zip(w, t), lambda x: x[2] = '' OR x[1] = x[2])) >= 0.8 * len(w) - 1e-9),
cut{k} AS (
  SELECT node, p FROM (SELECT node, p, sum(c) AS s, coalesce(sum(c) FILTER (WHERE c >= 3), 0) AS cover, count(*) FILTER (WHERE c >= 3) AS kinds, count(*) AS n
                       FROM words{k} GROUP BY node, p)
  WHERE kinds >= 1 AND n >= 2 AND cover * 2 >= s QUALIFY row_number() OVER (PARTITION BY node ORDER BY cover DESC, kinds, p) = 1),
node{k + 1} AS (
  SELECT n.node || chr(31) || n.p || chr(31) || CASE WHEN c >= 3 THEN '+' || n.word ELSE '-' END AS node, leaf, m, w, docs
  FROM (SELECT a.*, p, w[p] AS word FROM node{k} a JOIN cut{k} USING (node)) n JOIN words{k} o ON o.node = n.node AND o.p = n.p AND o.word = n.word),
""" for k in range(LEVELS + 1)) + r"""
liked AS (""" + " UNION ALL ".join(f"SELECT *, {k} AS level FROM like{k}" for k in range(LEVELS + 1)) + r"""),
spread AS (SELECT node, count(DISTINCT doc_id) AS gdocs FROM l JOIN liked USING (leaf, m) GROUP BY node),
best AS (
  SELECT leaf, m, general, gdocs FROM liked JOIN spread USING (node)
  QUALIFY row_number() OVER (PARTITION BY leaf, m ORDER BY gdocs DESC, level DESC) = 1),
gone AS (
  SELECT k.leaf, k.m, CASE WHEN docs >= coalesce(gdocs, 0) THEN k.m ELSE general END AS template, greatest(docs, coalesce(gdocs, 0)) AS template_docs
  FROM masks k JOIN leaves USING (leaf) LEFT JOIN best b ON k.leaf = b.leaf AND k.m = b.m)
SELECT doc_id, line_no::INT AS line_no, len(w)::INT AS n_words, template, template_docs
FROM l JOIN gone USING (leaf, m) WHERE template_docs >= 3
"""
