"""Fixture roles: the pipeline's inputs derived from the driver tables.

- ``conversations`` -> dialogs; chapter = ``ch{conv_id % 27:02d}`` (ch00 has
  no agent in the trainer's map);
- ``pages`` -> handbook pages (content container ``<article>``, menu ``<nav>``);
- ``documents`` -> section texts, ``source`` acts as the chapter folder;
- ``embeddings`` -> question embeddings;
- ``events`` -> latency samples (``value``) per arm (``event_type``).

Every function reads the given tables so that the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..operators.agents import assign_agents
from ..operators.dialogs import qa_pairs, with_chapter
from ..operators.split import split_random
from ..session import read_table


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return with_chapter(read_table(spark, sf, "conversations"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return qa_pairs(turns(spark, sf))


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    return assign_agents(pairs(spark, sf))


def specialist_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Per-agent 80/20 shuffled split (seed 196) of the agent-assigned pairs."""
    a = assigned(spark, sf).where(F.col("agent").isNotNull())
    return split_random(a, group=["agent"])


def orchestrator(spark: SparkSession, sf: str, splits: DataFrame | None = None) -> DataFrame:
    """Orchestrator re-split of the union of the specialists' splits."""
    from ..operators.agents import orchestrator_split
    return orchestrator_split(splits if splits is not None else specialist_splits(spark, sf))


def chapter_path(chapter: str = "chapter", conv: str = "conv_id"):
    """Derived file path of a dialog file: ``qa_pairs/<chapter>/conv<id>_qa_pairs.json``."""
    return F.concat(F.lit("qa_pairs/"), F.col(chapter), F.lit("/conv"), F.col(conv).cast("string"),
                    F.lit("_qa_pairs.json"))


def baseline_arm(spark: SparkSession, sf: str, orch: DataFrame | None = None) -> DataFrame:
    """Test questions of the orchestrator split answered with retrieval
    over its train split and the offline default model."""
    from ..operators.infer import rag_answer
    o = orch if orch is not None else orchestrator(spark, sf)
    q = o.where(F.col("orch_split") == "test").select("pair_id", "input_text", "target_text")
    c = o.where(F.col("orch_split") == "train").select("pair_id", "input_text", "target_text")
    return rag_answer(q, c)


def architecture_arm(spark: SparkSession, sf: str, orch: DataFrame | None = None,
                     splits: DataFrame | None = None) -> DataFrame:
    """The same test questions through the retrieval router and the
    routed specialist's train split."""
    from ..operators.infer import routed_answer
    s = splits if splits is not None else specialist_splits(spark, sf)
    o = orch if orch is not None else orchestrator(spark, sf, s)
    q = o.where(F.col("orch_split") == "test").select("pair_id", "input_text", "target_text")
    train = s.where(F.col("split") == "train").select(
        "pair_id", "agent", "input_text", "target_text")
    return routed_answer(q, train)


def token_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Specialist examples with the answer template, encoded and masked
    (T1 + T2); vocabulary from all QA pairs."""
    from ..operators import tokens
    from ..operators.prompts import answer_prompt
    p = pairs(spark, sf).withColumn("prompt", answer_prompt("input_text"))
    vocab = tokens.build_vocab(p, ["prompt", "target_text"])
    s = specialist_splits(spark, sf).withColumn("prompt", answer_prompt("input_text"))
    enc = tokens.encode_parts(s, "pair_id", ["prompt", "target_text"], vocab)
    enc = enc.select("pair_id", *tokens.mask_labels("ids_0", "ids_1"), F.size("ids_0").alias("_np"))
    return s.select("pair_id", "agent", "split", "split_rank").join(enc, on="pair_id", how="inner")


def both_arms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Baseline and architecture arms over one (checkpointed) split."""
    s = specialist_splits(spark, sf)
    o = orchestrator(spark, sf, s)
    return baseline_arm(spark, sf, o), architecture_arm(spark, sf, o, s)


def handbook_pages(spark: SparkSession, sf: str, unclosed: str = "i % 4 = 3") -> DataFrame:
    """``(page_id, url, html)``: a page per document, a block per line of its
    text. Containers of one class nest, classes come in lists, references are
    named, numeric and unfinished, items and some paragraphs (``unclosed``,
    by the line's number) have no end tag."""
    d = read_table(spark, sf, "documents")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: py_strip(x) != "")

    def block(line, i):
        e = line
        for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&#62;"), ("'", "&#39;"), ("é", "&eacute;"), ("ß", "&#xDF;"), ("ñ", "&#241;")):
            e = F.replace(e, F.lit(plain), F.lit(reference))
        return (F.when(i % 4 == 0, F.concat(F.lit('<p class="c">'), e, F.lit("</p>")))
                .when(i % 4 == 1, F.concat(F.lit("<div class='handbook-page'><p>"), e, F.lit("</p></div>")))
                .when(i % 4 == 2, F.concat(F.lit("<ul><li>"), e, F.lit("<li>more &copy "), i.cast("string"), F.lit("</ul>")))
                .when(unclosed_at(i), F.concat(F.lit("<p>"), e)).otherwise(F.concat(F.lit("<p>"), e, F.lit("</p>"))))

    def unclosed_at(i):
        return i == 3 if unclosed == "i = 3" else i % 4 == 3

    source = F.coalesce("source", F.lit("none"))
    html = F.concat(F.lit('<!DOCTYPE html><html><body><script>var t="</p><div class=handbook-page>";</script><p>before</p><div class="wide handbook-page x">'
                          '<h2 class="t">'), source, F.lit("&rsquo;s page &#8212; &notit; &#x26;amp;</h2>"),
                    F.array_join(F.transform(lines, block), ""), F.lit("</div><p>outside</p></body></html>"))
    return d.select(F.col("doc_id").alias("page_id"), F.format_string("https://h.org/%s/dir/page%d", source, "doc_id").alias("url"), html.alias("html"))


def menu_pages(spark: SparkSession, sf: str) -> DataFrame:
    """``(page_id, url, html)``: a page per document with a menu of one to five
    chapters, sub-menus inside them, lists inside those, items of another
    class, and links in every quoting and of every form. Only ids and sources are
    read, so files of long texts hold the rows of many pages: they are dealt out
    before the pages are made."""
    d = read_table(spark, sf, "documents").where("doc_id IS NOT NULL").select("doc_id", "source")
    d = d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    doc = F.col("doc_id")

    def section(c):
        def of(s):
            link = (F.when(s == 1, F.concat(F.lit('<a href="../s'), doc.cast("string"), F.lit('/./p1?x=1&amp;y">S 1</a>')))
                    .when(s == 2, F.concat(F.lit("<a class='l' href='/abs/"), c.cast("string"), F.lit("/../p2'>S <b>2</b></a>"
                          '<ul class="sub-menu deep"><li class="menu-item"><a href=deep>Deep</a></li></ul>')))
                    .when(s == 3, F.lit("<a href=rel3.html> S 3 </a>")).otherwise(F.lit('<a href="//cdn.org/p4#f">S 4</a>')))
            return F.concat(F.lit('<li class="x menu-item">'), link, F.lit("</li><li class=other><a href=no>No</a></li>"))
        return of

    def chapter(c):
        n = F.when((doc + c) % 3 == 0, F.lit(0)).otherwise(((doc + c) % 4).cast("int") + 1)
        sections = F.array_join(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), section(c)), "")
        return F.concat(F.lit('<li class="menu-item top"><a href="?c='), c.cast("string"), F.lit('"> Ch &amp; '), c.cast("string"), F.lit("&rsquo;</a>"),
                        F.when(n > 0, F.concat(F.lit("<ul class='sub-menu'>"), sections, F.lit("</ul>"))).otherwise(F.lit("")), F.lit("</li>"))

    items = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), doc % 5), chapter), '<li class="divider">-</li>')
    html = F.concat(F.lit('<html><body><ul class="toc-menu"><li class="menu-item"><a href=z>outside</a></li></ul><div class="handbook-container a"><ul class="b toc-menu">'),
                    items, F.lit("</ul></div></body></html>"))
    url = F.format_string("https://h.org/%s/dir/page%d", F.coalesce("source", F.lit("none")), doc)
    return d.select(doc.alias("page_id"), url.alias("url"), html.alias("html"))


def edited_answers(spark: SparkSession, sf: str) -> DataFrame:
    """``(pair_id, question, prediction, reference, seconds)``: per QA pair an
    edited copy of the target text as prediction (equal, lines reversed, an s
    after most words, every fourth word left out, or no word at all)."""
    p = pairs(spark, sf)
    t = F.col("target_text")
    v = (F.col("conv_id") + F.col("turn")) % 5
    prediction = (F.when(v == 0, t)
                  .when(v == 1, F.array_join(F.reverse(F.split(t, "\n")), "\n"))
                  .when(v == 2, F.regexp_replace(t, "([a-z])([ .,])", "$1s$2"))
                  .when(v == 3, F.array_join(F.filter(F.split(t, " "), lambda _, i: i % 4 != 3), " "))
                  .otherwise(F.lit("...")))
    return p.select("pair_id", F.col("input_text").alias("question"), prediction.alias("prediction"),
                    t.alias("reference"), (F.col("turn") / 10 + F.char_length(t) / 1000).alias("seconds"))


def word_groups(spark: SparkSession, sf: str) -> DataFrame:
    """``(word, group)``: long words of the target texts grouped by their first five letters."""
    from ..functions.text import metric_tokens
    words = pairs(spark, sf).select(F.explode(metric_tokens("target_text")).alias("word")).where(F.char_length("word") >= 7)
    return words.distinct().select("word", F.substring("word", 1, 5).alias("group"))
