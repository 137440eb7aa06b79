"""Page trees, containers by class, menus and URL joins."""

import json
import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from quarry.operators import extract, html_tree
from quarry.plans import inputs
from quarry.sinks import writers


def text(html, container="article", nesting="implied"):
    lines = html_tree.page_lines(html, container, nesting)
    return None if lines is None else [t for _, t in lines]


def test_nested_container_keeps_what_follows():
    html = "<div class='page'><p>one</p><div class=page><p>two</p></div><p>three</p></div><p>out</p>"
    assert text(html, "div.page") == ["one", "two", "three"]


@pytest.mark.parametrize(("selector", "found"), [("div.a", True), ("div.b.a", True), (".a.b.c", True), ("div.ab", False), ("p.a", False), ("div.a.x", False), ("div", True)])
def test_selectors_match_class_tokens(selector, found):
    assert (text("<div CLASS='c  a\tb'><p>x</p></div>", selector) == ["x"]) is found


def test_references_longest_match():
    html = "<article><p>a&rsquo;b &#8212; &#x26;amp; &notit; &copy 1 &amp;lt; &unknown; &#128512;</p></article>"
    assert text(html) == ["a’b — &amp; ¬it; © 1 &lt; &unknown; \U0001F600"]


def test_implied_end_tags():
    html = ("<article><p>a<p>b<ul><li>x<li>y<ul><li>z</ul><li>w</ul><h2>h</h2>c<p><b>d<p>e</b></article>")
    assert text(html) == ["a", "b", "• x", "• yz", "• z", "• w", "• z", "## h", "d", "e"]
    # an inline end tag doesn't close the block inside it; a stray end tag does nothing
    assert text("<article><b><p>a</b>b</p></i></article>") == ["ab"]
    assert text("<article><table><tr><td><p>a<td><p>b<tr><td><p>c</table><p>d</article>") == ["a", "b", "c", "d"]


def test_nested_as_written():
    html = "<article><h1>T</h1><p><b>Lead<br><p>Body.</p><ul><li>x<ul><li>y</li></ul></li></ul></article>"
    assert text(html, nesting="nested") == ["# T", "LeadBody.xy", "Body.", "• xy", "• y", "• y"]
    with pytest.raises(ValueError):
        html_tree.parse("", "other")


def test_scripts_comments_and_deep_pages():
    html = "<script>'<article><p>no</p>'</script><!-- <article> --><article><style>p{}</style><p>yes<script>no</script></p></article>"
    assert text(html) == ["yes"]
    deep = "<article>" + "<div>" * 20000 + "<p>x" + "</article>"
    assert text(deep) == ["x"]


def test_page_text_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<article>"), (4, "<article></article>"), (5, "<p>a"), (6, "<article><p>" + "w " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = {r.page_id: r.text for r in extract.page_text(df).collect()}
    missing = "Handbook content not found"
    assert [got[i] for i in range(1, 6)] == [None, missing, "", "", missing] and len(got[6]) == 399_999
    assert {r.page_id: r.heading for r in extract.page_headings(df).collect()}[4] == "# "


def test_menu_dataset_and_sink(spark, tmp_path):
    html = ("<ul class=toc-menu><li class=menu-item><a href=no>no</a></ul><div class='handbook-container'>"
            "<ul class='toc-menu'><li class='menu-item'><a href='../intro/'>Intro &amp; more</a></li><li>no link</li>"
            "<li class='menu-item x'><a href=#>One</a><ul class=sub-menu><li class=menu-item><a href='s1'> S1 </a><ul><li class=menu-item><a href=s2>S2</a></ul>"
            "<li class=other><a href=z>z</a><li class=menu-item><a name=y>no href</a></ul></li></ul>"
            "<ul class='toc-menu'><li class='menu-item'><a href='//x.org/y'>Two</a></ul></div>")
    pages = spark.createDataFrame([(1, "https://h.org/a/b/c", html), (2, "https://h.org/", "<p>"), (3, "https://h.org/", None)], "page_id long, url string, html string")
    picked = dict(menu="ul.toc-menu", item="li.menu-item", sub="ul.sub-menu")
    d = extract.toc_dataset(pages, container="div.handbook-container", **picked)
    got = {r.page_id: [(c.type, c.name, [tuple(s) for s in c.sections]) for c in r.dataset] for r in d.collect()}
    assert got[2] == got[3] == []
    assert got[1] == [
        ("chapter", "Intro & more", [("section", "Intro & more", "https://h.org/a/intro/", "ch00/sec00.txt")]),
        ("chapter", "One", [("section", "S1", "https://h.org/a/b/s1", "ch01/sec01.txt"), ("section", "S2", "https://h.org/a/b/s2", "ch01/sec02.txt")]),
        ("chapter", "Two", [("section", "Two", "https://x.org/y", "ch02/sec00.txt")])]
    flat = extract.toc_links(pages, menu_tag="div.handbook-container", **picked).collect()
    assert [(r.chapter_no, r.section_no, r.section_name) for r in flat] == [(0, 0, "Intro & more"), (1, 1, "S1"), (1, 2, "S2"), (2, 0, "Two")]
    writers.write_dataset(d.where("page_id = 1"), str(tmp_path / "d"))
    line, = [x for f in (tmp_path / "d").glob("*.json") for x in f.read_text().splitlines()]
    assert list(json.loads(line)) == ["dataset"] and json.loads(line)["dataset"][1]["sections"][1]["name"] == "S2"


RFC = ("g:h g ./g g/ /g //g ?y g?y #s g#s g?y#s ;x g;x g;x?y#s . ./ .. ../ ../g ../.. ../../ ../../g ../../../g ../../../../g /./g /../g g. .g g.. ..g "
       "./../g ./g/. g/./h g/../h g;x=1/./y g;x=1/../y g?y/./x g?y/../x g#s/./x g#s/../x http:g").split()


def test_url_joins_equal_the_standard_library(spark):
    r = random.Random(1)
    cases = [("http://a/b/c/d;p?q", h) for h in [*RFC, "", " g", "g\n"]]
    bases = ["http://h.org", "http://h.org/", "https://h.org/a", "http://h.org/a/b/?q=1#f", "http://h.org/a//b/c", "HTTP://H.org/x/./y/../z", "http://h.org?x=1"]
    for _ in range(300):
        h = "/".join(r.choice(["a", "..", ".", "", "b;c", "d.e", "%2e", "é"]) for _ in range(r.randint(1, 6)))
        h = r.choice(["", "", "/", "//k.org/", "https://q.org/", "http:", "mailto:", " "]) + h + r.choice(["", "", "?", "?u=v", "#", "#w", "?x#y"])
        cases.append((r.choice(bases), h))
    rows = spark.createDataFrame(cases, "b string, h string").select("b", "h", extract.urljoin_col("b", "h").alias("u")).collect()
    assert [x for x in rows if x.u != urljoin(x.b, x.h)] == []
    nulls = spark.createDataFrame([("http://a/", None), (None, "x")], "b string, h string")
    assert [x[0] for x in nulls.select(extract.urljoin_col("b", "h")).collect()] == [None, None]


def nested_pages(spark):
    """Pages whose html is written by lambdas inside lambdas."""
    item = lambda c: lambda s: F.concat(F.lit("<li><a href=x>"), c.cast("string"), s.cast("string"), F.lit("</a>"))
    items = lambda c: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1)), item(c)), "")
    html = F.concat(F.lit("<nav><ul>"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("id")), items), ""), F.lit("</ul></nav>"))
    return spark.range(3).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), html.alias("html"))


def calls(df):
    """Plan nodes that run Python, and lines of other nodes that still hold the call."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return sum("EvalPython" in x for x in plan), [x for x in plan if "EvalPython" not in x and re.search(r"(entries|page_text|first)\(_", x)]


@pytest.mark.parametrize("read", [lambda p: extract.toc_links(p), lambda p: extract.page_text(p, tag="nav"), lambda p: extract.page_headings(p, tag="nav")])
def test_pages_of_nested_lambdas_are_parsed_once(spark, read):
    for _ in range(4):  # the first plan of a session could be right
        df = read(nested_pages(spark))
        assert calls(df) == (1, [])
    assert df.count() == (12 if "section_no" in df.columns else 3)


def test_menu_texts(spark):
    got = sorted((r.page_id, r.chapter_no, r.section_name) for r in extract.toc_links(nested_pages(spark)).collect())
    assert got == [(p, 2 * c + s, f"{c}{s}") for p in range(3) for c in range(p + 1) for s in range(2)]


def test_long_pages_come_in_small_batches(spark):
    """A worker gets few pages at a time, not an Arrow batch of up to 10,000."""
    df = extract.page_text(spark.createDataFrame([(1, "<article><p>x")], "page_id long, html string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "Arrow" not in plan


def test_menus_are_made_once(spark):
    """No filter on the sizes of the menus makes them, and their URLs, a second time."""
    plan = extract.toc_links(nested_pages(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1
    assert plan.count("StartsWith(") == extract.toc_dataset(nested_pages(spark))._jdf.queryExecution().executedPlan().toString().count("StartsWith(") > 0


def test_menu_pages_are_dealt_out(spark, tmp_path):
    """Pages of one small file go to more than one task."""
    spark.range(500).selectExpr("id AS doc_id", "'s' AS source", "'' AS text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    pages = inputs.menu_pages(spark, str(tmp_path))
    assert pages.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert pages.count() == 500


def test_trees_equal_the_tokenizers():
    """Plain tags are read by one match each: the tree is the one that the standard library's tokenizer gives."""
    class Plainly(html_tree._Builder):
        feed, parse_starttag, parse_endtag = HTMLParser.feed, HTMLParser.parse_starttag, HTMLParser.parse_endtag

    def tree(builder, text):
        b = builder(True)
        b.feed(text)
        b.close()
        show = lambda e: e if isinstance(e, str) else (e.tag, e.attrs, [show(c) for c in e.children])
        return show(b.root)

    bits = ["<div", "<P", "<li", "<a", "</div>", "</p >", "</LI\n>", "</a x>", "</ a>", " class=x", " class='a b'", ' href="q?x=1&amp;y"', ' href="a>b"',
            " href=a/b", " HREF=#z", " a=1 a=2", " b", " c = 'd'", "/>", ">", ">", "text", " & ", "&amp;", "&lt", "<", "<!-- c -->", "<!DOCTYPE html>",
            "<?pi>", "<script>", "</script>", "<title>", "</title>", "\x00", "é", "\x0b", "\n", "<br/>", "<ul>", "</ul>", '"', "'", "<ſ", " class=''"]
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert tree(html_tree._Builder, text) == tree(Plainly, text), text
