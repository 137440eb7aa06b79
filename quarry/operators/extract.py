"""HTML page -> text blocks, headings and table-of-contents links.

A page's tree is built and read by small Python functions (:mod:`.html_tree`);
everything that needs no tree stays in built-in functions: URL joins, section
numbers and text locations.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import html_tree


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _on_pages(df: DataFrame, html: str | Column, out: str, parse) -> DataFrame:
    """``df`` with the Python function ``parse`` of ``html`` as column ``out``.

    The pages become a column of their own first, which Spark doesn't merge
    into the call: it can't plan a Python call whose argument holds lambdas
    inside lambdas ("Cannot evaluate expression")."""
    named = df.select("*", F.explode(F.array(_c(html))).alias("_page_html"))
    return named.withColumn(out, parse(F.col("_page_html"))).drop("_page_html")


def page_text(df: DataFrame, html: str = "html", tag: str = "article", out: str = "text", nesting: str = "implied") -> DataFrame:
    """The container's headings, paragraphs and list items joined by a blank
    line; ``Handbook content not found`` when the page has no container, null
    for a null page.

    ``tag`` is a selector (``div.handbook-page``), the first matching element
    is the container and all that lies in it counts, nested containers
    included. ``nesting`` is ``implied`` or ``nested``, see :mod:`.html_tree`."""
    return _on_pages(df, html, out, html_tree.text_udf(tag, nesting))


def page_text_robust(df: DataFrame, html: str = "html", tag: str = "article", out: str = "text", mode: str = "html5") -> DataFrame:
    """:func:`page_text` under its former modes: ``html5`` (implied end tags) and ``nested``."""
    return page_text(df, html, tag, out, "implied" if mode == "html5" else mode)


def _robust_text(html: str, tag: str, mode: str = "html5") -> str:
    """Text of one page, as :func:`page_text_robust`."""
    lines = html_tree.page_lines(html, tag, "implied" if mode == "html5" else mode)
    return html_tree.fixed.NOT_FOUND_TEXT if lines is None else "\n\n".join(t for _, t in lines)


def page_headings(df: DataFrame, html: str = "html", tag: str = "article", level: int = 1, nesting: str = "implied") -> DataFrame:
    """``heading``: the container's first ``<hN>`` as ``'#'*N + ' ' + text``, without one the sign and a blank."""
    @F.udf("string", useArrow=False)
    def first(page: str | None) -> str | None:
        if page is None:
            return None
        lines = html_tree.page_lines(page, tag, nesting)
        return None if lines is None else next((t for h, t in lines if h == f"h{level}"), "#" * level + " ")

    return _on_pages(df, html, "heading", first)


def urljoin_col(base: str | Column, href: str | Column) -> Column:
    """RFC 3986 resolution in built-in functions, see :func:`.html_tree.join_url`."""
    return html_tree.join_url(base, href)


@F.pandas_udf(T.StringType())
def urljoin_exact(base: pd.Series, href: pd.Series) -> pd.Series:
    """P3 by the standard library, to hold :func:`urljoin_col` against."""
    from urllib.parse import urljoin
    return pd.Series([None if b is None or h is None else urljoin(b, h) for b, h in zip(base, href)])


def toc_dataset(pages: DataFrame, url: str = "url", html: str = "html", container: str = "nav", menu: str = "ul", item: str = "li",
                sub: str = "ul", nesting: str = "implied") -> DataFrame:
    """P2 (D2): ``(page_id, dataset)``, the page's chapters as
    ``array<struct<type, name, sections: array<struct<type, name, url, text_location>>>>``.

    Chapters are the direct items of the container's outermost menus, numbered
    from 0 over all of them; the items of a chapter's first sub-list are its
    sections 1..n, those of lists inside it included; a chapter without one is
    a single section 0. Items that don't match ``item`` or hold no link are
    left out. All four are selectors. Pages without a menu have no chapter."""
    base = F.col("_base")

    def section(c: Column, no: Column, name: Column, href: Column) -> Column:
        return F.struct(F.lit("section").alias("type"), name.alias("name"), html_tree.join_url(base, href).alias("url"),
                        F.format_string("ch%02d/sec%02d.txt", c, no).alias("text_location"))

    def chapter(e: Column, c: Column) -> Column:
        listed = F.transform(e["sections"], lambda s, i: section(c, i + 1, s["name"], s["href"]))
        single = F.array(section(c, F.lit(0), e["name"], e["href"]))
        return F.struct(F.lit("chapter").alias("type"), e["name"].alias("name"), F.when(F.size(e["sections"]) > 0, listed).otherwise(single).alias("sections"))

    named = pages.select("page_id", _c(url).alias("_base"), _c(html).alias("_html"))
    read = _on_pages(named, "_html", "_entries", html_tree.menu_udf(container, menu, item, sub, nesting))
    return read.select("page_id", F.coalesce(F.transform("_entries", chapter), F.array()).alias("dataset"))


def toc_links(pages: DataFrame, url: str = "url", html: str = "html", menu_tag: str = "nav", **selectors: str) -> DataFrame:
    """A row per section of :func:`toc_dataset` (same selectors), with chapter and section numbers."""
    d = toc_dataset(pages, url, html, menu_tag, **selectors)
    # outer: Spark would otherwise filter by the sizes of the arrays first, for which it makes each array, URLs included, once more
    ch = d.select("page_id", F.posexplode_outer("dataset").alias("chapter_no", "c")).where(F.col("chapter_no").isNotNull())
    out = ch.select("page_id", "chapter_no", F.col("c.name").alias("chapter_name"), F.posexplode_outer("c.sections").alias("i", "s"))
    out = out.where(F.col("i").isNotNull())
    single = F.col("s.text_location").endswith("/sec00.txt")
    return out.select("page_id", "chapter_no", "chapter_name", F.when(single, 0).otherwise(F.col("i") + 1).alias("section_no"),
                      F.col("s.name").alias("section_name"), F.col("s.url").alias("url"), F.col("s.text_location").alias("text_location"))
