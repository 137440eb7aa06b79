"""A page as a tree of elements: containers by class, text and menus.

Pages are parsed one by one by plain Python functions, whose small batches of
rows bound a worker's memory however long pages are; the standard library's
tokenizer supplies tags, attributes in any quoting and decoded character
references (longest match, with or without a semicolon, named and numeric).
This module builds the tree over those events in one of two ways:

``implied``
    A start tag closes the elements that HTML lets authors leave open: a block
    closes an open paragraph, an item the item before it, a cell the cell
    before it. The end tag of an inline element doesn't close blocks.
``nested``
    Tags nest exactly as written, so an unclosed ``<p>`` holds the rest of its
    container.

Selectors name a tag and classes, ``div.page.wide``: an element matches if it
has the tag and each of the classes, in any order and among others. The tag may
be left out (``.page``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LISTS = ("ul", "ol")
BLOCKS = frozenset([*HEADINGS, *LISTS, *("address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure "
                                         "footer form header hgroup hr html li main menu nav p pre search section summary table tbody td tfoot th thead tr").split()])
#: Blocks that a paragraph can hold open (they begin a scope of their own) aren't among those that close it.
CLOSES_P = BLOCKS - frozenset("body dd dt html li tbody td tfoot th thead tr".split()) | {"li", "dd", "dt"}
#: For a start tag: the open elements that it closes, and the elements beyond which it doesn't look.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead"), ("table",)),
}
#: A paragraph lies inside one of these; an open one beyond it isn't closed.
P_SCOPE = frozenset("article aside blockquote body button caption dd div dl fieldset figure footer form header html li main nav object section table td th ul ol".split())
SILENT = ("script", "style")
#: Tags written in the plain way, whose parts one match tells; the tokenizer reads all others, and those whose content isn't markup.
_START = (r"""<(?!(?:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext)[ \t\n\r\f>])([a-z][a-z0-9]*)"""
          r"""((?:[ \t\n\r\f]+[a-z][a-z-]*=(?:"[^"<>&\x00]*"|'[^'<>&\x00]*'|[a-z0-9_.-]+))*)[ \t\n\r\f]*>""")
_END = r"</([a-z][a-z0-9]*)[ \t\n\r\f]*>"
_PLAIN_START, _PLAIN_END, _PLAIN = (re.compile(x, re.ASCII | re.IGNORECASE) for x in (_START, _END, rf"([^<]*)(?:{_START}|{_END}|<!doctype[^<>]*>)"))
_OTHER_START = re.compile(r"([^<]*)(?=<[a-z])", re.ASCII | re.IGNORECASE)
_PLAIN_ATTR = re.compile(r"""([a-z][a-z-]*)=(?:"([^"]*)"|'([^']*)'|([^ \t\n\r\f]+))""", re.ASCII | re.IGNORECASE)


@lru_cache(4096)
def _plain_attrs(text: str) -> tuple[tuple[str, str], ...]:
    return tuple((name.lower(), a or b or c) for name, a, b, c in _PLAIN_ATTR.findall(text))


class Element:
    """An element: tag, attributes, and children (elements and strings) in order."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Element]:
        """Elements below this one, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Element)]
        while todo:
            e = todo.pop()
            yield e
            todo.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def text(self) -> str:
        """All strings below this element, in document order."""
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo.extend(reversed(x.children))
        return "".join(out)


class Selector:
    """``tag.class.class``; see the module's docstring."""

    def __init__(self, pattern: str):
        tag, *classes = pattern.strip().split(".")
        self.tag, self.classes = tag.lower(), frozenset(classes)

    def __call__(self, e: Element) -> bool:
        if self.tag and e.tag != self.tag:
            return False
        return not self.classes or self.classes <= set((e.attrs.get("class") or "").split())

    def first(self, root: Element) -> Element | None:
        return next((e for e in root.walk() if self(e)), None)


class _Builder(HTMLParser):
    def __init__(self, implied: bool):
        super().__init__(convert_charrefs=True)
        self.implied = implied
        self.root = Element("", {})
        self.open = [self.root]
        self.silent = 0

    def feed(self, html: str) -> None:
        """Texts and tags are read here until something else comes, an end tag that isn't plain, a comment or
        a script; the rest is the tokenizer's."""
        self.rawdata, i = html, 0
        while self.cdata_elem is None:
            if m := _PLAIN.match(html, i):
                text, tag, attrs, end = m.groups()
                if text:
                    self.handle_data(unescape(text) if "&" in text else text)
                if tag:
                    self.handle_starttag(tag.lower(), _plain_attrs(attrs) if attrs else ())
                elif end:
                    self.handle_endtag(end.lower())
                i = m.end()
            elif m := _OTHER_START.match(html, i):
                if m[1]:
                    self.handle_data(unescape(m[1]))
                i = m.end()
                after = super().parse_starttag(i)
                if after < 0:
                    break
                i = after
            else:
                break
        self.rawdata = ""
        super().feed(html[i:])

    def parse_starttag(self, i: int) -> int:
        m = _PLAIN_START.match(self.rawdata, i)
        if m is None:
            return super().parse_starttag(i)
        tag, attrs = m.groups()
        self.handle_starttag(tag.lower(), _plain_attrs(attrs) if attrs else ())
        return m.end()

    def parse_endtag(self, i: int) -> int:
        m = _PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if m is None:
            return super().parse_endtag(i)
        self.handle_endtag(m[1].lower())
        return m.end()

    def updatepos(self, i: int, j: int) -> int:
        return j  # no line numbers are asked for

    def _close(self, tags: tuple[str, ...], scope) -> None:
        """Close the innermost open element of ``tags`` with all that it holds, if no element of ``scope`` comes first."""
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in tags:
                del self.open[i:]
                return
            if tag in scope:
                return

    def handle_starttag(self, tag: str, attrs: Sequence[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            self.silent += 1
            return
        if self.implied:
            if tag in CLOSES_P:
                self._close(("p",), P_SCOPE)
            if tag in IMPLIED:
                self._close(*IMPLIED[tag])
        first = {}
        for name, value in attrs:
            first.setdefault(name, value)  # of repeated attributes the first counts
        e = Element(tag, first)
        self.open[-1].children.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag not in VOID:
            self._close((tag,), BLOCKS if self.implied and tag not in BLOCKS else ())

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.open[-1].children.append(data)


def parse(html: str, nesting: str = "implied") -> Element:
    """Root of the tree of ``html``; ``nesting`` is ``implied`` or ``nested``."""
    if nesting not in ("implied", "nested"):
        raise ValueError("nesting is 'implied' or 'nested'")
    b = _Builder(nesting == "implied")
    b.feed(html)
    b.close()
    return b.root


def blocks(box: Element) -> Iterator[tuple[str, str]]:
    """``(tag, line)`` of headings, paragraphs and list items in document order.
    An item is listed by every list that it lies in."""
    for e in box.walk():
        if e.tag in HEADINGS:
            yield e.tag, "#" * int(e.tag[1]) + " " + e.text().strip()
        elif e.tag == "p":
            yield e.tag, e.text().strip()
        elif e.tag in LISTS:
            for item in e.walk():
                if item.tag == "li":
                    yield "li", fixed.LIST_BULLET + item.text().strip()


def page_lines(html: str, container: str, nesting: str) -> list[tuple[str, str]] | None:
    box = Selector(container).first(parse(html, nesting))
    return None if box is None else list(blocks(box))


def text_udf(container: str, nesting: str):
    """Column function: a page's text, ``Handbook content not found`` without a container, null for null."""
    @F.udf("string", useArrow=False)
    def page_text(html: str | None) -> str | None:
        if html is None:
            return None
        lines = page_lines(html, container, nesting)
        return fixed.NOT_FOUND_TEXT if lines is None else "\n\n".join(t for _, t in lines)

    return page_text


def menu_entries(html: str, container: str, menu: str, item: str, sub: str, nesting: str) -> list[tuple[str, str, list[tuple[str, str]]]]:
    """``(name, href, [(section, href), ...])`` of the menu's chapters.

    Menus are the outermost matching lists of the container, chapters their
    direct children that match ``item`` and hold a link, sections all matching
    items with a link in the chapter's first matching sub-list."""
    root = parse(html, nesting)
    box = Selector(container).first(root)
    if box is None:
        return []
    is_menu, is_item, is_sub = Selector(menu), Selector(item), Selector(sub)

    def link(e: Element) -> tuple[str, str] | None:
        a = next((x for x in e.walk() if x.tag == "a" and x.attrs.get("href") is not None), None)
        return None if a is None else (a.text().strip(), a.attrs["href"])

    out, todo = [], [box]
    while todo:
        e = todo.pop()
        if not is_menu(e):
            todo.extend(c for c in reversed(e.children) if isinstance(c, Element))
            continue
        for chapter in (c for c in e.children if isinstance(c, Element) and is_item(c)):
            head = link(chapter)
            if head is None:
                continue
            below = is_sub.first(chapter)
            sections = [] if below is None else [s for x in below.walk() if is_item(x) and (s := link(x)) is not None]
            out.append((*head, sections))
    return out


MENU_TYPE = "array<struct<name:string,href:string,sections:array<struct<name:string,href:string>>>>"


def menu_udf(container: str, menu: str, item: str, sub: str, nesting: str):
    """Column function: a page's menu entries, an empty array without a menu.

    Declared as non-deterministic, so that Spark doesn't copy the call into
    filters on its result, which would parse each page again."""
    @F.udf("string", useArrow=False)
    def entries(html: str | None) -> str | None:
        if html is None:
            return None
        return json.dumps([{"name": n, "href": u, "sections": [{"name": a, "href": b} for a, b in s]}
                           for n, u, s in menu_entries(html, container, menu, item, sub, nesting)])

    once = entries.asNondeterministic()
    return lambda html: F.from_json(once(html), MENU_TYPE)


# links

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"


def resolved_path(segments: Column) -> Column:
    """Path of ``segments`` without dot segments: a fold that keeps the path so
    far as a stack, ``..`` taking its last segment away."""
    empty = F.array().cast("array<string>")
    stack = F.aggregate(segments, empty, lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                        .when(s == ".", acc).otherwise(F.array_append(acc, s)))
    # a path that ends in a dot segment names a folder
    ends = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(empty)
    return _let(F.array_join(F.concat(stack, ends), "/"), lambda p: F.when(p == "", F.lit("/")).otherwise(p))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def join_url(base: str | Column, href: str | Column) -> Column:
    """RFC 3986 resolution of ``href`` against ``base`` in built-in functions.

    As web clients do: a reference with the base's own scheme and no host is
    relative, empty segments of a relative path are dropped, an empty query,
    fragment or host is dropped, blanks and controls before a reference are
    ignored. An empty reference is the base itself, null gives null."""
    b, h = (F.col(c) if isinstance(c, str) else c for c in (base, href))

    def clean(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")

    return _let(F.struct(b.alias("raw"), clean(b).alias("b"), clean(h).alias("h")), _by_scheme)


def _by_scheme(x: Column) -> Column:
    rest = F.regexp_replace(x["h"], _SCHEME, "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"^([^?#]*)\?(#|\z)", "$1$2"), r"#\z", "")  # empty query, fragment
    rest = F.regexp_replace(rest, r"^//(?=[/?#]|\z)", "")  # empty host
    own, other = F.lower(F.regexp_extract(x["b"], _SCHEME, 1)), F.lower(F.regexp_extract(x["h"], _SCHEME, 1))
    parts = F.struct(own.alias("own"), other.alias("other"), F.regexp_replace(x["b"], _SCHEME, "").alias("base"), rest.alias("rest"))

    def choose(s: Column) -> Column:
        scheme = F.when(s["own"] == "", "").otherwise(F.concat(s["own"], F.lit(":")))
        return (F.when(x["h"] == "", x["raw"])
                .when((s["other"] != "") & (s["other"] != s["own"]), x["h"])
                .when(s["rest"].startswith("//"), F.concat(scheme, s["rest"]))
                .otherwise(_relative(scheme, s["base"], s["rest"])))

    return _let(parts, choose)


def _relative(scheme: Column, base: Column, rest: Column) -> Column:
    """``rest``, a reference without scheme and host, against ``base``, a URL without its scheme."""
    host = F.regexp_extract(base, r"^(//[^/?#]*)", 1)
    local = F.regexp_replace(base, r"^//[^/?#]*", "")
    path, query = r"(?s)^([^?#]*)", r"(?s)^[^?#]*(\?[^#]+)"
    parts = F.struct(host.alias("host"), F.regexp_extract(local, path, 1).alias("b"), F.regexp_extract(local, query, 1).alias("bq"),
                     F.regexp_extract(rest, path, 1).alias("h"), F.regexp_extract(rest, query, 1).alias("hq"),
                     F.regexp_extract(rest, r"(?s)(#.+)$", 1).alias("fragment"))

    def merge(p: Column) -> Column:
        folder = F.split(p["b"], "/")
        folder = F.when(F.element_at(folder, -1) != "", F.slice(folder, 1, F.size(folder) - 1)).otherwise(folder)
        joined = _let(F.concat(folder, F.split(p["h"], "/")), lambda j: F.filter(j, lambda s, i: (s != "") | (i == 0) | (i == F.size(j) - 1)))
        resolved = _let(F.when(p["h"].startswith("/"), F.split(p["h"], "/")).otherwise(joined), resolved_path)
        rooted = _let(resolved, lambda r: F.when((p["host"] != "") & ~r.startswith("/"), F.concat(F.lit("/"), r)).otherwise(r))
        return F.concat(scheme, p["host"], F.when(p["h"] == "", F.concat(p["b"], F.when(p["hq"] != "", p["hq"]).otherwise(p["bq"])))
                        .otherwise(F.concat(rooted, p["hq"])), p["fragment"])

    return _let(parts, merge)
