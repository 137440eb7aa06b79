"""Column-expression helpers for Python string semantics on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x: str | Column) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def py_strip(x: str | Column) -> Column:
    """``str.strip()``: removes Unicode white space at both ends.

    ``F.trim`` only removes the space character; ``(?U)`` makes ``\\s`` match
    Unicode white space in Java regex, and Python also strips the separator
    controls U+001C-U+001F.
    """
    return F.regexp_replace(_c(x), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def ws_tokens(x: str | Column) -> Column:
    """``str.split()`` on ASCII white space, empty pieces dropped."""
    return F.filter(F.split(_c(x), r"[ \t\n\r\f\x0B]+"), lambda t: t != "")


def ws_count(x: str | Column) -> Column:
    return F.size(ws_tokens(x))


def metric_tokens(x: str | Column) -> Column:
    """Tokens for metrics and lexical vectors: lower-case, split on anything
    that is not a letter or digit, drop empties."""
    return F.filter(F.split(F.lower(_c(x)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def find_suffix(text: str | Column, mark: str | Column, missing: str = "compat") -> Column:
    """``s[s.find(m) + len(m):]``.

    ``missing='compat'`` keeps Python's arithmetic when ``m`` is absent
    (``find`` gives -1, so the cut lands at ``len(m) - 1``); Spark's
    ``position`` gives 0 with 1-based positions, which is the same cut.
    ``missing='null'`` returns null instead.
    """
    t, m = _c(text), _lit(mark)
    pos = F.position(m, t)
    out = t.substr(pos + F.char_length(m), F.char_length(t) + F.lit(1))
    if missing == "null":
        out = F.when(pos > 0, out)
    return out


def after_last(text: str | Column, mark: str) -> Column:
    """``s.split(mark)[-1]``: the text after the last ``mark`` (whole string if
    absent)."""
    return F.substring_index(_c(text), mark, -1)


def rouge_ascii_tokens(x: str | Column) -> Column:
    """ROUGE's default tokenisation: lower-case, anything outside ``[a-z0-9]``
    separates tokens (accented letters included)."""
    return F.filter(F.split(F.lower(_c(x)), r"[^a-z0-9]+"), lambda t: t != "")


def bleu_13a_tokens(x: str | Column) -> Column:
    """The public "13a" BLEU tokenisation: drop ``<skipped>``, join
    hyphenated line breaks, unescape four entities, put spaces around
    punctuation (periods and commas only when not next to a digit, dashes
    after a digit), split on white space. Case is kept."""
    s = F.replace(_c(x), F.lit("<skipped>"), F.lit(""))
    s = F.replace(s, F.lit("-\n"), F.lit(""))
    s = F.replace(s, F.lit("\n"), F.lit(" "))
    for ent, ch in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = F.replace(s, F.lit(ent), F.lit(ch))
    s = F.regexp_replace(s, r"([\{-~\[-` -&\(-\+:-@/])", " $1 ")
    s = F.regexp_replace(s, r"([^0-9])([\.,])", "$1 $2 ")
    s = F.regexp_replace(s, r"([\.,])([^0-9])", " $1 $2")
    s = F.regexp_replace(s, r"([0-9])(-)", "$1 $2 ")
    return F.filter(F.split(s, r"\s+"), lambda t: t != "")
