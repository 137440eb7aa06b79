"""Language identification by rank-order profiles of letter n-grams.

A text is lowered and cut into words: runs of letters and combining marks. Each
word is framed by a word border, and its n-grams of one to three signs are
counted (a border alone is none). A text's or a language's *profile* lists its
``size`` most frequent n-grams; equal counts are ordered by length, then by
code point, borders first.

The *out-of-place* distance of a text to a language adds, over the text's
profile, by how many ranks an n-gram stands apart in the two profiles, and
``size`` for one that the language's profile lacks. The nearest language wins
(ties to the smaller name). The score is one minus the distance over its
largest possible value.

Profiles are counted over every labelled text, whole: counts are added up
inside the tasks first, so a language that holds most rows sends as many rows
as any other. An n-gram is one long, three code points of 21 bits each, so
different n-grams never meet.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of_bytes, need, small_batches

#: N-grams in a profile.
SIZE = 300
#: Languages at most; ISO 639-3 names fewer. Bounds what is sent to the tasks: LANGUAGES * SIZE ranks.
LANGUAGES = 8192
#: Signs counted at a time; a longer text is counted in pieces.
SIGNS_AT_ONCE = 1 << 20
#: Different (language, n-gram) counts held in a task before they are handed on.
HELD = 1 << 21
#: Name of the outcome for texts without a letter.
UNDETERMINED = "und"
_BORDER = 1
_BITS = 21


@functools.cache
def _signs() -> np.ndarray:
    """For every code point: 2 a letter, 1 a combining mark, 0 neither."""
    kind = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        s = chr(c)
        if s.isalpha():
            kind[c] = 2
        elif unicodedata.category(s)[0] == "M":
            kind[c] = 1
    return kind


@dataclass
class Counts:
    """Runs of equal n-grams: owner (a row number), packed n-gram and count, by owner and n-gram."""

    owner: np.ndarray
    gram: np.ndarray
    n: np.ndarray
    letters: np.ndarray  # per owner: does it have a letter


def count_grams(texts: list[str], owners: np.ndarray, n_owners: int) -> Counts:
    """N-gram counts of ``texts``, added up per owner."""
    present, owners = np.unique(owners, return_inverse=True)
    low = [t.lower() for t in texts]
    code = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    whose = np.repeat(owners, [len(t) + 1 for t in low])
    kind = _signs()[code]
    letters = np.zeros(n_owners, bool)
    letters[present[whose[kind == 2]]] = True
    # one border before each word and one behind it; the first sign of all is a border too
    inside = kind > 0
    keep = inside | np.r_[False, inside[:-1]]
    sign, whose = np.where(inside, code, _BORDER)[keep].astype(np.int64), whose[keep]
    if not len(sign):
        none = np.zeros(0, np.int64)
        return Counts(none, none, none, letters)
    alphabet = np.flatnonzero(np.bincount(sign))
    if alphabet[0] != _BORDER:
        alphabet = np.r_[_BORDER, alphabet]
    number = np.zeros(alphabet[-1] + 1, np.int64)
    number[alphabet] = np.arange(1, len(alphabet) + 1)  # the border is 1, no sign 0; the order is that of code points
    sign = np.r_[1, number[sign]]
    whose = np.r_[whose[0], whose]
    base = len(alphabet) + 1
    # of an n-gram's signs none but the first and the last is a border, and a single sign is none
    one = sign != 1
    two = one[:-1] | one[1:]
    three = one[1:-1]
    first, last = whose[1:], whose[1:-1]  # owner of the sign behind a border; a word and its borders have one owner
    key = np.concatenate([whose[one] * base**3 + sign[one],
                          np.where(one[:-1], whose[:-1], first)[two] * base**3 + (sign[:-1] * base + sign[1:])[two],
                          last[three] * base**3 + ((sign[:-2] * base + sign[1:-1]) * base + sign[2:])[three]])
    key.sort()
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n = np.diff(np.r_[at, len(key)])
    owner, gram = np.divmod(key[at], base**3)
    a, rest = np.divmod(gram, base * base)
    b, c = np.divmod(rest, base)
    signs = np.r_[0, alphabet]
    return Counts(present[owner], (signs[a] << 2 * _BITS) | (signs[b] << _BITS) | signs[c], n, letters)


def merged(owner: np.ndarray, gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts with equal owner and n-gram added up, by owner and n-gram."""
    order = np.lexsort((gram, owner))
    owner, gram, n = owner[order], gram[order], n[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])][:len(owner)]
    at = np.flatnonzero(new)
    return owner[at], gram[at], np.add.reduceat(n, at) if len(at) else n


def _pieces(text: str) -> Iterator[str]:
    """A long text in pieces that end between two words (or inside a word longer than a piece)."""
    at = 0
    while len(text) - at > SIGNS_AT_ONCE:
        to = text.rfind(" ", at + SIGNS_AT_ONCE // 2, at + SIGNS_AT_ONCE)
        to = at + SIGNS_AT_ONCE if to < 0 else to
        yield text[at:to]
        at = to
    yield text[at:]


def counts_of(texts: list[str], owners: np.ndarray, n_owners: int) -> Counts:
    """As :func:`count_grams`, texts longer than ``SIGNS_AT_ONCE`` in pieces."""
    if sum(map(len, texts)) <= SIGNS_AT_ONCE:
        return count_grams(texts, owners, n_owners)
    parts, group, whose, held = [], [], [], 0
    for t, o in zip(texts, owners.tolist(), strict=True):
        for piece in _pieces(t):
            if held + len(piece) > SIGNS_AT_ONCE and group:
                parts.append(count_grams(group, np.array(whose), n_owners))
                group, whose, held = [], [], 0
            group.append(piece)
            whose.append(o)
            held += len(piece)
    parts.append(count_grams(group, np.array(whose), n_owners))
    owner, gram, n = (np.concatenate([getattr(p, f) for p in parts]) for f in ("owner", "gram", "n"))
    return Counts(*merged(owner, gram, n), np.logical_or.reduce([p.letters for p in parts]))


def learned(id_col: str | Column) -> Column:
    """False for held-out rows: crc32 of the id as text, modulo 4, is 2. A null id isn't held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SIZE) -> DataFrame:
    """``(lang, gram, rank)``: the ``size`` most frequent n-grams of each
    language, rank from 0. Rows with a null text or language are left out; a
    language none of whose texts has a letter has no profile."""
    small_batches(docs.sparkSession)
    rows = need(docs, [text_col, lang_col]).toDF("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.select("text", F.col("lang").cast("string").alias("lang"))

    def out(names: list[str], held: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        owner, gram, n = held
        return pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(pa.array(owner, pa.int32()), pa.array(names, pa.string())).cast(pa.string()),
                                           pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        held, fresh, rows_held = None, [], 0
        for whole in batches:
            for b in batches_of_bytes(whole, "text", 1 << 20):
                owners = np.array([number.setdefault(x, len(number)) for x in b.column("lang").to_pylist()])
                c = counts_of(b.column("text").to_pylist(), owners, len(number))
                fresh.append((c.owner, c.gram, c.n))
                rows_held += len(c.n)
                if rows_held > HELD:
                    held = merged(*map(np.concatenate, zip(*([held] if held else []), *fresh, strict=True)))
                    fresh, rows_held = [], 0
                    if len(held[0]) > HELD:
                        yield out(list(number), held)
                        held = None
        parts = ([held] if held else []) + fresh
        if parts:
            held = merged(*map(np.concatenate, zip(*parts, strict=True)))
            for at in range(0, len(held[0]), 1 << 16):
                yield out(list(number), tuple(x[at:at + (1 << 16)] for x in held))

    counts = rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the limit on the rank is applied in each task before rows of a language meet
    by_count = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    return counts.withColumn("rank", F.row_number().over(by_count) - 1).where(F.col("rank") < size).select("lang", "gram", "rank")


@dataclass
class Model:
    """Profiles by n-gram: entries ``start[i]:start[i + 1]`` of ``lang`` and ``rank`` belong to ``gram[i]``."""

    names: list[str]
    gram: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    rank: np.ndarray
    size: int

    def distances(self, owner: np.ndarray, gram: np.ndarray, rank: np.ndarray, n_owners: int) -> np.ndarray:
        """Out-of-place distance of each owner's profile to each language's, ``(n_owners, languages)``."""
        langs = len(self.names)
        far = np.bincount(owner, minlength=n_owners).astype(np.int64) * self.size
        at = np.searchsorted(self.gram, gram)
        hit = np.flatnonzero(self.gram[np.minimum(at, len(self.gram) - 1)] == gram) if len(self.gram) else np.zeros(0, np.int64)
        times = (self.start[1:] - self.start[:-1])[at[hit]]
        # entry numbers of every hit: its first one and those behind it
        entry = np.repeat(self.start[at[hit]] - np.r_[0, np.cumsum(times)[:-1]][:len(hit)], times) + np.arange(times.sum())
        saved = self.size - np.abs(np.repeat(rank[hit], times) - self.rank[entry])
        cell = np.repeat(owner[hit], times) * langs + self.lang[entry]
        near = np.bincount(cell, weights=saved, minlength=n_owners * langs).reshape(n_owners, langs).astype(np.int64)
        return far[:, None] - near

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest language (-1 for none) and score of each text."""
        c = counts_of(texts, np.arange(len(texts)), len(texts))
        owner, gram, rank = ranked(c, self.size)
        if not self.names:
            return np.full(len(texts), -1), np.zeros(len(texts))
        d = self.distances(owner, gram, rank, len(texts))
        best = d.argmin(axis=1)
        most = np.bincount(owner, minlength=len(texts)) * self.size
        score = 1 - d[np.arange(len(texts)), best] / np.maximum(most, 1)
        return np.where(c.letters, best, -1), np.where(c.letters, np.round(score, 9), 0.0)


def ranked(c: Counts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``size`` most frequent n-grams of each owner: ``(owner, gram, rank)``."""
    order = np.lexsort((-c.n, c.owner))  # stable: n-grams are ascending already
    owner = c.owner[order]
    begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]][:len(owner)])
    rank = np.arange(len(owner)) - np.repeat(begin, np.diff(np.r_[begin, len(owner)]))
    few = rank < size
    return owner[few], c.gram[order][few], rank[few]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SIZE) -> Model:
    """Model of the languages in ``docs``. Only the profiles reach the driver,
    ``size`` rows a language; more than ``LANGUAGES`` languages raise
    ``ValueError``, since such a column names no languages."""
    got = profiles(docs, text_col, lang_col, size)
    rows = got.limit(LANGUAGES * size + 1).toPandas()
    names = sorted(rows["lang"].unique())
    if len(rows) > LANGUAGES * size:
        raise ValueError(f"{lang_col} has more than {LANGUAGES} values")
    number = {x: i for i, x in enumerate(names)}
    lang = rows["lang"].map(number).to_numpy(dtype=np.int64)
    gram, rank = rows["gram"].to_numpy(dtype=np.int64), rows["rank"].to_numpy(dtype=np.int64)
    order = np.lexsort((lang, gram))
    grams, first = np.unique(gram[order], return_index=True)
    return Model(names, grams, np.r_[first, len(order)], lang[order], rank[order], size)


def identify(docs: DataFrame, model: Model, text_col: str = "text", columns: list[str] | None = None,
             lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``columns`` (all of them by default, but those named like the results),
    ``lang_col`` and ``score_col``.

    Null texts and texts without a letter give ``und`` and score 0, as does any
    text if nothing was learned. Texts of any length are counted whole.
    Repeated rows stay, an empty table gives an empty result, and extra columns
    of any name come through unchanged."""
    cols = [c for c in (columns if columns is not None else docs.columns) if c not in (lang_col, score_col)]
    small_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(cols))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(cols, names, strict=True)], F.col(f"`{text_col}`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        values = pa.array([*m.names, UNDETERMINED], pa.string())
        for whole in batches:
            for b in batches_of_bytes(whole, "text", 1 << 20):
                which, score = m.predict([t or "" for t in b.column("text").to_pylist()])
                which = np.where(which < 0, len(m.names), which)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(cols))), values.take(pa.array(which)), pa.array(score)],
                                                 names=[*names, "lang", "score"])

    kinds = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in names)
    return rows.mapInArrow(run, f"{kinds}lang string, score double").toDF(*cols, lang_col, score_col)


#: DuckDB SQL for the query: profiles of the rows learned from, then each text's nearest one.
IDENTIFIED_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, lower(text) AS text, regexp_matches(coalesce(text, ''), '\\p{L}') AS letters,
         coalesce(xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 4 = 2, false) AS held_out
  FROM documents),
w AS (
  SELECT r, chr(1) || w || chr(1) AS w, count(*) AS n
  FROM (SELECT r, unnest(regexp_extract_all(text, '[\\p{L}\\p{M}]+')) AS w FROM d) GROUP BY r, w),
g AS (
  SELECT r, gram, sum(n) AS n FROM (
    SELECT r, n, unnest(list_transform(range(1, length(w) - k + 2), lambda i: substr(w, i, k))) AS gram
    FROM w, (VALUES (1), (2), (3)) AS s(k)) WHERE gram <> chr(1) GROUP BY r, gram),
t AS (SELECT r, gram, rank FROM (
  SELECT r, gram, row_number() OVER (PARTITION BY r ORDER BY n DESC, length(gram), gram) - 1 AS rank FROM g) WHERE rank < 300),
p AS (SELECT lang, gram, rank FROM (
  SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(gram), gram) - 1 AS rank
  FROM g JOIN d USING (r) WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang, gram) WHERE rank < 300),
size AS (SELECT r, count(*) * 300 AS most FROM t GROUP BY r),
near AS (
  SELECT r, l.lang, most - coalesce(saved, 0) AS distance, most
  FROM size CROSS JOIN (SELECT DISTINCT lang FROM p) AS l
  LEFT JOIN (SELECT r, p.lang, sum(300 - abs(t.rank - p.rank)) AS saved FROM t JOIN p USING (gram) GROUP BY r, p.lang) AS s USING (r, lang)),
best AS (SELECT r, arg_min(lang, (distance, lang)) AS lang, min(distance) AS distance, any_value(most) AS most FROM near GROUP BY r)
SELECT doc_id, held_out, CASE WHEN letters AND b.lang IS NOT NULL THEN b.lang ELSE 'und' END AS lang_pred,
       CASE WHEN letters AND b.lang IS NOT NULL THEN round(1 - distance / most, 9) ELSE 0.0 END AS score
FROM d LEFT JOIN best AS b USING (r)
"""
