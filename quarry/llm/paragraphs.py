"""Substring dedup: paragraph MinHash banding with exact Jaccard checks.

A passage copied into another text rarely begins or ends at a line break, so
the paragraphs compared here are cut by the words around each place alone: a
place is a cut if it comes first among the ``MIN_WORDS - 1`` places on either
side, sentence ends before others and then by a hash of the words that meet
there. Line breaks, the length of a sentence and what stands farther away play
no part, so two copies have the same cuts from ``MIN_WORDS - 1`` words inside
their ends. Paragraphs have at least ``MIN_WORDS`` words (unless the text has
fewer) and leave no word out: short sentences are joined, long ones are cut.
Chains of repeated paragraphs in a document, with gaps of ``gap`` words at
most, make up its repeated passages; passages shorter than ``min_passage``
words are left alone.

Each paragraph has a MinHash signature over its shingles of five words (case
and ASCII punctuation aside), cut into bands. With ``BANDS`` bands of ``ROWS``
values a pair of similarity ``s`` meets with probability ``1 - (1 - s**ROWS)**
BANDS``, 0.98 at 0.8 and nearly 1 at 0.9. Equal paragraphs are one class from
the start, so a passage that a third of the documents share is one member of
its buckets. In a bucket of several classes every class is paired with the
smallest one and verified by exact Jaccard similarity; classes of one bucket
that are not yet connected are then compared with each other inside the tasks,
in blocks, so no link inside a bucket is lost to the choice of the first member
and no list of all pairs is made.
Connected classes are a cluster; all but its first paragraph are removals.

Most paragraphs share nothing with any other, so the documents are read twice
and a paragraph is written only if something is known about its class:

1. The first pass shuffles nothing but band keys with 64-bit class hashes,
   packed by key range, and finds the keys that several classes share and the
   classes that several documents hold.
2. A bit table of fixed size (``BITS``) holds a bit for every such class. The
   second pass writes the paragraphs whose bit is set, with their shingles. Set
   bits of other classes only let paragraphs through that drop out later.

A document is an id with its text: two texts under one id are two documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of_bytes, components, need, small_batches, staged

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 4, 2
MIN_WORDS = 6
#: Classes of a bucket that a task compares with as many others, at most.
BLOCK = 1024
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_IS_WORD = np.array([c != 32 for c in _CLEAN])
_IS_END = np.isin(np.arange(256), list(b".!?"))
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MUL = np.random.default_rng(5).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(6).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_ORDER = np.random.default_rng(7).integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_COLS = ["id", "doc", "no", "at", "upto", "first_word", "n_words", "h", "shingles"]
#: Band keys that a task holds before it hands them on.
KEYS_HELD = 1 << 21
#: Documents of a key range, about.
DOCS_PER_RANGE = 1000
#: Bits of the table of classes; it takes 16 MB whatever the corpus' size.
BITS = 1 << 27
_WORD_BITS = 32768  # bits of one of Spark's bitmaps


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def cuts(words: list[bytes], ends: np.ndarray, min_words: int) -> np.ndarray:
    """Numbers of the words that begin a paragraph; ``ends`` tells of each word
    whether a sentence ends behind it."""
    near = max(1, min_words - 1)
    if len(words) <= 2 * near + 1:
        return np.zeros(1, np.int64)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    h = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * _MIX
    h ^= h >> np.uint64(32)
    h = (h * _MIX) >> np.uint64(1) | np.uint64(1)
    h[~ends[:-1]] |= np.uint64(1 << 63)
    # the text's own ends come before all other places
    edge = np.zeros(near, np.uint64)
    low = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, h, edge]), near).min(axis=1)
    first = np.r_[0, np.flatnonzero((h < low[:len(h)]) & (h <= low[near + 1:])) + 1, len(words)]
    # words repeated over and over leave no place before the others; pieces of them have the same shingles wherever they begin
    step = 4 * (near + 1)
    long = np.flatnonzero(np.diff(first) > 2 * step)
    more = [np.arange(first[i] + step, first[i + 1] - step + 1, step) for i in long]
    return np.sort(np.concatenate([first[:-1], *more]))


def paragraphs_of(text: str, min_words: int = MIN_WORDS) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """A text's words, the number of each paragraph's first word, and the
    character offsets at which paragraphs begin and the last one ends. A
    paragraph holds the punctuation directly behind its last word and the white
    space before its first."""
    words, _, first, offsets = _paragraphs(text, min_words)
    return words, first, offsets


def _paragraphs(text: str, min_words: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    words = text.lower().encode().translate(_CLEAN).split()
    if not words:
        none = np.zeros(0, np.int64)
        return [], none.astype(np.uint64), none, none
    hashes = word_hashes(words)
    plain = text.encode()
    raw = np.frombuffer(plain, np.uint8)
    inside = _IS_WORD[raw].astype(np.int8)
    step = np.diff(inside, prepend=0, append=0)
    starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    end = np.flatnonzero(_IS_END[raw])
    after = np.r_[starts[1:], len(raw)]
    first = cuts(words, np.searchsorted(end, after) > np.searchsorted(end, stops), min_words)
    last = np.r_[first[1:], len(words)] - 1
    space = np.r_[np.flatnonzero(_IS_SPACE[raw]), len(raw)]
    close = np.minimum(after[last], space[np.searchsorted(space, stops[last])])
    if not plain.isascii():  # characters before each place, not bytes
        close -= np.searchsorted(np.flatnonzero(raw & 0xC0 == 0x80), close)
    return words, hashes, first, np.r_[0, close]


class Units:
    """Paragraphs of the texts of a batch: per paragraph its text's row, number,
    character span, first word and number of words, and class hash ``h``; and
    the hashes of their shingles, a run of ``sizes`` for each."""

    def __init__(self, texts: list[str], min_words: int):
        hashes, firsts, counts, at, upto, doc, no = [], [], [], [], [], [], []
        for d, text in enumerate(texts):
            _, h, first, offsets = _paragraphs(text, min_words)
            if len(first):
                hashes.append(h)
                firsts.append(first)
                counts.append(np.diff(np.r_[first, len(h)]))
                at.append(offsets[:-1])
                upto.append(offsets[1:])
                doc.append(np.full(len(first), d))
                no.append(np.arange(len(first)))
        none = np.zeros(0, np.int64)
        self.doc, self.no, self.at, self.upto, self.first, self.count = (np.concatenate([none, *x]) for x in (doc, no, at, upto, firsts, counts))
        self._w = np.concatenate([none.astype(np.uint64), *hashes])
        self._x = np.cumsum(self.count) - self.count  # paragraphs leave no word out
        if not len(self.doc):
            self.h = none.astype(np.uint64)
            return
        place = (np.arange(len(self._w)) - np.repeat(self._x, self.count)).astype(np.uint64)
        self.h = _mixed(np.add.reduceat(_mixed(self._w + place * np.uint64(0x9E3779B97F4A7C15)), self._x) + self.count.astype(np.uint64))

    def __len__(self) -> int:
        return len(self.doc)

    def shingles(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(hashes, sizes)`` of the paragraphs ``which``; one of up to ``SHINGLE`` words is a shingle itself."""
        x, n = self._x[which], self.count[which]
        sizes = np.maximum(1, n - SHINGLE + 1)
        begin = np.repeat(x - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        wide = np.repeat(np.minimum(n, SHINGLE), sizes)
        out = wide.astype(np.uint64)
        for j in range(SHINGLE):
            some = wide > j
            out[some] += self._w[begin[some] + j] * _ORDER[j]
        return _mixed(out), sizes


def band_keys(hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """A key per band and paragraph of the minima of its shingles' hashes."""
    begin = np.cumsum(sizes) - sizes
    keys = []
    for j in range(BANDS):
        key = np.full(len(sizes), j + 1, np.uint64)
        for r in range(j * ROWS, (j + 1) * ROWS):
            x = hashes * _MUL[r] + _ADD[r]
            key = (key ^ np.minimum.reduceat(x ^ (x >> np.uint64(32)), begin)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        keys.append(key)
    return keys


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text, doc)`` of the rows with both; ``doc`` is a 64-bit hash of id and text."""
    rows = need(docs, [id_col, text_col]).toDF("id", "text").where("id IS NOT NULL AND text IS NOT NULL")
    small_batches(docs.sparkSession)
    return rows.withColumn("doc", F.xxhash64("id", "text"))


def _batches(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[tuple[pa.RecordBatch, Units]]:
    for whole in batches:
        for b in batches_of_bytes(whole, "text", 4 << 20):
            units = Units(b.column("text").to_pylist(), min_words)
            if len(units):
                yield b, units


def shared_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(key, a, h)`` of every class ``h`` in a band key that several classes
    share, ``a`` being the smallest of them; and ``(null, null, h)`` of classes
    that several documents hold.

    A task merges the copies of a class, sorts its keys and hands them on as
    runs of 64-bit numbers, one for each range of keys. Of a class it keeps two
    documents at most, enough to tell whether there are several, so a class
    that a third of all documents share sends a few numbers a task."""
    rows = _rows(docs, id_col, text_col)
    ranges = max(16, -(-rows.count() // DOCS_PER_RANGE))

    def runs(keys: np.ndarray, h: np.ndarray, doc: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((h, keys) if doc is None else (doc, h, keys))
        keys, h, doc = keys[order], h[order], None if doc is None else doc[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (h[1:] != h[:-1])]
        if doc is not None:  # the smallest and the largest document of a class
            new |= np.r_[new[1:], True]
        keys, h, doc = keys[new], h[new], None if doc is None else doc[new]
        part = (keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        ends = np.r_[at[1:], len(part)]
        for lo in range(0, len(at), 4096):
            cut = list(zip(at[lo:lo + 4096].tolist(), ends[lo:lo + 4096].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[at[lo:lo + 4096]].astype(np.int64)), pa.array([keys[x:y].tobytes() for x, y in cut], pa.binary()),
                 pa.array([h[x:y].tobytes() for x, y in cut], pa.binary()),
                 pa.array([None if doc is None else doc[x:y].tobytes() for x, y in cut], pa.binary())], names=["part", "keys", "h", "doc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, doc, *keys = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from runs(keys[0], h, doc)
            yield from runs(np.concatenate(keys[1:]), np.tile(h, BANDS - 1), None)

        for b, u in _batches(batches, min_words):
            doc = b.column("doc").to_numpy().view(np.uint64)[u.doc]
            held.append((u.h, doc, *band_keys(*u.shingles(np.arange(len(u))))))
            rows_held += len(u)
            if rows_held * BANDS > KEYS_HELD:
                yield from flush()
                held, rows_held = [], 0
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for part, *data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if part != now and held:
                    yield _shared(held)
                    held = []
                now = part
                held.append(data)
        if held:
            yield _shared(held)

    dealt = rows.mapInArrow(run, "part bigint, keys binary, h binary, doc binary").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(meet, "key bigint, a bigint, h bigint")


def _shared(held: list[list[bytes | None]]) -> pa.RecordBatch:
    """Members of the keys that several classes share, and classes of several documents, in one key range."""
    def joined(rows: list[list[bytes | None]], i: int) -> np.ndarray:
        return np.frombuffer(b"".join(r[i] for r in rows), np.uint64)

    one = [r for r in held if r[2] is not None]
    h, doc = joined(one, 1), joined(one, 2)
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    many = np.unique(h[1:][(h[1:] == h[:-1]) & (doc[1:] != doc[:-1])])
    key, h = joined(held, 0), joined(held, 1)
    order = np.lexsort((h.view(np.int64), key))
    key, h = key[order], h[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (h[1:] != h[:-1])]
    key, h = key[new], h[new]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[at, len(key)])
    some = np.repeat(size > 1, size)
    least = np.repeat(h[at], size)[some]
    empty = pa.nulls(len(many), pa.int64())
    cols = [pa.concat_arrays([pa.array(x.view(np.int64)), y]) for x, y in ((key[some], empty), (least, empty), (h[some], pa.array(many.view(np.int64))))]
    return pa.RecordBatch.from_arrays(cols, names=["key", "a", "h"])


def class_bits(found: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bit table, as bytes, of the classes ``h`` in ``found``: bit ``h mod bits``
    is set. Spark ORs bitmaps of 32,768 bits; ``bits / 32768`` of them, a fixed
    number, reach the driver."""
    place = F.pmod("h", F.lit(bits).cast("long"))
    maps = found.select(place.alias("p")).groupBy((F.col("p") / _WORD_BITS).cast("long").alias("w")).agg(
        F.bitmap_construct_agg((F.col("p") % _WORD_BITS).cast("long")).alias("m"))
    table = np.zeros(bits // 8, np.uint8)
    for w, m in maps.toLocalIterator():
        table[w * _WORD_BITS // 8:(w + 1) * _WORD_BITS // 8] = np.frombuffer(m, np.uint8)
    return table


def units(docs: DataFrame, bits: np.ndarray, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per paragraph whose class has its bit set: id, document hash,
    number, character span, first word and number of words, class hash and
    shingle hashes (32 bits; two different shingles of a pair agree with
    probability 2**-32)."""
    rows = _rows(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b, u in _batches(batches, min_words):
            place = u.h % np.uint64(8 * len(table))
            which = np.flatnonzero((table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
            if not len(which):
                continue
            hashes, sizes = u.shingles(which)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array((hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            doc = pa.array(u.doc[which])
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(doc), b.column("doc").take(doc), *(pa.array(c[which], pa.int32()) for c in (u.no, u.at, u.upto, u.first, u.count)),
                 pa.array(u.h[which].view(np.int64)), lists], names=_COLS)

    kinds = ["bigint"] + ["int"] * 5 + ["bigint", "array<int>"]
    kind = f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} {k}" for c, k in zip(_COLS[1:], kinds, strict=True))
    return rows.mapInArrow(run, kind)


def similar_pairs(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """The ``(a, b)`` pairs of classes whose shingle sets have that Jaccard similarity or more."""
    left = shingles.select(F.col("h").alias("a"), F.col("s").alias("sa"))
    right = shingles.select(F.col("h").alias("b"), F.col("s").alias("sb"))
    p = pairs.distinct().join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return p.where(both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both) - F.lit(1e-9)).select("a", "b")


def clusters(members: DataFrame, found: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(node, root)`` of paragraph classes (hashes ``h``) connected by
    verified pairs, from the ``(key, a, h)`` members of shared keys and the
    paragraphs ``found`` of their classes."""
    needed = members.select("h").distinct()
    shingles = found.join(needed, "h", "left_semi").groupBy("h").agg(F.min("shingles").alias("s"))
    shingles = staged(shingles.withColumn("s", F.array_distinct("s")), "para-shingles")
    edges = staged(similar_pairs(members.where("a <> h").select("a", F.col("h").alias("b")), shingles, similarity), "para-edges")
    comps = staged(components(edges, kind="para-cc"), "para-comp")
    # classes of one bucket in different components haven't been compared unless one is the first
    m = members.join(comps, F.col("h") == F.col("node"), "left").select("key", "a", "h", F.coalesce("root", "h").alias("root"))
    mixed = m.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("n"))
    mixed = staged(mixed.where("r0 <> r1 AND n > 2").select("key", "n"), "para-mixed")
    rest = m.where("a <> h").join(mixed, "key").join(shingles, "h").select("key", "n", "h", "root", "s")
    more = staged(bucket_links(rest, similarity), "para-edges")
    return components(edges.union(more), kind="para-cc")


def bucket_links(members: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Verified links ``(a, b)`` between members of a bucket that are in
    different components (``root``), a spanning forest of them per task.

    A bucket of more than ``block`` classes is cut into blocks by hash, and
    each pair of its blocks is compared by itself: the work spreads, a task
    holds two blocks at most, every pair is compared and none is emitted."""
    blocks = F.ceil(F.col("n") / F.lit(float(block))).cast("int")
    m = members.withColumn("nb", blocks).withColumn("own", F.pmod(F.xxhash64("h"), F.col("nb").cast("long")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    m = m.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "h", "root", "s")
    dealt = m.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        out: list[tuple[int, int]] = []
        for b in batches:
            for key, x, y, h, root, s in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if (key, x, y) != now:
                    out += forest(group, similarity)
                    now, group = (key, x, y), []
                group.append((h, root, s))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        out += forest(group, similarity)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def forest(group: list[tuple[int, int, list[int]]], similarity: float) -> list[tuple[int, int]]:
    """Links between members ``(class, component, distinct shingles)`` whose
    sets are similar, as far as they join different components."""
    parent: dict[int, int] = {r: r for _, r, _ in group}
    if len(parent) < 2:
        return []

    def top(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    holders: dict[int, list[int]] = {}
    sizes = np.array([len(s) for _, _, s in group])
    out, open_ = [], len(parent)
    for i, (h, root, s) in enumerate(group):
        seen = [j for x in s for j in holders.get(x, ())]
        if seen:
            both = np.bincount(seen, minlength=i)
            for j in np.flatnonzero((both > 0) & (both >= similarity * (sizes[:len(both)] + sizes[i] - both) - 1e-9)).tolist():
                a, b = top(root), top(group[j][1])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((h, group[j][0]))
                    open_ -= 1
            if open_ < 2:
                break
        for x in s:
            holders.setdefault(x, []).append(i)
    return out


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, min_passage: int = 20,
             gap: int = 10, min_words: int = MIN_WORDS) -> DataFrame:
    """``(id_col, paragraph, at, upto, n_words, cluster_doc, cluster_paragraph,
    passage_words, removed)``: a row per paragraph of a repeated passage.

    ``at`` and ``upto`` are character offsets; ``cluster_doc`` and
    ``cluster_paragraph`` name the cluster's first paragraph, by id and number,
    the only one that isn't removed. A cluster has paragraphs of at least two
    documents. Rows without an id or text are left out (nothing could name
    what to remove), empty texts have no paragraph, repeated rows of an id and
    text are one document, two texts of one id are two. Texts of any length
    are read whole, an empty table gives an empty result, other columns are
    ignored.
    """
    return _repeated(docs, id_col, text_col, similarity, min_passage, gap, min_words).drop("doc").withColumnRenamed("id", id_col)


def _repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, min_passage: int = 20,
              gap: int = 10, min_words: int = MIN_WORDS) -> DataFrame:
    """:func:`repeated` with the ids as ``id`` and the documents' hashes as ``doc``."""
    keys = staged(shared_keys(docs, id_col, text_col, min_words), "para-keys")
    found = staged(units(docs, class_bits(keys), id_col, text_col, min_words), "para-units")
    comps = staged(clusters(keys.where("key IS NOT NULL"), found, similarity), "para-comp")
    per = found.groupBy("h").agg(F.min(F.struct("id", "doc", "no")).alias("first"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    per = staged(per.join(comps, F.col("h") == F.col("node"), "left").select("h", "first", "lo", "hi", F.coalesce("root", "h").alias("root")), "para-classes")
    roots = per.groupBy("root").agg(F.min("first").alias("first"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi")
    classes = staged(per.select("h", "root").join(roots.select("root", "first"), "root").select("h", "first"), "para-repeated")
    occ = found.drop("shingles").join(classes, "h").drop("h").dropDuplicates(["id", "doc", "no"])
    w = Window.partitionBy("id", "doc").orderBy("no")
    occ = occ.withColumn("_end", F.max(F.col("first_word") + F.col("n_words")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    occ = occ.withColumn("_new", F.when(F.col("_end").isNull() | (F.col("first_word") - F.col("_end") > gap), 1).otherwise(0))
    occ = occ.withColumn("_passage", F.sum("_new").over(w))
    p = Window.partitionBy("id", "doc", "_passage")
    occ = occ.withColumn("passage_words", F.max(F.col("first_word") + F.col("n_words")).over(p) - F.min("first_word").over(p))
    occ = occ.where(F.col("passage_words") >= min_passage)
    return occ.select("id", "doc", F.col("no").alias("paragraph"), "at", "upto", "n_words", F.col("first.id").alias("cluster_doc"), F.col("first.no").alias("cluster_paragraph"),
                      "passage_words", (F.col("first") != F.struct("id", "doc", "no")).alias("removed"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the removed paragraphs cut out of their texts (their
    closing punctuation with them); rows and other columns, of any name, stay.
    A span is cut from the text in which it was found, never from another text
    of the same id."""
    gone = _repeated(docs, id_col, text_col, **options).where("removed")
    spans = gone.groupBy("id", "doc").agg(F.sort_array(F.collect_list(F.struct("at", "upto"))).alias("spans"))  # of one text
    spans = staged(spans.select(F.struct("id", "doc").alias("of"), "spans"), "para-spans")
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    i, t = F.col(names[docs.columns.index(id_col)]), F.col(names[docs.columns.index(text_col)])
    joined = rows.join(spans, F.struct(i.alias("id"), F.xxhash64(i, t).alias("doc")) == F.col("of"), "left")
    # pieces between spans: from one span's end to the next one's start
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["upto"]))
    ends = F.concat(F.transform("spans", lambda s: s["at"]), F.array(F.length(t)))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(t, a + 1, F.greatest(b - a, F.lit(0))))
    cut = F.when(F.col("spans").isNull(), t).otherwise(F.array_join(pieces, ""))
    return joined.select(*[cut.alias(c) if c == text_col else F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
