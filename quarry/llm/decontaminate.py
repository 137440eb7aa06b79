"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit check.

A document is contaminated by a benchmark item when some run of its words is
within an edit distance of ``(1 - similarity) * words of the item`` of the
item (words are compared without case and ASCII punctuation).

**Embedding.** The CGK random walk turns a word sequence into another one: at
step ``t`` it writes the word under its pointer, and a random bit of
``(t, word)`` tells whether the pointer moves on. Two sequences at a small edit
distance fall into step again after an edit, so their outputs differ in few
places: edit distance becomes Hamming distance.

**Sampling.** A key is the output at ``SAMPLES`` random steps (step 0 always
among them). Keys are taken at every word of every document and at every word
of every item from which the walk stays inside the item, so an item-sized
window is met by all of its own sub-walks. ``repeats`` independent walks are
used; their number follows from the wanted recall and the lowest hit rate of
any length class, measured on the class's shortest items with edits at the
threshold, random ones and evenly spread ones.

**Pieces.** Items too short for the walk (under ``STEPS`` words), and classes
that would need more than ``MAX_REPEATS`` walks, are found exactly: an item that
allows ``k`` edits is cut into ``k + 1`` pieces, one of which every matching run
holds unedited.

**Verification.** Each hit gives an alignment; the exact word edit distance of
the item to the best run around it decides.

Documents are scanned where they are read: no shuffle, no part of a text
skipped. Items are handed to the tasks in blocks of at most ``BLOCK_WORDS``
words, one scan per block, so what is sent to the tasks has a fixed bound.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of_bytes, byte_rows, small_batches

STEPS = 16
SAMPLES = 8
#: Words outside the items share so many ids; they can't match, but steer the walk.
OTHERS = 1 << 16
#: Words of items handled in one scan, at most (an item is never cut).
BLOCK_WORDS = 200_000
#: A length class that needs more walks is found by its pieces: exactly, and with less work than that many walks.
MAX_REPEATS = 3
REMEMBERED = 1 << 18
HITS_AT_ONCE = 1 << 20
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(column: pa.Array) -> list[list[bytes]]:
    """Words of each text: lower case, ASCII punctuation taken as white space; none for null."""
    return [t.translate(_CLEAN).split() for t in byte_rows(pc.utf8_lower(column))]


class _Ids(dict):
    def __init__(self, vocabulary: dict[bytes, int]):
        super().__init__(vocabulary)
        self.base, self.vocabulary = len(vocabulary) + 1, vocabulary

    def __missing__(self, word: bytes) -> int:
        if len(self) > len(self.vocabulary) + REMEMBERED:
            self.clear()
            self.update(self.vocabulary)
        self[word] = v = self.base + zlib.crc32(word) % OTHERS
        return v


class Index:
    """Keys of a block of items. Id 0 stands past a sequence's end."""

    def __init__(self, items: list[tuple[int, list[bytes]]], similarity: float, recall: float, repeats: int | None = None,
                 walked: frozenset[int] | None = None):
        self.similarity = similarity
        vocabulary: dict[bytes, int] = {}
        for _, ws in items:
            for w in ws:
                vocabulary.setdefault(w, len(vocabulary) + 1)
        self.vocabulary = vocabulary
        self.items = [(i, np.array([vocabulary[w] for w in ws], np.int64)) for i, ws in items if ws]
        classes = sorted({length_class(len(x)) for _, x in self.items if len(x) >= STEPS})
        self.rates: dict[int, float] = {}
        if walked is None:
            walked = frozenset(classes)
            if repeats is None:
                self._keys(2, walked)
                self.rates = {c: self._hit_rate(c) for c in classes}
                wanted = {c: walks_for(r, recall) for c, r in self.rates.items()}
                walked = frozenset(c for c, n in wanted.items() if n <= MAX_REPEATS)
                repeats = max([3, *(wanted[c] for c in walked)])
        self.walked, self.repeats = walked, repeats if repeats is not None else 3
        self._keys(self.repeats, walked)
        self._pieces(walked)

    def _is_walked(self, item: np.ndarray, walked: frozenset[int]) -> bool:
        return len(item) >= STEPS and length_class(len(item)) in walked

    def _most(self, item: np.ndarray) -> int:
        """Edits that an item allows."""
        return int((1 - self.similarity) * len(item) + 1e-9)

    def _pieces(self, walked: frozenset[int]) -> None:
        """Key tables of the pieces of all items that aren't walked, by piece length."""
        mine = [no for no, (_, x) in enumerate(self.items) if not self._is_walked(x, walked)]
        self.piece_first = np.zeros(len(self.vocabulary) + 1 + OTHERS, bool)
        self.prefixes: list[np.ndarray] = []
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        if not mine:
            return
        flat = np.concatenate([self.items[no][1] for no in mine])
        cuts = []
        for no in mine:
            n = len(self.items[no][1])
            parts = min(self._most(self.items[no][1]) + 1, n)
            cuts.append(np.arange(parts + 1) * n // parts)
        at, size = np.concatenate([c[:-1] for c in cuts]), np.concatenate([np.diff(c) for c in cuts])
        owner = np.repeat(mine, [len(c) - 1 for c in cuts])
        start = at + np.repeat(np.cumsum([0, *(c[-1] for c in cuts[:-1])]), [len(c) - 1 for c in cuts])
        self.piece_first[flat[start]] = True
        key = np.zeros(len(start), np.uint64)
        for q in range(1, int(size.max()) + 1):
            key = mixed(key, flat[start + q - 1])
            self.prefixes.append(np.unique(key))
            ends = np.flatnonzero(size == q)
            if len(ends):
                ends = ends[np.argsort(key[ends], kind="stable")]
                self.tables[q] = key[ends], owner[ends], at[ends]
            more = size > q
            key, start, size, owner, at = key[more], start[more], size[more], owner[more], at[more]

    def _piece_hits(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions in ``x`` at which pieces stand, their items and places in the items."""
        s = np.flatnonzero(self.piece_first[x])
        key = np.zeros(len(s), np.uint64)
        for q, prefix in enumerate(self.prefixes, 1):
            near = s + q <= len(x)
            s, key = s[near], key[near]
            key = mixed(key, x[s + q - 1])
            ok = prefix[np.minimum(np.searchsorted(prefix, key), len(prefix) - 1)] == key
            s, key = s[ok], key[ok]
            if q in self.tables:
                keys, owner, at = self.tables[q]
                yield from hits(s, key, keys, owner, at)

    def _keys(self, repeats: int, walked: frozenset[int]) -> None:
        n = len(self.vocabulary) + 1 + OTHERS
        rng = np.random.default_rng(20)
        self.walks = []
        for _ in range(repeats):
            steps = np.r_[0, np.sort(rng.choice(np.arange(1, STEPS), SAMPLES - 1, replace=False))]
            self.walks.append({"steps": steps, "bits": rng.integers(0, 1 << STEPS, n, dtype=np.uint32)})
        mine = [no for no, (_, x) in enumerate(self.items) if self._is_walked(x, walked)]
        lengths = [len(self.items[no][1]) for no in mine]
        flat = np.concatenate([np.r_[self.items[no][1], np.zeros(STEPS, np.int64)] for no in mine]) if mine else np.zeros(0, np.int64)
        owner = np.repeat(np.array(mine, int), np.array(lengths, int) + STEPS)
        at = np.concatenate([np.arange(k + STEPS) for k in lengths]) if mine else np.zeros(0, int)
        starts = np.flatnonzero(flat > 0)
        self.first = np.zeros(n, bool)
        self.first[flat[starts]] = True
        for w in self.walks:
            ends, keys, prefixes = self._walk(np.r_[flat, np.zeros(STEPS, np.int64)], starts, w, None)
            # a key that reads past its item's end can't be met inside a document
            order = np.argsort(keys, kind="stable")
            w["sorted"], w["owner"], w["at"] = keys[order], owner[ends[order]], at[ends[order]]
            w["prefix"] = [np.unique(p) for p in prefixes]

    @staticmethod
    def _walk(x: np.ndarray, starts: np.ndarray, w: dict, prefix: list[np.ndarray] | None):
        """Starts that reach the last sampled step, their keys, and (when the
        items themselves are walked) the keys so far at every sampled step."""
        here, s = starts.copy(), starts
        key = np.zeros(len(s), np.uint64)
        got, sampled = [], 0
        for t in range(int(w["steps"][-1]) + 1):
            sym = x[here]
            if t == w["steps"][sampled]:
                key = (key ^ sym.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
                if prefix is None:
                    ok = sym > 0
                else:
                    p = prefix[sampled]
                    ok = p[np.minimum(np.searchsorted(p, key), len(p) - 1)] == key if len(p) else np.zeros(len(key), bool)
                s, here, key, sym = s[ok], here[ok], key[ok], sym[ok]
                got.append(key)
                sampled += 1
            here = here + ((w["bits"][sym] >> np.uint32(t)) & np.uint32(1))
        return s, key, got

    def _hit_rate(self, length: int) -> float:
        """Share of the shortest items of a length class that one walk meets,
        edited in ``1 - similarity`` of their words: the lower of random edits
        and substitutions at even distances, at least 100 trials of each,
        less two standard errors."""
        rng = np.random.default_rng([21, length])
        mine = sorted((len(x), no) for no, (_, x) in enumerate(self.items) if len(x) >= STEPS and length_class(len(x)) == length)[:60]
        rounds = -(-100 // (len(mine) * len(self.walks)))
        hit, n = [0, 0], 0
        for _, no in mine * rounds:
            x = self.items[no][1]
            most = self._most(x)
            other = len(self.vocabulary) + 1 + rng.integers(0, OTHERS, 2 * most)
            y = list(x)
            for o in other[:most].tolist():
                p, kind = int(rng.integers(0, max(1, len(y)))), int(rng.integers(0, 3))
                y[p:p + 1] = [o] if kind == 0 else [] if kind == 1 else [*y[p:p + 1], o]
            even = x.copy()
            even[(np.arange(most) + 1) * len(x) // (most + 1)] = other[most:]
            for k, edited in enumerate((np.array(y, np.int64), even)):
                z = np.r_[edited, np.zeros(STEPS, np.int64)]
                for w in self.walks:
                    s, key, _ = self._walk(z, np.flatnonzero(self.first[z]), w, w["prefix"])
                    hit[k] += bool((np.concatenate([no_ for _, no_, _ in hits(s, key, w["sorted"], w["owner"], w["at"])] or [[]]) == no).any())
            n += len(self.walks)
        rate = min(hit) / n
        return max(0.0, rate - 2 * math.sqrt(rate * (1 - rate) / n))  # less two standard errors of the trials

    def scan(self, docs: list[np.ndarray]) -> list[dict[int, tuple[int, int]]]:
        """Per document ``{item number: (distance, first word)}`` of its best match."""
        out: list[dict[int, tuple[int, int]]] = [{} for _ in docs]
        if not self.items or not docs:
            return out
        begin = np.cumsum([0, *(len(d) + 1 for d in docs)])
        x = np.concatenate([*(y for d in docs for y in (d, [0])), np.zeros(STEPS, np.int64)]).astype(np.int64)
        starts = np.flatnonzero(self.first[x])

        def spots() -> Iterator[tuple[int, int, int]]:
            def met() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                yield from self._piece_hits(x)
                for w in self.walks:
                    s, key, _ = self._walk(x, starts, w, w["prefix"])
                    yield from hits(s, key, w["sorted"], w["owner"], w["at"])

            for p, no, at in met():
                doc = np.searchsorted(begin, p, side="right") - 1
                # alignments less than 4 words apart are one check
                spot = (p - begin[doc] - at) // 4
                order = np.lexsort((spot, no, doc))
                doc, no, spot = doc[order], no[order], spot[order]
                new = np.r_[True, (np.diff(doc) != 0) | (np.diff(no) != 0) | (np.diff(spot) != 0)]
                yield from zip(doc[new].tolist(), no[new].tolist(), spot[new].tolist(), strict=True)

        seen: set[tuple[int, int, int]] = set()
        for place in spots():
            if place in seen:
                continue
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(place)
            d, no, from_ = place[0], place[1], place[2] * 4
            item = self.items[no][1]
            most = self._most(item)
            slack = most + 4
            left = max(0, from_ - slack)
            best = out[d].get(no)
            if best and best[0] == 0 and best[1] <= left:
                continue
            window = docs[d][left:max(0, from_ + len(item) + slack)]
            # each item word that the window lacks is an edit: a bound that spares most of the exact checks
            if np.count_nonzero(~np.isin(item, window)) > most:
                continue
            dist, first = best_run(item, window)
            if dist <= most and (dist, left + first) < out[d].get(no, (1 << 30, 0)):
                out[d][no] = (dist, left + first)
        return out


def length_class(words: int) -> int:
    return words.bit_length()


def walks_for(rate: float, recall: float) -> float:
    """Independent walks of that hit rate that reach the recall together."""
    return math.inf if rate <= 0 else 1 if rate >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - rate)) if recall < 1 else math.inf


def mixed(key: np.ndarray, sym: np.ndarray) -> np.ndarray:
    key = (key ^ sym.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return key ^ (key >> np.uint64(29))


def hits(s: np.ndarray, key: np.ndarray, keys: np.ndarray, owner: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Every meeting of ``key`` with the sorted ``keys``, about ``HITS_AT_ONCE``
    at a time: start, item, place in the item."""
    lo = np.searchsorted(keys, key)
    n = np.searchsorted(keys, key, side="right") - lo
    some = n > 0
    s, lo, n = s[some], lo[some], n[some]
    group = np.cumsum(n) // HITS_AT_ONCE
    for a, b in zip(*(e.tolist() for e in (np.flatnonzero(np.diff(group, prepend=-1)), np.flatnonzero(np.diff(group, append=-1)) + 1)), strict=True):
        m = n[a:b]
        k = np.repeat(lo[a:b] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        yield np.repeat(s[a:b], m), owner[k], at[k]


def best_run(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Smallest edit distance of ``item`` to a run of ``window``, and the run's first position."""
    n = len(window)
    step = np.arange(n + 1)
    width = n + 2
    # distance and start packed into one number: minima prefer the smaller distance, then the smaller start
    row = np.arange(n + 1, dtype=np.int64)
    for sym in item:
        up = row + width
        diag = row[:-1] + np.where(window == sym, 0, width)
        now = up.copy()
        now[1:] = np.minimum(up[1:], diag)
        row = np.minimum.accumulate(now - step * width) + step * width
    best = int(row.min())
    return best // width, best % width


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items in blocks of at most ``BLOCK_WORDS`` words, read one partition at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    for r in rows.distinct().orderBy("i", "t").toLocalIterator():
        ws = words_of(pa.array([r["t"]], pa.string()))[0]
        if not ws:
            continue
        if block and size + len(ws) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r["i"], ws))
        size += len(ws)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", similarity: float = 0.8, recall: float = 0.99,
                 repeats: int | None = None) -> DataFrame:
    """``(id_col, item_col, distance, first_word)``, one row per document row
    and item found in it: the smallest word edit distance, and the number of
    the first word of the run that has it. Items are unique texts of a
    non-null id; null and empty texts match nothing, null document ids are
    returned as they are, a repeated document row is reported as often as it
    occurs."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    ikind = benchmark.schema[item_col].dataType.simpleString()
    kind = f"id {rows.schema['id'].dataType.simpleString()}, item {ikind}, distance int, first_word int"
    out = None
    for block in item_blocks(benchmark, item_col, item_text):
        part = rows.mapInArrow(_scanner(docs, block, similarity, recall, repeats, False, ikind), kind)
        out = part if out is None else out.union(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], kind)
    return out.toDF(id_col, item_col, "distance", "first_word")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
          similarity: float = 0.8, recall: float = 0.99, repeats: int | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item; filtered in the scan itself."""
    names, kept = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    docs = docs.toDF(*kept)
    kind = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    for block in item_blocks(benchmark, item_col, item_text):
        rows = docs.select(*kept, F.col(kept[names.index(text_col)]).alias("text"))
        docs = rows.mapInArrow(_scanner(docs, block, similarity, recall, repeats, True, ""), kind)
    return docs.toDF(*names)


def _scanner(docs: DataFrame, block, similarity: float, recall: float, repeats: int | None, keep: bool, ikind: str):
    plan = Index(block, similarity, recall, repeats)
    repeats, walked = plan.repeats, plan.walked
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, similarity, recall, repeats, walked)
        ids = _Ids(index.vocabulary)
        col = "text"
        for whole in batches:
            for b in batches_of_bytes(whole, col, 4 << 20):
                found = index.scan([np.array(list(map(ids.__getitem__, ws)), np.int64) for ws in words_of(b.column(col))])
                if keep:
                    mask = pa.array([not f for f in found], pa.bool_())
                    yield b.select(range(b.num_columns - 1)).filter(mask)
                    continue
                rows = [(d, index.items[no][0], dist, first) for d, f in enumerate(found) for no, (dist, first) in sorted(f.items())]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [b.column("id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows]),
                         pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32())],
                        names=["id", "item", "distance", "first_word"])

    return run
