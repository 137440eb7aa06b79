"""Ranked lexical search by a dual tree: hierarchies over items and documents.

An item's score with a document adds, over the item's terms, the term's weight
times a saturated frequency in the document. Both factors are non-negative, so
the coordinate maxima of a set of items and of a set of documents bound the
score of every pair from the two sets. A pair of tree nodes whose bound is
below the weakest k-th best score of the node's items can't hold a result and
is dropped with all pairs below it; what is left is scored exactly.

1. Items are dealt into blocks of about ``BLOCK_WORDS`` words. A block has its
   own vocabulary, which bounds everything that a task holds of it.
2. One pass over the documents, whole texts, writes their lengths and their
   frequencies of the vocabularies' terms. Document counts, lengths and term
   counts are sums over that table.
3. The item trees are built in tasks, a block each, and written beside the
   vocabularies in the shared checkpoint folder, where every search task reads
   them, a block at a time. Neither items nor documents reach the driver.
4. A search task takes ``CHUNK`` documents at a time, orders them so that
   similar ones lie together, and walks both trees together, the documents'
   level by level. An item's k best so far are kept from chunk to chunk.
   Documents of a fixed sixteenth of the hashes are searched first; the k-th
   scores found there are where all other tasks begin, so they prune from
   their first chunk. They are lower bounds, so no result is lost.

All arithmetic is whole numbers of 64 bits but the weights' logarithm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of_bytes, byte_rows, file_system, need, shared_path, small_batches, staged

#: Words of the items of a block, about.
BLOCK_WORDS = 1 << 14
#: Documents of a search step, of a document leaf, and children of a document node.
CHUNK, LEAF, FANOUT = 4096, 4, 4
#: Terms of the documents of a search step, about.
ENTRIES = 1 << 21
#: Children of an item node; a leaf is one item.
ITEM_FANOUT = 4
#: One in so many documents is searched first.
FIRST = 16
#: Dimensions in which similar vectors are brought together.
SKETCH = 8
LAST_ID = (1 << 63) - 1
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other signs beyond ASCII, A-Z lowered."""
    return text.translate(_LOWER).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 100 - 75 + (75 * n.astype(np.int64) * n_docs) // max(1, n_terms)


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m)


# items and vocabularies

def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, item, terms)``: distinct rows of ``items`` that have a term, numbered by hash of id and text."""
    rows = need(items, [id_col, text_col]).toDF("item_id", "text").where("text IS NOT NULL").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [terms(t) for t in byte_rows(b.column("text"))]
            full = pa.array([len(f) > 0 for f in found], pa.bool_())
            out = pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])
            yield out.filter(full)

    kind = rows.schema["item_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"item_id {kind}, terms array<binary>")
    return found.select("item_id", F.xxhash64("item_id", "terms").alias("item"), "terms")


def blocks(found: DataFrame, block_words: int) -> DataFrame:
    """``found`` with ``block``: items dealt by hash into blocks of about ``block_words`` words."""
    words = found.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = max(1, -(-words // block_words))
    return found.withColumn("block", F.pmod("item", F.lit(n).cast("long")).cast("int"))


def vocabulary(found: DataFrame) -> DataFrame:
    """``(block, no, term)``: terms of a block, numbered from 0."""
    each = found.select("block", F.explode("terms").alias("term")).distinct()
    # a block has BLOCK_WORDS words, about, or is one long item
    return each.withColumn("no", F.row_number().over(Window.partitionBy("block").orderBy("term")) - 1).select("block", "no", "term")


def read_shared(path: str, block: int | None = None) -> pa.Table:
    """A Parquet table below the shared folder, read inside a task; one block of it, if named."""
    fs, inner = file_system(path)
    return pq.read_table(inner, filesystem=fs, filters=None if block is None else [("block", "=", block)])


# documents

def doc_vectors(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(block, id, n, no, tf)``: per document and block its length in terms,
    the numbers of the block's terms that it holds, ascending, and their
    frequencies. A document without any term has no row, one without a
    vocabulary term one row of block 0; ids are longs, a null id stays null."""
    small_batches(docs.sparkSession)
    rows = need(docs, [id_col, text_col]).toDF("id", "text").where("text IS NOT NULL").select(F.col("id").cast("long").alias("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, list[tuple[int, int]]] = {}
        single: dict[bytes, int] = {}
        table = read_shared(vocab_path)
        several = len(table) and len(table.column("block").unique()) > 1
        for b, no, t in zip(*(table.column(c).to_pylist() for c in ("block", "no", "term")), strict=True):
            if several:
                number.setdefault(t, []).append((b, no))
            else:
                single[t] = no
        del table
        for whole in batches:
            for b in batches_of_bytes(whole, "text", 4 << 20):
                n, owner, block, no = [], [], [], []
                for d, text in enumerate(byte_rows(b.column("text"))):
                    words = terms(text)
                    n.append(len(words))
                    if several:
                        hits = [p for w in words if w in number for p in number[w]]
                        block += [x for x, _ in hits]
                        no += [y for _, y in hits]
                        owner += [d] * len(hits)
                    else:
                        hits = [single[w] for w in words if w in single]
                        no += hits
                        owner += [d] * len(hits)
                if not any(n):
                    continue
                blocks_met = np.array(block, np.int64) if several else np.zeros(len(no), np.int64)
                yield _vector_rows(b.column("id"), np.array(n), np.array(owner, np.int64), blocks_met, np.array(no, np.int64))

    return rows.mapInArrow(run, "block int, id bigint, n bigint, no array<int>, tf array<int>")


def _vector_rows(ids: pa.Array, n: np.ndarray, owner: np.ndarray, block: np.ndarray, no: np.ndarray) -> pa.RecordBatch:
    # every document with a term has a row of block 0, even without a vocabulary term
    bare = np.flatnonzero(n > 0)
    owner, block, no = np.r_[bare, owner], np.r_[np.zeros(len(bare), np.int64), block], np.r_[np.full(len(bare), -1), no]
    order = np.lexsort((no, block, owner))
    owner, block, no = owner[order], block[order], no[order]
    at = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1]) | (no[1:] != no[:-1])])
    tf = np.diff(np.r_[at, len(no)])
    owner, block, no = owner[at], block[at], no[at]
    row = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])])
    real = no >= 0
    starts = np.r_[0, np.cumsum(real)][np.r_[row, len(no)]].astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(starts), pa.array(x[real].astype(np.int32))) for x in (no, tf)]
    return pa.RecordBatch.from_arrays([pa.array(block[row].astype(np.int32)), ids.take(pa.array(owner[row])), pa.array(n[owner[row]].astype(np.int64)), *lists],
                                      names=["block", "id", "n", "no", "tf"])


# trees

def _sketch(owner: np.ndarray, no: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Random projections, scaled to unit length, of sparse rows: signs come from a hash of the term number."""
    x = (no.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
    out = np.empty((rows, SKETCH))
    for j in range(SKETCH):
        sign = np.where((x >> np.uint64(j)) & np.uint64(1), value, -value).astype(np.float64)
        out[:, j] = np.bincount(owner, weights=sign, minlength=rows)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)


def tree_order(sketch: np.ndarray, leaf: int) -> np.ndarray:
    """Rows in an order in which runs of ``leaf`` rows, and of its multiples by
    powers of two, are alike: halves at the median of the widest dimension."""
    order = [np.arange(len(sketch))]
    size = leaf
    while size < len(sketch):
        size *= 2
    while size > leaf:
        size //= 2
        out = []
        for o in order:
            if len(o) > size:
                part = sketch[o]
                o = o[np.argsort(part[:, int(np.argmax(part.var(axis=0)))], kind="stable")]
                out += [o[:size], o[size:]]
            else:
                out.append(o)
        order = out
    return np.concatenate(order) if len(sketch) else np.zeros(0, np.int64)


def _maxima(level: np.ndarray, fanout: int) -> np.ndarray:
    """Coordinate maxima of runs of ``fanout`` rows."""
    return np.maximum.reduceat(level, np.arange(0, len(level), fanout), axis=0)


@dataclass
class ItemNode:
    """Items ``lo:hi`` of a block's order, the numbers of their terms and the maxima of their weights."""

    lo: int
    hi: int
    no: np.ndarray
    top: np.ndarray
    children: list[ItemNode]


class ItemTree:
    """Items of a block in tree order: weights as sparse rows, and the nodes over them."""

    def __init__(self, block: int, item: np.ndarray, start: np.ndarray, no: np.ndarray, weight: np.ndarray, n_terms: int):
        self.block, self.item, self.start, self.no, self.weight, self.n_terms = block, item, start, no, weight, n_terms
        level = [self._node(lo, lo + 1, []) for lo in range(len(item))]
        while len(level) > 1:
            level = [self._node(g[0].lo, g[-1].hi, g) for g in (level[i:i + ITEM_FANOUT] for i in range(0, len(level), ITEM_FANOUT))]
        self.root = level[0] if level else None

    def _node(self, lo: int, hi: int, children: list[ItemNode]) -> ItemNode:
        no = np.concatenate([c.no for c in children]) if children else self.no[self.start[lo]:self.start[hi]]
        top = np.concatenate([c.top for c in children]) if children else self.weight[self.start[lo]:self.start[hi]]
        order = np.lexsort((top, no))
        no, top = no[order], top[order]
        last = np.flatnonzero(np.r_[no[1:] != no[:-1], True][:len(no)])
        return ItemNode(lo, hi, no[last], top[last], children)

    def dense(self, item: int) -> np.ndarray:
        """Weights of an item by term number."""
        out = np.zeros(self.n_terms, np.int64)
        s = slice(self.start[item], self.start[item + 1])
        out[self.no[s]] = self.weight[s]
        return out


def item_trees(found: DataFrame, vocab_path: str, counts: DataFrame, n_docs: int) -> DataFrame:
    """``(block, place, item, item_id, no, weight)``: items in tree order, the
    weight of a term times its repeats in the item. A block is one task's group
    and has ``BLOCK_WORDS`` words, about; ``counts`` has ``(block, no, df)``."""
    item_kind = found.schema["item_id"].dataType.simpleString()

    def build(key, rows: pd.DataFrame, df: pd.DataFrame) -> pd.DataFrame:
        table = read_shared(vocab_path, int(key[0]))
        number = dict(zip(table.column("term").to_pylist(), table.column("no").to_pylist(), strict=True))
        w = np.full(len(number), weight(n_docs, 0), np.int64)
        w[df["no"].to_numpy(np.int64)] = [weight(n_docs, x) for x in df["df"].tolist()]
        rows = rows.sort_values("item", kind="stable").reset_index(drop=True)
        nos, repeats, values = [], [], []
        for t in rows["terms"]:
            no, times = np.unique(np.array([number[bytes(x)] for x in t], np.int64), return_counts=True)
            nos.append(no)
            repeats.append(times)
            values.append(w[no] * times)
        owner = np.repeat(np.arange(len(rows)), [len(x) for x in nos])
        order = tree_order(_sketch(owner, np.concatenate([*nos, []]), np.concatenate([*repeats, []]), len(rows)), 1)
        out = rows.iloc[order][["item", "item_id"]].reset_index(drop=True)
        return pd.DataFrame({"block": int(key[0]), "place": np.arange(len(out)), "item": out["item"], "item_id": out["item_id"],
                             "no": [nos[i] for i in order], "weight": [values[i] for i in order]})

    kind = f"block int, place int, item bigint, item_id {item_kind}, no array<int>, weight array<bigint>"
    return found.groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(
        lambda key, a, b: build(key, a, b) if len(a) else pd.DataFrame({c: [] for c in ("block", "place", "item", "item_id", "no", "weight")}), kind)


def load_tree(tree_path: str, vocab_path: str, block: int) -> ItemTree:
    t = read_shared(tree_path, block).sort_by("place")
    no = t.column("no").combine_chunks()
    sizes = no.value_lengths().to_numpy(zero_copy_only=False)
    return ItemTree(block, t.column("item").to_numpy(), np.r_[0, np.cumsum(sizes)].astype(np.int64), no.flatten().to_numpy().astype(np.int64),
                    t.column("weight").combine_chunks().flatten().to_numpy(), len(read_shared(vocab_path, block)))


# search

class Best:
    """The k best documents of each item of a block: score, id (``LAST_ID`` for null), and 1 if the id is null."""

    def __init__(self, items: int, k: int, bar: np.ndarray | None = None):
        self.k = k
        self.rows: list[np.ndarray] = [np.zeros((0, 3), np.int64) for _ in range(items)]
        #: weakest k-th score: nothing below it can be a result, nothing of score 0 is one
        self.bar = np.maximum(1, bar if bar is not None else 0) * np.ones(items, np.int64)

    def offer(self, item: int, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.bar[item]
        if not good.any():
            return
        rows = np.concatenate([self.rows[item], np.column_stack([score[good], ids[good], null[good]])])
        if len(rows) > self.k:
            rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[:self.k]]
        self.rows[item] = rows
        if len(rows) == self.k:
            self.bar[item] = max(self.bar[item], rows[:, 0].min())


class DocTree:
    """A chunk of documents in tree order: sparse rows and, per level, the nodes' coordinate maxima."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, start: np.ndarray, no: np.ndarray, tf: np.ndarray, value: np.ndarray, n_terms: int):
        sizes = np.diff(start)
        owner = np.repeat(np.arange(len(ids)), sizes)
        order = tree_order(_sketch(owner, no, tf, len(ids)), LEAF)
        self.ids, self.null = ids[order], null[order]
        self.start = np.r_[0, np.cumsum(sizes[order])]
        at = np.repeat(start[order] - self.start[:-1], sizes[order]) + np.arange(len(no))
        self.no, self.value = no[at], value[at]
        leaf = np.repeat(np.arange(len(ids)) // LEAF, sizes[order])
        top = np.zeros((-(-len(ids) // LEAF), n_terms), np.int32)  # a saturated frequency is below 10**6
        np.maximum.at(top, (leaf, self.no), self.value.astype(np.int32))
        self.levels = [top]
        while len(self.levels[0]) > FANOUT:
            self.levels.insert(0, _maxima(self.levels[0], FANOUT))

    def scores(self, leaves: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of ``leaves`` that hold a term, and their scores with an item's weights."""
        docs = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        docs = docs[docs < len(self.ids)]
        size = self.start[docs + 1] - self.start[docs]
        docs, size = docs[size > 0], size[size > 0]
        if not len(docs):
            return docs, docs
        ends = np.cumsum(size)
        at = np.repeat(self.start[docs] - (ends - size), size) + np.arange(ends[-1])
        return docs, np.add.reduceat(dense[self.no[at]] * self.value[at], ends - size)


@dataclass
class Walk:
    """What a traversal looked at: bounded node pairs, and documents times items scored exactly."""

    bounds: int = 0
    scored: int = 0


def dual_search(items: ItemTree, docs: DocTree, best: Best, walk: Walk | None = None) -> None:
    """Offer to ``best`` every pair whose score can still be among the k best of its item."""
    walk = walk or Walk()

    def visit(node: ItemNode, level: int, nodes: np.ndarray) -> None:
        maxima = docs.levels[level]
        bound = maxima[np.ix_(nodes, node.no)].astype(np.int64) @ node.top
        walk.bounds += len(nodes)
        keep = bound >= best.bar[node.lo:node.hi].min()
        nodes = nodes[keep]
        if not len(nodes):
            return
        deepest = level == len(docs.levels) - 1
        if not deepest:
            below = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            below = below[below < len(docs.levels[level + 1])]
        if node.children:
            for child in node.children:
                visit(child, level if deepest else level + 1, nodes if deepest else below)
        elif not deepest:
            visit(node, level + 1, below)
        else:
            # the most promising leaves first, then ever more at a time: they raise the bar for the others
            item, bound = node.lo, bound[keep]
            order = np.argsort(-bound, kind="stable")
            nodes, bound = nodes[order], bound[order]
            dense, at, step = items.dense(item), 0, 4
            while at < len(nodes) and bound[at] >= best.bar[item]:
                to = min(at + step, int(np.searchsorted(-bound, -best.bar[item], side="right")))
                found, score = docs.scores(nodes[at:to], dense)
                walk.scored += len(score)
                best.offer(item, score, docs.ids[found], docs.null[found])
                at, step = to, 2 * step

    if items.root is not None and len(docs.ids):
        visit(items.root, 0, np.arange(len(docs.levels[0])))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block, ``CHUNK`` documents or about ``ENTRIES`` terms at a time; rows come ordered by block."""
    held: list[pa.RecordBatch] = []
    rows = entries = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        block = b.column("block").to_numpy()
        ends = np.r_[0, np.cumsum(b.column("no").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))]
        at = 0
        while at < b.num_rows:
            to = min(at + int(np.searchsorted(block[at:], block[at], side="right")), at + CHUNK)
            to = min(to, max(at + 1, int(np.searchsorted(ends, ends[at] + ENTRIES, side="right")) - 1))
            if held and (held[0].column("block")[0].as_py() != block[at] or rows + to - at > CHUNK or entries + ends[to] - ends[at] > ENTRIES):
                yield joined()
                held, rows, entries = [], 0, 0
            held.append(b.slice(at, to - at))
            rows, entries, at = rows + to - at, entries + int(ends[to] - ends[at]), to
    if held:
        yield joined()


def best_documents(vectors: DataFrame, tree_path: str, vocab_path: str, n_docs: int, n_terms: int, k: int, bars_path: str | None = None) -> DataFrame:
    """``(block, item, score, id, is_null)``: a superset of every item's k best
    among ``vectors``, k an item and task at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, best = None, None

        def close() -> pa.RecordBatch:
            item = np.repeat(tree.item, [len(r) for r in best.rows])
            rows = np.concatenate([np.zeros((0, 3), np.int64), *best.rows])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(item), tree.block, np.int32)), pa.array(item), pa.array(rows[:, 0]), pa.array(rows[:, 1]),
                                               pa.array(rows[:, 2] != 0)], names=["block", "item", "score", "id", "is_null"])

        for b in chunks(batches):
            block = b.column("block")[0].as_py()
            if tree is None or tree.block != block:
                if tree is not None:
                    yield close()
                tree = load_tree(tree_path, vocab_path, block)
                bar = None
                if bars_path is not None:
                    t = read_shared(bars_path, block)
                    found = dict(zip(t.column("item").to_pylist(), t.column("bar").to_pylist(), strict=True))
                    bar = np.array([found.get(i, 0) for i in tree.item.tolist()], np.int64)
                best = Best(len(tree.item), k, bar)
            dual_search(tree, _doc_tree(b, n_docs, n_terms, tree.n_terms), best)
        if tree is not None:
            yield close()

    ordered = vectors.sortWithinPartitions("block")
    return ordered.mapInArrow(run, "block int, item bigint, score bigint, id bigint, is_null boolean")


def _doc_tree(b: pa.RecordBatch, n_docs: int, n_terms: int, vocab: int) -> DocTree:
    no, tf = b.column("no"), b.column("tf")
    sizes = no.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    m = length_norm(b.column("n").to_numpy(), n_docs, n_terms)
    times = tf.flatten().to_numpy()
    null = b.column("id").is_null().to_numpy(zero_copy_only=False)
    return DocTree(b.column("id").fill_null(LAST_ID).to_numpy(), null.astype(np.int64), np.r_[0, np.cumsum(sizes)], no.flatten().to_numpy().astype(np.int64),
                   times, saturated(times, np.repeat(m, sizes)), vocab)


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
           item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents of highest score
    above 0 of each item, ties by ascending document id (null ids last).

    Every distinct row of ``items`` is an item; repeated rows of one are one
    item, rows of one id with different texts are ranked each by itself. Every
    row of ``docs`` is a document, repeated rows are as many results. Null and
    empty texts have no term; an item without a result has no row, and empty
    tables give an empty result. Texts of any length are read whole, other
    columns are ignored."""
    spark = docs.sparkSession
    found = staged(blocks(staged(item_terms(items, item_id, item_text), "search-items"), block_words), "search-blocks")
    vocab_path, tree_path, bars_path = (shared_path(spark, f"search-{x}") for x in ("vocabulary", "tree", "bars"))
    vocabulary(found).repartition("block").sortWithinPartitions("block", "no").write.parquet(vocab_path)
    vectors = staged(doc_vectors(docs, vocab_path, doc_id, doc_text), "search-vectors")
    total = vectors.where("block = 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    n_docs, n_terms = total[0], total[1] or 0
    counts = vectors.select("block", F.explode("no").alias("no")).groupBy("block", "no").agg(F.count(F.lit(1)).alias("df"))
    item_trees(found, vocab_path, counts, n_docs).write.parquet(tree_path)

    usable = vectors.where(F.size("no") > 0)
    early = F.pmod(F.xxhash64("id", "n"), F.lit(FIRST).cast("long")) == 0
    by_score = Window.partitionBy("block", "item").orderBy(F.col("score").desc(), "is_null", "id")

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)

    first = staged(ranked(best_documents(usable.where(early), tree_path, vocab_path, n_docs, n_terms, k)).drop("rank"), "search-first")
    first.groupBy("block", "item").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(0).alias("bar")).write.parquet(bars_path)
    rest = best_documents(usable.where(~early), tree_path, vocab_path, n_docs, n_terms, k, bars_path)
    names = found.select("block", "item", "item_id")
    out = ranked(first.union(rest)).join(names, ["block", "item"])
    return out.select(F.col("item_id").alias(item_id), F.col("rank").cast("int").alias("rank"),
                      F.when(~F.col("is_null"), F.col("id")).alias(doc_id), "score")


#: DuckDB SQL for :func:`search` with its default parameters, over ``documents`` and ``benchmark``.
SEARCH_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(
       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, text, unnest(regexp_extract_all(
       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM (SELECT DISTINCT item_id, text FROM benchmark)),
f AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM d GROUP BY r, term),
l AS (SELECT r, sum(tf)::BIGINT AS n FROM f GROUP BY r),
c AS (SELECT count(*) AS total, sum(n)::BIGINT AS words FROM l),
w AS (SELECT term, floor(1000 * ln((2 * any_value(total) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY term),
i AS (SELECT item_id, text, term, count(*) AS times FROM q GROUP BY item_id, text, term),
s AS (
  SELECT item_id, text, r, any_value(doc_id) AS doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * total) // words))))::BIGINT AS score
  FROM i JOIN f USING (term) JOIN w USING (term) JOIN l USING (r), c GROUP BY item_id, text, r),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10
"""
