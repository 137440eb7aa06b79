"""SimHash near-duplicates by a binary trie self-join.

A text's fingerprint has 64 bits: a bit is 1 where more than half of the
text's shingle hashes have it set. Two fingerprints link when at most
``max_bits`` bits differ; documents in one connected component are one class.

The join walks binary tries: a pair of trie nodes carries the number of bits
in which their prefixes differ, children pairs add one where they take
different branches, and a pair is dropped as soon as the count passes the
budget. To spread the work, the 64 bits are cut into ``max_bits + 2`` blocks:
fingerprints within the budget agree on at least two whole blocks, so each
distinct fingerprint goes to one trie per pair of blocks (ten for three bits),
keyed by the two blocks' bits, and no linked pair is missed. All tries of a
partition are walked at the same time with numpy, in chunks of bounded size.
A task returns a spanning forest of the links it found (never more rows than
it got), from which the components are built, so a dense class does not
expand into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of_bytes, byte_rows, components, local_forest, need, small_batches, staged

SEED = 42
BITS = 64
#: Shingles counted and trie-node pairs expanded at a time.
SHINGLES_AT_ONCE = 1 << 16
PAIRS_AT_ONCE = 1 << 19
ROWS_AT_ONCE = 1 << 20


def fingerprint(text: bytes, shingle: int) -> int:
    """Fingerprint (unsigned) of a text's UTF-8 bytes; 0 without a word."""
    words = text.lower().split()  # bytes: lowers A-Z only and splits at ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, SHINGLES_AT_ONCE):
        part = words[at:at + SHINGLES_AT_ONCE + shingle - 1]
        if len(part) <= shingle:
            hashes = [digest(b" ".join(part), SEED)]
        else:
            hashes = [digest(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(shingle)), strict=False)]
        bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8)).reshape(len(hashes), BITS)
        counts += bits.sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)`` per row; ``fp`` is the fingerprint's 64 bits as a long."""
    small_batches(docs.sparkSession)
    rows = need(docs, [id_col, text_col]).toDF("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in batches_of_bytes(whole, "text"):
                fps = np.array([fingerprint(t, shingle) for t in byte_rows(b.column("text"))], np.uint64)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fp bigint")


def trie_links(key: np.ndarray, fp: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of one key whose fingerprints differ in 1 to
    ``budget`` bits, as a spanning forest ``(row, root row)``. Rows of one key
    hold distinct fingerprints."""
    order = np.lexsort((fp, key))
    k, f = key[order], fp[order]
    n = len(f)
    lab = np.arange(n)
    found_a: list[np.ndarray] = []
    found_b: list[np.ndarray] = []
    found = 0

    def merge() -> None:
        nonlocal lab, found
        if found:
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            child = np.flatnonzero(lab != np.arange(n))
            lab = local_forest(n, np.concatenate([a, child]), np.concatenate([b, lab[child]]))
            found_a.clear()
            found_b.clear()
            found = 0

    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if n else np.zeros(0, np.int64)
    end = np.r_[start[1:], n] if n else start
    wide = end - start > 1
    lo, hi = start[wide], end[wide]
    # a node is a range of sorted rows; a frontier holds node pairs and their differing bits
    stack = [(BITS - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int8))] if len(lo) else []
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > PAIRS_AT_ONCE:
            half = len(alo) // 2
            stack.append((bit, alo[half:], ahi[half:], blo[half:], bhi[half:], err[half:]))
            stack.append((bit, alo[:half], ahi[:half], blo[:half], bhi[:half], err[:half]))
            continue
        asp, bsp = _split(f, bit, alo, ahi), _split(f, bit, blo, bhi)
        same = alo == blo
        out = []
        for xl, xh, yl, yh, e, keep in (
            (alo, asp, blo, bsp, err, None), (asp, ahi, bsp, bhi, err, None),
            (alo, asp, bsp, bhi, err + 1, None), (asp, ahi, blo, bsp, err + 1, ~same),
        ):
            ok = (xl < xh) & (yl < yh) & (e <= budget)
            if keep is not None:
                ok &= keep  # the mirror image of a node with itself
            ok &= ~((xl == yl) & (xh - xl == 1))  # a row with itself
            out.append(tuple(v[ok] for v in (xl, xh, yl, yh, e)))
        xl, xh, yl, yh, e = (np.concatenate(v) for v in zip(*out, strict=True))
        leaf = (xl != yl) & (xh - xl == 1) & (yh - yl == 1)
        if leaf.any():
            a, b = xl[leaf], yl[leaf]
            near = np.bitwise_count(f[a] ^ f[b]) <= budget
            found_a.append(a[near])
            found_b.append(b[near])
            found += int(near.sum())
            xl, xh, yl, yh, e = (v[~leaf] for v in (xl, xh, yl, yh, e))
            if found > 4 * PAIRS_AT_ONCE:
                merge()
        if bit and len(xl):
            stack.append((bit - 1, xl, xh, yl, yh, e))
    merge()
    child = np.flatnonzero(lab != np.arange(n))
    return order[child], order[lab[child]]


def _split(f: np.ndarray, bit: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """First row of each range ``[lo, hi)`` with ``bit`` set; rows of a range are sorted and share the bits above."""
    one = np.uint64(1) << np.uint64(bit)
    l, h = lo.copy(), hi.copy()
    while True:
        open_ = l < h
        if not open_.any():
            return l
        mid = (l + h) // 2
        up = (f[np.minimum(mid, len(f) - 1)] & one) == 0
        l = np.where(open_ & up, mid + 1, l)
        h = np.where(open_ & ~up, mid, h)


def block_keys(fp: Column, max_bits: int) -> list[Column]:
    """One key per pair of blocks: the pair's number and both blocks' bits."""
    n = max_bits + 2
    edges = [round(i * BITS / n) for i in range(n + 1)]
    keys = []
    for no, (i, j) in enumerate(combinations(range(n), 2)):
        parts = []
        for x in (i, j):
            width = edges[x + 1] - edges[x]
            parts.append(F.shiftrightunsigned(fp, BITS - edges[x + 1]).bitwiseAND(F.lit((1 << width) - 1)))
        wj = edges[j + 1] - edges[j]
        wi = edges[i + 1] - edges[i]
        keys.append(F.shiftleft(F.lit(no).cast("long"), wi + wj).bitwiseOR(F.shiftleft(parts[0], wj)).bitwiseOR(parts[1]))
    return keys


def links(distinct: DataFrame, fp_col: str = "fp", max_bits: int = 3) -> DataFrame:
    """Spanning links ``(a, b)`` of distinct fingerprints within ``max_bits`` bits."""
    fp = F.col(fp_col).cast("long")
    keyed = distinct.select(F.explode(F.array(*block_keys(fp, max_bits))).alias("key"), fp.alias("fp"))
    dealt = keyed.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def walk(kf: np.ndarray) -> pa.RecordBatch:
            fps = kf[1].view(np.uint64)
            a, b = trie_links(kf[0], fps, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(kf[1][a]), pa.array(kf[1][b])], names=["a", "b"])

        for batch in batches:
            held.append(np.vstack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            rows += batch.num_rows
            if rows >= ROWS_AT_ONCE:  # cut where the key changes; keys are sorted
                kf = np.concatenate(held, axis=1)
                cut = int(np.searchsorted(kf[0], kf[0][-1]))
                held, rows = [kf[:, cut:]], kf.shape[1] - cut
                if cut:
                    yield walk(np.ascontiguousarray(kf[:, :cut]))
        if rows:
            yield walk(np.ascontiguousarray(np.concatenate(held, axis=1)))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 3) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` per row of ``docs``.

    ``component_id`` is the smallest id reachable over links, the row's own
    included. Null and empty texts have fingerprint zero and link like any
    other. Rows with a null id are returned with their class's smallest
    non-null id (null if the class has none). Repeated rows come back as often
    as they came. An empty table gives an empty result. Other columns are
    ignored.
    """
    fps = staged(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    reps = staged(fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-rep")
    comps = staged(components(links(reps, "fp", max_bits), kind="simhash-cc"), "simhash-comp")
    named = reps.join(comps, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    firsts = staged(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-first")
    named = staged(named.join(firsts, "root").select("fp", "component_id"), "simhash-named")
    hexa = F.lower(F.lpad(F.hex(F.col("fp")), 16, "0"))
    return fps.join(named, "fp").select(F.col("id").alias(id_col), hexa.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
               max_bits: int = 3) -> DataFrame:
    """``docs`` with one document of each class, that with the smallest id; of
    two texts of that id in one class the one with the smaller hash.

    A document is an id with its text: another text under a dropped id is not
    dropped with it. Rows without an id stay, repeated rows of the kept
    document stay together, null texts count as empty ones, an empty table
    gives an empty result, and other columns, of any name, come through."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    i, t = F.col(names[docs.columns.index(id_col)]), F.col(names[docs.columns.index(text_col)])
    which = F.struct(i.alias("id"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("h"))
    seen = rows.select(which.alias("which"), t.alias("text")).where("which.id IS NOT NULL")
    d = staged(near_duplicates(seen, "which", "text", shingle, max_bits), "simhash-classes")
    drop = staged(d.where("which <> component_id").select(F.col("which").alias("drop")).distinct(), "simhash-drop")
    return rows.join(drop, which == F.col("drop"), "left_anti").toDF(*docs.columns)
