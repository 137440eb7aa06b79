"""Quality classifier: random-indexing word vectors, pooled per document, and a
two-layer numpy network with temperature-calibrated probabilities.

1. **Random indexing over all documents.** Every token has a sparse ternary
   index vector drawn from its hash. A token's context vector is the sum of the
   index vectors of its neighbours (``window`` to either side) over the whole
   corpus. Tokens are hashed into ``buckets`` rows and word shapes (case and
   length class) get rows of their own, so the table's size is fixed while the
   sums cover every occurrence in every text. Sums are integers: their order
   doesn't matter and a task that runs again gives the same table.
2. **Pooling.** A document's features are the means of its tokens' and of its
   shapes' context vectors (scaled to unit length).
3. **Network.** One hidden layer, fitted on at most ``sample`` labelled rows
   (the only bounded part), the rows with the smallest hash of their id. A
   fifth of them is held back from fitting and sets the softmax temperature.

Scores use the text alone: no label, language, source or id.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of_bytes, need, small_batches

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
DIM = 48
BUCKETS = 8192
SHAPES = 64
WINDOW = 2
NONZERO = 2
#: Labelled rows the network is fitted on at most (calibration rows included).
SAMPLE = 20_000
HIDDEN = 32
#: Tokens whose vectors are gathered at a time; token ids remembered by a worker.
TOKENS_AT_ONCE = 1 << 18
REMEMBERED = 1 << 18
ROWS = BUCKETS + SHAPES


class _Tokens(dict):
    """Token -> bucket * SHAPES + shape, filled as tokens are met."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        first = token[0]
        if first.isalpha():
            case = 0 if token.islower() else 1 if token.isupper() else 2 if token[1:].islower() else 3
            if len(token) == 1 and case == 1:
                case = 2
            shape = case * 8 + min(7, (len(token) + 1) // 2)
        elif first.isdigit():
            token, shape = "0" * min(4, len(token)), 32 + min(7, len(token))
        else:
            shape = 40 + min(7, len(token))
        self[token] = v = zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS * SHAPES + shape
        return v


_TOKENS = _Tokens()


def token_ids(text: str) -> np.ndarray:
    return np.fromiter(map(_TOKENS.__getitem__, TOKEN.findall(text)), np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs, ``(ROWS, NONZERO)`` each, of the nonzero elements
    of the index vectors; a fixed function of the row number."""
    x = np.arange(ROWS * NONZERO, dtype=np.uint64) + np.uint64(1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    pos = (x % np.uint64(DIM)).astype(np.int64).reshape(ROWS, NONZERO)
    sign = np.where((x >> np.uint64(40)) & np.uint64(1), 1, -1).astype(np.int8).reshape(ROWS, NONZERO)
    return pos, sign


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows with their token ids, about ``TOKENS_AT_ONCE`` tokens (or one text) at a time."""
    for whole in batches:
        for b in batches_of_bytes(whole, "text", 1 << 20):
            yield b, [token_ids(t or "") for t in b.column("text").to_pylist()]


def context_vectors(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(row, c0 .. )``: summed context vectors over all texts."""
    small_batches(docs.sparkSession)
    texts = need(docs, [text_col]).toDF("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, sign = index_vectors()
        acc = np.zeros(ROWS * DIM)
        for _, texts_ids in _groups(batches):
            gap = np.full(WINDOW, -1)
            flat = np.concatenate([x for t in texts_ids for x in (t, gap)]) if texts_ids else gap
            for lo in range(0, len(flat), TOKENS_AT_ONCE):  # a window reaches over the cut
                part = flat[max(0, lo - WINDOW):lo + TOKENS_AT_ONCE]
                skip = lo - max(0, lo - WINDOW)
                for off in range(1, WINDOW + 1):
                    # each pair is counted where its right token lies
                    right = np.arange(max(skip, off), len(part))
                    l, r = part[right - off], part[right]
                    ok = (l >= 0) & (r >= 0)
                    l, r = l[ok], r[ok]
                    _add(acc, l, r, pos, sign)
                    _add(acc, r, l, pos, sign)
        _TOKENS.clear()
        table = acc.reshape(ROWS, DIM).astype(np.int64)
        used = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(table[used, j]) for j in range(DIM))],
                                         names=["row", *(f"c{j}" for j in range(DIM))])

    cols = [f"c{j}" for j in range(DIM)]
    parts = texts.mapInArrow(run, "row bigint, " + ", ".join(f"{c} bigint" for c in cols))
    return parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in cols])


def _add(acc: np.ndarray, target: np.ndarray, other: np.ndarray, pos: np.ndarray, sign: np.ndarray) -> None:
    """Add the index vectors of ``other`` (its token and its shape) to ``target``'s two rows."""
    bucket, shape = target // SHAPES, BUCKETS + target % SHAPES
    for rows, others in ((bucket, other // SHAPES), (shape, BUCKETS + other % SHAPES)):
        base = rows * DIM
        for z in range(NONZERO):
            acc += np.bincount(base + pos[others, z], weights=sign[others, z], minlength=len(acc))


@dataclass
class Model:
    """Word vectors (``ROWS`` x ``DIM``) and the network; a few MB whatever the corpus' size."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        # row by row products in a fixed order: a row's score doesn't depend on its batch
        h = np.tanh(((x - self.mean) / self.scale).astype(np.float64) @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.logits(x) / self.temperature, -60, 60)
        return np.round(1 / (1 + np.exp(-z)), 9)


def pooled(texts_ids: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Mean token vector and mean shape vector of each text; zeros without a token."""
    out = np.zeros((len(texts_ids), 2 * DIM))
    for i, t in enumerate(texts_ids):
        for lo in range(0, len(t), TOKENS_AT_ONCE):
            p = t[lo:lo + TOKENS_AT_ONCE]
            out[i, :DIM] += vectors[p // SHAPES].sum(0, dtype=np.float64)
            out[i, DIM:] += np.bincount(p % SHAPES, minlength=SHAPES) @ vectors[BUCKETS:].astype(np.float64)
        out[i] /= max(1, len(t))
    return out


def features(docs: DataFrame, vectors: np.ndarray, id_col: str, text_col: str, extra: list[str]) -> DataFrame:
    rows = need(docs, [id_col, *extra, text_col]).toDF("id", *extra, "text")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ids in _groups(batches):
            x = pooled(ids, shared.value)
            arrays = [b.column(c) for c in ("id", *extra)]
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 2 * DIM).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*arrays, flat], names=["id", *extra, "x"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", *extra))
    return rows.mapInArrow(run, f"{kinds}, x array<double>")


def unit_rows(sums: DataFrame) -> np.ndarray:
    """The fixed-size table of word vectors (``ROWS`` rows at most), rows scaled to unit length."""
    got = sums.toPandas()
    table = np.zeros((ROWS, DIM))
    table[got["row"].to_numpy()] = got[[f"c{j}" for j in range(DIM)]].to_numpy(dtype=np.float64)
    length = np.sqrt((table * table).sum(1, keepdims=True))
    return (table / np.maximum(length, 1)).astype(np.float32)


def train_network(x: np.ndarray, y: np.ndarray, hold: np.ndarray, vectors: np.ndarray, epochs: int = 60) -> Model:
    """Two-layer network by Adam on the rows not held, temperature on the held ones."""
    rng = np.random.default_rng(7)
    fit = ~hold if (~hold).any() else np.ones(len(y), bool)
    mean = x[fit].mean(0) if len(y) else np.zeros(2 * DIM)
    scale = x[fit].std(0) + 1e-6 if len(y) else np.ones(2 * DIM)
    z, t = (x - mean) / scale, y.astype(np.float64)
    p = [rng.normal(0, 1 / np.sqrt(2 * DIM), (2 * DIM, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    rows = np.flatnonzero(fit) if len(y) else np.zeros(0, int)
    for epoch in range(epochs if len(rows) else 0):
        rng.shuffle(rows)
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for at in range(0, len(rows), 128):
            r = rows[at:at + 128]
            h = np.tanh(z[r] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - t[r]) / len(r)
            dh = np.outer(d, p[2]) * (1 - h * h)
            g = [z[r].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            step += 1
            for k in range(4):
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] * g[k]
                p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    model = Model(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if hold.any():
        logit, target = model.logits(x[hold]), t[hold]
        grid = np.geomspace(0.25, 8, 81)
        loss = [np.mean(np.logaddexp(0, logit / s) - target * logit / s) for s in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample: int = SAMPLE) -> Model:
    """Model from all ``docs`` (word vectors) and at most ``sample`` rows of
    ``labels`` (network). Labels other than 0 and 1 or with a null id are
    ignored; of several labels of an id the smallest counts. Without any
    labelled row every text scores 0.5."""
    vectors = unit_rows(context_vectors(docs, text_col))
    few = (need(labels, [id_col, label_col]).toDF("_id", "_y").where("_id IS NOT NULL AND _y IN (0, 1)")
           .groupBy("_id").agg(F.min("_y").cast("int").alias("_y"))
           .withColumn("_h", F.md5(F.col("_id").cast("string"))).orderBy("_h", "_id").limit(sample))
    # at most `sample` rows of two numbers and a hash: a proven bound for the broadcast
    rows = need(docs, [id_col, text_col]).join(F.broadcast(few), F.col(id_col) == F.col("_id"))
    got = features(rows, vectors, id_col, text_col, ["_y", "_h"]).dropDuplicates(["id"]).toPandas().sort_values("_h")
    if not len(got):
        zero = np.zeros(2 * DIM)
        return Model(vectors, zero, zero + 1, np.zeros((2 * DIM, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)
    x, y = np.stack(got["x"].to_numpy()), got["_y"].to_numpy()
    hold = got["_h"].str[-2:].map(lambda s: int(s, 16) % 5 == 0).to_numpy()
    return train_network(x, y, hold, vectors)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score",
          columns: list[str] | None = None, at_least: float | None = None) -> DataFrame:
    """``columns`` (all of them by default, but one named ``score_col``) and
    ``score_col``, the probability of label 1. ``at_least`` keeps only rows
    with that score or more, in the same pass. Null and empty texts get the
    score of a document without tokens."""
    cols = [c for c in (columns or docs.columns) if c != score_col]
    names, hidden = [f"c{i}" for i in range(len(cols))], "text"
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(cols, names, strict=True)], F.col(f"`{text_col}`").alias(hidden))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for whole in batches:
            for b in batches_of_bytes(whole, hidden, 1 << 20):
                ids = [token_ids(t or "") for t in b.column(hidden).to_pylist()]
                s = net.scores(pooled(ids, net.vectors))
                out = pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(cols))), pa.array(s)], names=[*names, "score"])
                yield out if at_least is None else out.filter(pa.array(s >= at_least))
        _TOKENS.clear()

    kinds = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in names)
    return rows.mapInArrow(run, f"{kinds}score double").toDF(*cols, score_col)


def fold(id_col: str | Column) -> Column:
    """crc32 of the id as text, modulo 3 (1 marks the held-out rows); null for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % 3
