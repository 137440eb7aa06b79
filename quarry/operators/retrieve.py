"""Exact cosine k-nearest-neighbour retrieval (dense and lexical).

Exact kNN must score every (query, corpus) pair, but it must not *emit*
every pair. Both sides are hashed into blocks of about ``block_rows`` rows
per group; the query block ``qb`` and corpus block ``cb`` meet in one
co-group ``(group, qb, cb)``, where numpy scores the block part by part (vectors as
matrix products, token counts as dense columns of frequent tokens and postings of
the others), drops what is beyond a query's k-th best so far, and keeps only the local
top-k of each query. A window ``row_number() <= k`` over the
``k * n_corpus_blocks`` candidates of each query gives the global answer
(Spark plans it with a ``WindowGroupLimit``).

Every co-group holds at most ``2 * block_rows`` rows, whatever the skew of
the group key (one agent holding a third of all rows gets more blocks, not
bigger ones). Ties are broken by ``(distance rounded to 1e-9, corpus id)``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import metric_tokens


def term_vectors(df: DataFrame, id_col: str, text: str | Column) -> DataFrame:
    """R1 offline default: ``(id, token, tf)`` term counts of metric tokens."""
    c = F.col(text) if isinstance(text, str) else text
    ex = df.select(F.col(id_col), F.explode(metric_tokens(c)).alias("token"))
    return ex.groupBy(id_col, "token").agg(F.count(F.lit(1)).cast("double").alias("tf"))


def sparse_rows(vectors: DataFrame, id_col: str, ids: DataFrame | None = None) -> DataFrame:
    """One row per document: ``toks``, ``ws`` (aligned arrays) and ``norm``.
    ``ids`` (optional) re-attaches documents without any token."""
    agg = vectors.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("token", "tf"))).alias("_v"),
        F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    agg = agg.select(id_col, F.col("_v.token").alias("toks"), F.col("_v.tf").alias("ws"), "norm")
    if ids is not None:
        agg = ids.select(id_col).join(agg, on=id_col, how="left").select(
            id_col, F.coalesce("toks", F.array().cast("array<string>")).alias("toks"),
            F.coalesce("ws", F.array().cast("array<double>")).alias("ws"),
            F.coalesce("norm", F.lit(0.0)).alias("norm"))
    return agg


def _blocks(q: DataFrame, c: DataFrame, q_id: str, c_id: str, group: str, block_rows: int, c_rows: int | None = None, spread: int = 1):
    qs = q.groupBy(group).agg(F.count(F.lit(1)).alias("_nq"))
    cs = c.groupBy(group).agg(F.count(F.lit(1)).alias("_nc"))
    few = F.least(F.lit(spread), F.ceil(F.col("_nc") / TILE_ROWS))  # a small corpus is dealt out too
    stats = qs.join(cs, on=group, how="inner").select(
        group, F.ceil(F.col("_nq") / block_rows).cast("int").alias("_qbs"),
        F.greatest(F.ceil(F.col("_nc") / (c_rows or block_rows)), few).cast("int").alias("_cbs"))
    # without a group the table has one row (broadcast is bounded); with a
    # group it has one row per group and AQE picks the join from its measured
    # size at run time
    s = stats if group != "_g" else F.broadcast(stats)
    qx = q.join(s, on=group, how="inner")
    qx = qx.withColumn("_qb", F.pmod(F.xxhash64(F.col(q_id)), F.col("_qbs")).cast("int"))
    qx = qx.withColumn("_cb", F.explode(F.sequence(F.lit(0), F.col("_cbs") - 1))).drop("_qbs", "_cbs")
    cx = c.join(s, on=group, how="inner")
    cx = cx.withColumn("_cb", F.pmod(F.xxhash64(F.col(c_id)), F.col("_cbs")).cast("int"))
    cx = cx.withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_qbs") - 1))).drop("_qbs", "_cbs")
    return qx, cx


TILE_ROWS = 1024
#: Rows of a block of queries and of the corpus. A row is copied to each block of the other side, so larger blocks copy less.
BLOCK_ROWS = {"dense": (16384, 16384), "sparse": (16384, 16384)}
#: Blocks of a lexical corpus at least, if they have a tile's rows each.
SPREAD = 8
#: Distances closer than 1e-9 can be ties.
TIES = 1e-8


class _Best:
    """The ``k`` best corpus rows of each query of a tile: by distance rounded to
    1e-9, ties by corpus id. A part of the corpus is compared with each query's
    weakest row so far, and only what can enter is sorted."""

    def __init__(self, n_q: int, k: int):
        self.k, self.limit, self.last = k, np.full(n_q, np.inf), np.full(n_q, np.iinfo(np.int64).max)
        self.q, self.c, self.d = np.array([], np.int64), np.array([], np.int64), np.array([], np.float64)

    def candidates(self, dist: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``dist`` (corpus rows x queries, ``slack`` near the exact distances) that can be among the best."""
        limit = self.limit
        if dist.shape[0] > self.k and np.isinf(limit).any():  # k rows lie below the k-th least, also of some rows
            some = dist[:max(256, self.k)]
            limit = np.minimum(limit, np.partition(some, self.k - 1, axis=0)[self.k - 1] + slack)
        near = np.flatnonzero(dist <= (limit + slack + TIES)[None, :].astype(dist.dtype))
        return np.divmod(near, max(1, dist.shape[1]))

    def add(self, q: np.ndarray, c: np.ndarray, d: np.ndarray) -> None:
        r, weakest = np.round(d, 9), np.round(self.limit[q], 9)
        keep = np.isfinite(d) & ((r < weakest) | (r == weakest) & (c < self.last[q]))
        q, c, d = (np.concatenate(x) for x in ((self.q, q[keep]), (self.c, c[keep]), (self.d, d[keep])))
        order = np.lexsort((c, np.round(d, 9), q))
        q, c, d = q[order], c[order], d[order]
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        full = place == self.k - 1
        self.limit[q[full]], self.last[q[full]] = d[full], c[full]
        self.q, self.c, self.d = (x[place < self.k] for x in (q, c, d))


class _Dense:
    """Vectors of one side of a block with their norms, and unit vectors in single precision."""

    def __init__(self, vectors):
        self.v = np.stack([np.asarray(x, dtype=np.float64) for x in vectors])
        self.n = np.sqrt((self.v * self.v).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = self.v / self.n[:, None]
        # without a finite positive norm: no direction, the exact distance decides
        self.unit = np.where(((self.n > 0) & np.isfinite(self.n))[:, None], unit, 0.0).astype(np.float32)

    def exact(self, i: np.ndarray, other: _Dense, j: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(i)), max(1, 4_000_000 // max(1, self.v.shape[1]))
        for s in range(0, len(i), step):  # bound the gathered vectors
            a, b = i[s:s + step], j[s:s + step]
            with np.errstate(divide="ignore", invalid="ignore"):
                den = self.n[a] * other.n[b]
                out[s:s + step] = 1.0 - np.where(den > 0, np.einsum("ij,ij->i", self.v[a], other.v[b]) / den, 0.0)
        return out


def _score_dense(qs: _Dense, q_ids: np.ndarray, cs: _Dense, c_ids: np.ndarray, k: int, part: int, exclude_self: bool):
    """``(q, c, d)`` of the block's best: single-precision products find the pairs that can be among them, these get exact distances."""
    slack = 1e-6 + 2e-7 * qs.unit.shape[1]  # rounding of a product of unit vectors
    endless = np.isinf(cs.n)
    for t in range(0, len(q_ids), TILE_ROWS):
        ids, unit = q_ids[t:t + TILE_ROWS], qs.unit[t:t + TILE_ROWS].T
        best = _Best(len(ids), k)
        for s in range(0, len(c_ids), part):
            own = c_ids[s:s + part]
            dist = 1 - cs.unit[s:s + part] @ unit
            if exclude_self:
                dist[own[:, None] == ids[None, :]] = np.inf
            if endless[s:s + part].any() or np.isinf(qs.n[t:t + TILE_ROWS]).any():
                j, i = np.nonzero(np.ones_like(dist, dtype=bool))
            else:
                j, i = best.candidates(dist, slack)
            d = qs.exact(i + t, cs, j + s)
            best.add(i, own[j], np.where(own[j] == ids[i], np.inf, d) if exclude_self else d)
        yield ids[best.q], best.c, best.d


#: Tokens that so large a share of a block's pairs have in common are multiplied as dense columns, the others by postings.
FREQUENT = 1 / 400
#: Cells of the dense columns of one side, and products of postings in memory at once.
CELLS, HITS = 1 << 24, 1 << 21


def _lists(rows: pa.Table, name: str) -> tuple[pa.Array, np.ndarray]:
    """A list column's values in one array, and each row's number of values."""
    col = rows.column(name).combine_chunks()
    return col.flatten(), pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


class _Sparse:
    """Token weights of one side of a block as entries ``(row, token number, weight)`` in this order, a token once a row."""

    def __init__(self, tok: np.ndarray, lens: np.ndarray, ws: np.ndarray, norm: np.ndarray, n_tokens: int):
        key, entry = np.unique(np.repeat(np.arange(len(lens)), lens) * n_tokens + tok, return_inverse=True)
        self.n, self.w = norm, np.bincount(entry, ws, len(key))
        self.row, self.tok = np.divmod(key, n_tokens)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            length = np.sqrt(np.bincount(self.row, self.w * self.w, len(lens)))
            self.scale = np.where(norm > 0, 1 / norm, 0.0)
        self.longest = length.max()
        #: Whether single precision can screen these rows: norms that are theirs, or zero, and not extreme.
        self.plain = bool(((norm == 0) | (norm > 1e-15) & (norm < 1e15) & (length <= 1.001 * norm)).all())

    def whole(self) -> bool:
        return bool(np.isfinite(self.w).all() and (self.w == np.floor(self.w)).all())

    def columns(self, place: np.ndarray, n: int, kind: type) -> np.ndarray:
        """Weights of the tokens with a ``place``, as a matrix of ``n`` columns."""
        out, at = np.zeros((len(self.n), n), kind), place[self.tok]
        out[self.row[at >= 0], at[at >= 0]] = self.w[at >= 0]
        return out

    def only(self, keep: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, tokens and weights of the entries of ``keep``, and where each row's begin."""
        at = np.flatnonzero(keep[self.tok])
        return self.row[at], self.tok[at], self.w[at].astype(kind), np.searchsorted(self.row[at], np.arange(len(self.n) + 1))


def _add_postings(dot: np.ndarray, row: np.ndarray, tok: np.ndarray, w: np.ndarray, first: np.ndarray, q_row: np.ndarray, q_w: np.ndarray) -> None:
    """Add to ``dot`` (corpus rows x queries) the products of the corpus' entries with the queries' postings,
    which begin at ``first`` of the token."""
    n = first[tok + 1] - first[tok]
    met = np.flatnonzero(n)
    row, lo, w, n = row[met] * dot.shape[1], first[tok[met]], w[met], n[met]
    flat, done = dot.reshape(-1), np.cumsum(n)
    ends = np.searchsorted(done, np.arange(HITS, (done[-1] if len(done) else 0) + HITS, HITS), side="right")
    s = 0
    for e in [*ends[:-1], len(n)]:
        if e > s:
            c = n[s:e]
            at = np.arange(c.sum()) + np.repeat(lo[s:e] - np.cumsum(c) + c, c)
            np.add.at(flat, np.repeat(row[s:e], c) + q_row[at], np.repeat(w[s:e], c) * q_w[at])
            s = e


def _score_sparse(q: pa.Table, c: pa.Table, k: int, part: int, exclude_self: bool):
    """``(q, c, d)`` of the block's best, as :func:`_score_dense`. Weights of tokens that many pairs share are multiplied
    as dense columns, the others by postings; in single precision if they are whole numbers whose products it holds exactly."""
    (q_tok, q_len), (c_tok, c_len) = _lists(q, "toks"), _lists(c, "toks")
    tokens = pa.concat_arrays([q_tok, c_tok]).dictionary_encode(null_encoding="encode")
    n_tokens, tok = max(1, len(tokens.dictionary)), tokens.indices.to_numpy().astype(np.int64)
    qs, cs = (_Sparse(t, lens, _lists(x, "ws")[0].to_numpy(zero_copy_only=False), x.column("norm").to_numpy(), n_tokens)
              for t, lens, x in ((tok[:len(q_tok)], q_len, q), (tok[len(q_tok):], c_len, c)))
    q_ids, c_ids = (pc.fill_null(x.column(n), np.iinfo(np.int64).min).to_numpy() for x, n in ((q, "_qid"), (c, "_cid")))
    kind = np.float32 if qs.whole() and cs.whole() and qs.longest * cs.longest < 1 << 24 else np.float64
    pairs = np.bincount(qs.tok, minlength=n_tokens) * np.bincount(cs.tok, minlength=n_tokens)
    dense = pairs > FREQUENT * len(q_ids) * len(c_ids)
    for x in (qs, cs):  # weights that aren't finite count only where both rows hold the token
        dense[x.tok[~np.isfinite(x.w)]] = False
    frequent = np.argsort(np.where(dense, -pairs, 1), kind="stable")[:min(dense.sum(), CELLS // max(len(q_ids), len(c_ids)))]
    place = np.full(n_tokens, -1)
    place[frequent] = np.arange(len(frequent))
    q_cols, c_cols = (x.columns(place, len(frequent), kind) for x in (qs, cs))
    (qr, qt, qw, q_at), (cr, ct, cw, c_at) = (x.only((pairs > 0) & (place < 0), kind) for x in (qs, cs))
    plain = qs.plain and cs.plain

    def exact(dots, c_norm, q_norm):
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            den = c_norm * q_norm
            return 1.0 - np.where(den > 0, dots / den, 0.0)

    for t in range(0, len(q_ids), TILE_ROWS):
        ids, q_norm = q_ids[t:t + TILE_ROWS], qs.n[t:t + TILE_ROWS]
        mine = slice(q_at[t], q_at[t + len(ids)])
        order = np.argsort(qt[mine], kind="stable")
        q_row, q_w = qr[mine][order] - t, qw[mine][order]
        first = np.concatenate(([0], np.cumsum(np.bincount(qt[mine], minlength=n_tokens))))
        best = _Best(len(ids), k)
        for s in range(0, len(c_ids), part):
            own, c_norm = c_ids[s:s + part], cs.n[s:s + part]
            dot = c_cols[s:s + part] @ q_cols[t:t + TILE_ROWS].T
            theirs = slice(c_at[s], c_at[s + len(own)])
            with np.errstate(invalid="ignore", over="ignore"):
                _add_postings(dot, cr[theirs] - s, ct[theirs], cw[theirs], first, q_row, q_w)
            if plain:
                dist = dot * cs.scale[s:s + part, None].astype(kind)
                dist *= qs.scale[t:t + TILE_ROWS].astype(kind)
                np.subtract(1, dist, out=dist)
            else:
                dist = exact(dot, c_norm[:, None], q_norm[None, :])
            if exclude_self:
                dist[own[:, None] == ids[None, :]] = np.inf
            j, i = best.candidates(dist, 1e-6 if plain else 0.0)
            d = exact(dot[j, i].astype(np.float64), c_norm[j], q_norm[i])
            best.add(i, own[j], np.where(own[j] == ids[i], np.inf, d) if exclude_self else d)
        yield ids[best.q], best.c, best.d


def knn(queries: DataFrame, corpus: DataFrame, q_id: str, c_id: str, k: int = 3,
        kind: str = "dense", vec: str = "embedding", group: str | None = None,
        exclude_self: bool = False, block_rows: int | None = None, c_block_rows: int = 1024,
        materialize: bool = True) -> DataFrame:
    """Exact cosine kNN. ``kind='dense'``: ``vec`` is an ``array<float>``
    column. ``kind='sparse'``: rows carry ``toks``, ``ws`` and ``norm`` (see
    :func:`sparse_rows`). Returns ``(group?, q_id, c_id, distance, rank)``
    with ``distance = 1 - cos``; the corpus id column is renamed
    ``nbr_id``."""
    g = group or "_g"
    q = queries if group else queries.withColumn("_g", F.lit(0))
    c = corpus if group else corpus.withColumn("_g", F.lit(0))
    if kind == "dense":
        q = q.select(g, F.col(q_id).alias("_qid"), F.col(vec).alias("_v"))
        c = c.select(g, F.col(c_id).alias("_cid"), F.col(vec).alias("_v"))
    else:
        q = q.select(g, F.col(q_id).alias("_qid"), "toks", "ws", "norm")
        c = c.select(g, F.col(c_id).alias("_cid"), "toks", "ws", "norm")
    q_rows, c_rows = (block_rows, block_rows) if block_rows else BLOCK_ROWS[kind]
    qx, cx = _blocks(q, c, "_qid", "_cid", g, q_rows, c_rows, 1 if block_rows or kind == "dense" else SPREAD)
    gtype = queries.schema[group].dataType if group else T.IntegerType()
    schema = T.StructType([T.StructField(g, gtype), T.StructField("_qid", T.LongType()),
                           T.StructField("_cid", T.LongType()), T.StructField("distance", T.DoubleType())])

    def score(qdf: pd.DataFrame, cdf: pd.DataFrame) -> pd.DataFrame:
        if qdf.empty or cdf.empty:
            return pd.DataFrame({g: pd.Series([], dtype=object), "_qid": pd.Series([], dtype="int64"),
                                 "_cid": pd.Series([], dtype="int64"), "distance": pd.Series([], dtype="float64")})
        q_ids, c_ids = qdf["_qid"].to_numpy(np.int64), cdf["_cid"].to_numpy(np.int64)
        outs = list(_score_dense(_Dense(qdf["_v"]), q_ids, _Dense(cdf["_v"]), c_ids, k, c_block_rows, exclude_self))
        res = pd.DataFrame({n: np.concatenate(x) for n, x in zip(("_qid", "_cid", "distance"), zip(*outs, strict=True), strict=True)})
        res.insert(0, g, qdf[g].iloc[0])
        return res

    def score_arrow(qt: pa.Table, ct: pa.Table) -> pa.Table:
        outs = list(_score_sparse(qt, ct, k, c_block_rows, exclude_self)) if len(qt) and len(ct) else []
        found = [np.concatenate(x) for x in zip(*outs, strict=True)] or [np.array([], t) for t in (np.int64, np.int64, np.float64)]
        of = qt if len(qt) else ct
        return pa.table({g: pa.repeat(of.column(g)[0], len(found[0])), "_qid": found[0], "_cid": found[1], "distance": found[2]})

    met = qx.groupBy(g, "_qb", "_cb").cogroup(cx.groupBy(g, "_qb", "_cb"))
    cand = met.applyInPandas(score, schema) if kind == "dense" else met.applyInArrow(score_arrow, schema)
    w = Window.partitionBy(g, "_qid").orderBy(F.round("distance", 9), "_cid")
    top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out = top.select(*([g] if group else []), F.col("_qid").alias(q_id), F.col("_cid").alias("nbr_id"),
                     "distance", F.col("rank").cast("int").alias("rank"))
    # k rows per query: small, and costly to recompute (all-pairs scoring)
    return out.checkpoint(eager=True) if materialize else out


def gather(neighbors: DataFrame, corpus: DataFrame, q_id: str, c_id: str, value: str,
           out: str = "context", sep: str = "\n") -> DataFrame:
    """Values of the neighbours in rank order joined by ``sep``. The
    neighbour table has ``k`` rows per query; the join is on corpus id."""
    vals = corpus.select(F.col(c_id).alias("nbr_id"), F.col(value).alias("_val"))
    j = neighbors.join(vals, on="nbr_id", how="inner")
    agg = j.groupBy(q_id).agg(F.sort_array(F.collect_list(F.struct("rank", "_val"))).alias("_r"))
    return agg.select(q_id, F.array_join(F.transform("_r", lambda r: r["_val"]), sep).alias(out),
                      F.col("_r")[0]["_val"].alias("top1"))


def embed_with(df: DataFrame, text: str, encoder_factory, out: str = "embedding", batch_size: int = 256) -> DataFrame:
    """R1 with a user sentence encoder: an Arrow batch UDF; the encoder is
    built once per Python worker (``encoder_factory()`` -> object with
    ``encode(list[str]) -> array (n, d)``). The vectors feed :func:`knn`
    with ``kind='dense'``."""
    state: dict = {}

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def enc(s: pd.Series) -> pd.Series:
        if "m" not in state:
            state["m"] = encoder_factory()
        m = state["m"]
        out_rows = []
        vals = s.tolist()
        for i in range(0, len(vals), batch_size):
            chunk = [x if x is not None else "" for x in vals[i:i + batch_size]]
            vecs = np.asarray(m.encode(chunk), dtype=np.float32)
            out_rows.extend(v.tolist() for v in vecs)
        return pd.Series(out_rows)

    return df.withColumn(out, enc(F.col(text)))
