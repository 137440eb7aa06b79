"""Vector code compression: product codes by slice-and-intersect bitmasks.

A vector's components become integers, it is cut into equal parts, and each
part is replaced by the index of the nearest entry of the part's codebook. The
codebooks begin as the parts of the first vectors and are refined by rounds of
assignment and means.

The nearest entry is found without measuring all of them. For every dimension
of a part the codebook's coordinates are sorted, and position ``j`` of the
sorted list carries a bitmask of the entries before it. A box of radius ``r``
around a point selects one range of positions per dimension; the exclusive or
of the two masks at the range's ends are the entries inside it, and the AND
over the dimensions are exactly the entries of the box. If the best entry of
the box is no farther than ``r``, it is the nearest of all, since any nearer
one would lie in the box too. A point whose box is empty or whose best entry
is farther away is tried again: with the distance of that entry as radius,
after which it is certain, or with twice the radius. The first radius is the
median distance over the first points of a batch; it decides the work, never
the result.

A round sums the parts of each entry inside the tasks, in integers, so a few
rows a task are shuffled and a task that runs again gives the same codebook.
Only codebooks (``entries`` vectors) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, staged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components saturate here, so that sums of squares stay inside 64 bits.
LARGEST = 1 << 26
#: Points (rows) searched at a time, and points that set the first radius.
ROWS_AT_ONCE, FIRST_POINTS = 1 << 14, 256
#: Shares of a label's rows, so that a label of a third of all rows isn't one task's.
SALTS = 16


def whole_rows(vectors: pa.Array, dim: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """``(kept, rows)``: which vectors hold finite components only, and their
    integers ``floor(scale * x)``, filled with zeros up to ``dim``."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components are NaN
    row = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    kept = size >= 0
    kept[row[~np.isfinite(flat)]] = False
    out = np.zeros((len(size), dim), np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), np.maximum(size, 0))
    ok = kept[row]
    with np.errstate(over="ignore"):
        out[row[ok], place[ok]] = np.clip(np.floor(flat[ok] * float(scale)), -LARGEST, LARGEST).astype(np.int64)
    return kept, out[kept]


class Slices:
    """Codebook of one part, ``entries`` x ``width`` integers, with its sorted coordinates and prefix masks."""

    def __init__(self, book: np.ndarray):
        self.book = book
        order = np.argsort(book, axis=0, kind="stable")
        self.sorted = np.take_along_axis(book, order, 0)
        words = max(1, -(-len(book) // 64))
        self.masks = np.zeros((words, len(book) + 1, book.shape[1]), np.uint64)
        for w in range(words):
            bit = np.where(order // 64 == w, np.uint64(1) << (order % 64).astype(np.uint64), np.uint64(0))
            self.masks[w, 1:] = np.bitwise_or.accumulate(bit, axis=0)

    def box(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Bitmasks, ``words`` x points, of the entries within ``radius`` in every dimension."""
        inside = None
        for d in range(points.shape[1]):
            lo = np.searchsorted(self.sorted[:, d], points[:, d] - radius, "left")
            hi = np.searchsorted(self.sorted[:, d], points[:, d] + radius, "right")
            here = self.masks[:, hi, d] ^ self.masks[:, lo, d]
            inside = here if inside is None else inside & here
        return inside

    def best_in(self, points: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each mask, the lowest index of equals, and its squared distance; -1 for an empty mask."""
        best, dist = np.full(len(points), -1), np.full(len(points), np.iinfo(np.int64).max)
        for w in range(len(inside)):
            rows, left = np.arange(len(points)), inside[w]
            while True:
                some = left != 0
                if not some.all():
                    rows, left = rows[some], left[some]
                if not len(rows):
                    break
                low = left & (~left + np.uint64(1))
                entry = np.frexp(low.astype(np.float64))[1] - 1 + 64 * w  # a power of two: its exponent is the index
                gap = points[rows] - self.book[entry]
                far = np.einsum("ij,ij->i", gap, gap)
                nearer = far < dist[rows]  # indices ascend: of equals the first stays
                dist[rows[nearer]], best[rows[nearer]] = far[nearer], entry[nearer]
                left = left ^ low
        return best, dist

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties to the lower) and squared distance of every point."""
        out, far = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        if not len(points):
            return out, far
        few = points[:FIRST_POINTS]
        everything = np.full((len(self.masks), len(few)), ~np.uint64(0)) & self.masks[:, -1:, 0]
        radius = np.full(len(points), np.ceil(np.sqrt(np.median(self.best_in(few, everything)[1].astype(np.float64)))) + 1, np.int64)
        left = np.arange(len(points))
        while len(left):
            r = radius[left]
            best, dist = self.best_in(points[left], self.box(points[left], r))
            sure = (best >= 0) & (dist <= r * r)
            out[left[sure]], far[left[sure]] = best[sure], dist[sure]
            # the box of an entry's distance holds every nearer entry; an empty box is doubled
            reach = np.ceil(np.sqrt(np.where(best >= 0, dist, 0).astype(np.float64))).astype(np.int64) + 1
            radius[left] = np.where(best >= 0, reach, 2 * r)
            left = left[~sure]
        return out, far


def assign(rows: np.ndarray, slices: list[Slices]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and squared distances added up over the parts."""
    width = rows.shape[1] // len(slices)
    code = np.empty((len(rows), len(slices)), np.int64)
    error = np.zeros(len(rows), np.int64)
    for p, s in enumerate(slices):
        for at in range(0, len(rows), ROWS_AT_ONCE):
            part = rows[at:at + ROWS_AT_ONCE, p * width:(p + 1) * width]
            code[at:at + ROWS_AT_ONCE, p], far = s.nearest(np.ascontiguousarray(part))
            error[at:at + ROWS_AT_ONCE] += far
    return code, error


def _means(vectors: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """``books`` (parts x entries x width) after one round: means of the assigned parts, rounded down."""
    parts, entries, width = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)  # `entries` vectors, whatever the table's size
    names = [f"s{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in shared.value]
        n, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for b in batches:
            _, rows = whole_rows(b.column("vec"), parts * width, scale)
            code, _ = assign(rows, slices)
            cell = (code + np.arange(parts) * entries).ravel()
            n += np.bincount(cell, minlength=len(n))
            np.add.at(total, cell, rows.reshape(-1, width))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), *(pa.array(total[used, j]) for j in range(width))], names=["cell", "n", *names])

    sums = vectors.select("vec").mapInArrow(run, "cell bigint, n bigint, " + ", ".join(f"{c} bigint" for c in names))
    # decimals: sums of any number of rows are whole
    got = sums.groupBy("cell").agg(F.sum("n"), *[F.sum(F.col(c).cast("decimal(20,0)")) for c in names]).collect()
    out = books.reshape(parts * entries, width).copy()
    for cell, n, *total in got:
        out[cell] = [int(t) // n for t in total]
    return out.reshape(books.shape)


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
              id_col: str = "vec_id", vec_col: str = "embedding") -> np.ndarray:
    """Codebooks, parts x entries x width, after ``rounds`` rounds; no entry
    for a table without a usable vector. They begin as the vectors of the
    ``entries`` smallest ids (null ids last, equal ids by their components)."""
    v = need(vectors, [id_col, vec_col]).toDF("id", "vec")
    dim = v.agg(F.max(F.size("vec"))).first()[0] or 0
    width = max(1, -(-dim // parts))
    usable = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    seed = v.where(F.col("vec").isNotNull() & usable).orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).toArrow()
    _, rows = whole_rows(seed.column("vec"), parts * width, scale)
    books = np.ascontiguousarray(rows.reshape(len(rows), parts, width).transpose(1, 0, 2))
    for _ in range(rounds if len(rows) else 0):
        books = _means(v, books, scale)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray, scale: int = SCALE, vec_col: str = "embedding", columns: list[str] | None = None,
           code_col: str = "code", error_col: str = "error") -> DataFrame:
    """``columns`` (all by default), ``code_col`` (entry indices in part order,
    two hex digits each, four beyond 256 entries) and ``error_col`` of the
    usable vectors: null vectors and those with a null or non-finite component
    are left out."""
    parts, entries, width = books.shape
    cols = [c for c in (columns if columns is not None else vectors.columns) if c not in (code_col, error_col)]
    names = [f"c{i}" for i in range(len(cols))]
    rows = vectors.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(cols, names, strict=True)], F.col(f"`{vec_col}`").alias("vec"))
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    kind = np.uint8 if entries <= 256 else np.dtype(">u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in shared.value]
        for b in batches:
            kept, whole = whole_rows(b.column("vec"), parts * width, scale)
            if not entries or not kept.any():
                continue
            code, error = assign(whole, slices)
            few = b.filter(pa.array(kept))
            hexa = [r.tobytes().hex() for r in code.astype(kind)]
            yield pa.RecordBatch.from_arrays([*(few.column(i) for i in range(len(cols))), pa.array(hexa, pa.string()), pa.array(error)],
                                             names=[*names, "code", "error"])

    kinds = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in names)
    return rows.mapInArrow(run, f"{kinds}code string, error bigint").toDF(*cols, code_col, error_col)


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE, code_col: str = "code", vec_col: str = "decoded") -> DataFrame:
    """``codes`` with ``vec_col``, the vectors that their codes stand for (entry integers over ``scale``)."""
    parts, entries, width = books.shape
    digits = 2 if entries <= 256 else 4
    lists = F.array(*[F.array(*[F.array(*[F.lit(float(x) / scale) for x in e]) for e in b]) for b in books])
    pieces = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.get(
        F.get(lists, p), F.conv(F.substring(F.col(f"`{code_col}`"), p * digits + 1, F.lit(digits)), 16, 10).cast("int")))
    return codes.withColumn(vec_col, F.flatten(pieces))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id",
             vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id_col, code, error, label_error, codebooks_sha256)`` per usable vector.

    ``error`` is the squared distance to what the code stands for, in integers;
    ``label_error`` adds it up over the rows of the same label (null labels are
    one label). Null vectors and those with a null or non-finite component are
    left out; vectors shorter than the longest one, or a length that the parts
    don't divide, are filled with zeros; integers beyond ``LARGEST`` saturate.
    Fewer vectors than ``entries`` give smaller codebooks, repeated rows and
    null ids stay, equal distances go to the lower index, an empty table gives
    an empty result, and other columns are ignored."""
    v = need(vectors, [id_col, vec_col, label_col]).toDF("id", "vec", "label")
    books = codebooks(v, parts, entries, rounds, scale, "id", "vec")
    coded = staged(encode(v, books, scale, "vec", ["id", "label"]), "codes")
    salt = F.pmod(F.xxhash64("id", "code"), F.lit(SALTS).cast("long")).cast("int")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("_l"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    out = coded.withColumn("_salt", salt).join(sums, F.col("label").eqNullSafe(F.col("_l")) & (F.col("_salt") == F.col("_s")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assign_sql(name: str, book: str) -> str:
    """Nearest entries of all parts in one codebook table, by plain comparison with every entry."""
    return f"""{name} AS (
  SELECT i, p, any_value(v) AS v, arg_min(e, far * 100 + e) AS e, min(far) AS far FROM (
    SELECT i, part.p, part.v, e, list_sum(list_transform(list_zip(part.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far
    FROM part JOIN {book} AS b USING (p)) GROUP BY i, p)"""


def _means_sql(name: str, book: str, assigned: str) -> str:
    return f"""{name} AS (
  SELECT b.p, b.e, CASE WHEN m.v IS NULL THEN b.v ELSE m.v END AS v FROM {book} AS b LEFT JOIN (
    SELECT p, e, list(x ORDER BY j) AS v FROM (
      SELECT p, e, j, floor(sum(v[j])::DOUBLE / count(*))::BIGINT AS x FROM {assigned}, (VALUES (1), (2), (3), (4)) AS s(j) GROUP BY p, e, j)
    GROUP BY p, e) AS m USING (p, e))"""


#: DuckDB SQL for :func:`compress` with its default parameters, over vectors of 64 components.
COMPRESS_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS i, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
part AS (SELECT i, p, v[4 * p + 1:4 * p + 4] AS v FROM kept, range(16) AS r(p)),
b0 AS (SELECT p, i - 1 AS e, v FROM part WHERE i <= 64),
{_assign_sql("a0", "b0")},
{_means_sql("b1", "b0", "a0")},
{_assign_sql("a1", "b1")},
{_means_sql("b2", "b1", "a1")},
{_assign_sql("a2", "b2")},
coded AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a2 GROUP BY i)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM kept JOIN coded USING (i)
"""
