"""Product quantization of vectors by integer codebooks, with LAESA pivots in front of exact distances.

A vector is cut into parts, and each part position has a codebook of its own. Pivots, fixed
entries of the first codebooks, are spread far apart; the distance of every part to them is computed once
and stored beside it. In each round the pivots' distances to the present entries give, by the triangle
inequality, a lower bound for each part and entry. Entries are tried in the order of these bounds, and
only while a bound does not exceed the best exact integer distance found. Distances to pivots are kept as
integers rounded down, so a bound is the difference less one, and no rounding decides a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import cut, ints, stored, wider, with_groups

SCALE = 1024
#: Components of this size and more could overflow a sum of squares in 64 bits.
LARGEST = 1 << 24
CHUNK = 2048


def integer_vectors(rows: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """Stored (vec_id, label, vec: array<int>) of the rows that can be coded, and the width of a part.

    Rows whose vector is null or holds a null or non-finite component are dropped. Vectors shorter than
    the longest are filled up with zeros, as is one whose length the parts do not divide.
    """
    infinite = F.lit(float("inf"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    kept = rows.filter(F.col("embedding").isNotNull() & ~bad).select("vec_id", "label", scaled.alias("vec"))
    most = kept.agg(F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", F.abs)))).first()
    if (most[1] or 0) >= LARGEST:
        raise ValueError(f"components must be below {LARGEST // SCALE} in size")
    width = -(-(most[0] or 0) // parts)
    filled = F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(width * parts) - F.size("vec")))
    return kept.withColumn("vec", filled.cast("array<int>")), width


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of every row of ``a`` to every row of ``b``, as integers."""
    return np.stack([((a - y) ** 2).sum(axis=1) for y in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


def root(squares: np.ndarray) -> np.ndarray:
    """Integer square roots, rounded down."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) ** 2 <= squares)


def spread_pivots(entries: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` entries, the first and then always the one farthest from those taken."""
    if not len(entries):
        return entries
    taken, far = [0], distances(entries, entries[:1])[:, 0]
    while len(taken) < most and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, distances(entries, entries[taken[-1:]])[:, 0])
    return entries[taken]


def nearest(x: np.ndarray, near: np.ndarray, entries: np.ndarray, marks: np.ndarray, first: int = 16) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of the entry nearest to each row of ``x``, ties to the lower index, and the number of exact distances.

    ``near`` holds the rows' distances to the pivots, ``marks`` those of the entries (one row a pivot), both rounded down.
    """
    n, m = len(x), len(entries)
    low = np.zeros((n, m), dtype=np.int64)
    for p, mark in enumerate(marks):
        np.maximum(low, np.abs(near[:, p, None] - mark[None, :]), out=low)
    low = np.maximum(low - 1, 0) ** 2
    rows = np.arange(n)
    exact = lambda r, c: ((x[r] - entries[c]) ** 2).sum(axis=-1)
    index = low.argmin(axis=1)
    best = exact(rows, index)
    done = n
    low[rows, index] = np.iinfo(np.int64).max
    if m > first + 1:  # the entries of least bounds tighten the best distance for the rest
        some = np.sort(np.argpartition(low, first, axis=1)[:, :first], axis=1)
        open_ = np.take_along_axis(low, some, axis=1) <= best[:, None]
        r, k = np.nonzero(open_)
        c = some[r, k]
        index, best = improved(index, best, r, c, exact(r, c))
        done += len(r)
        low[r, c] = np.iinfo(np.int64).max
    r, c = np.nonzero(low <= best[:, None])
    index, best = improved(index, best, r, c, exact(r, c))
    return index, best, done + len(r)


def improved(index: np.ndarray, best: np.ndarray, r: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best entries after candidates ``c`` at distance ``d`` of rows ``r``; a tie goes to the lower index."""
    order = np.lexsort((c, d, r))
    r, c, d = r[order], c[order], d[order]
    lead = np.ones(len(r), dtype=bool)
    lead[1:] = r[1:] != r[:-1]
    r, c, d = r[lead], c[lead], d[lead]
    better = (d < best[r]) | ((d == best[r]) & (c < index[r]))
    index, best = index.copy(), best.copy()
    index[r[better]], best[r[better]] = c[better], d[better]
    return index, best


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as rows of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def chunks(batches: Iterator[pa.RecordBatch], *widths: int) -> Iterator[tuple]:
    """Batches in bounded pieces: the piece, and its last columns as matrices."""
    for b in batches:
        for k in range(0, b.num_rows, CHUNK):
            piece = b.slice(k, CHUNK)
            yield piece, *(matrix(piece.column(piece.num_columns - len(widths) + i), w) for i, w in enumerate(widths))


def with_pivot_distances(rows: DataFrame, pivots: list[np.ndarray], width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in chunks(batches, width * len(pivots)):
            near = np.concatenate([root(distances(x[:, k * width : (k + 1) * width], p)) for k, p in enumerate(pivots)], axis=1)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * near.shape[1]
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(near.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*piece.columns, column], names=[*piece.schema.names, "near"])

    return rows.mapInArrow(run, wider(rows, "near array<int>"))


def assigner(pivots: list[np.ndarray], books: list[np.ndarray], width: int) -> Callable:
    """For a piece's components and pivot distances: the nearest entries and squared distances, a column a part."""
    marks = [root(distances(p, e)) for p, e in zip(pivots, books, strict=True)]
    starts = np.cumsum([0, *(len(p) for p in pivots)])

    def assign(x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = [nearest(x[:, k * width : (k + 1) * width], near[:, starts[k] : starts[k + 1]], books[k], marks[k])[:2] for k in range(len(books))]
        return np.stack([i for i, _ in out], axis=1), np.stack([d for _, d in out], axis=1)

    return assign


def refined(rows: DataFrame, pivots: list[np.ndarray], books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Codebooks whose used entries are the means, rounded down, of their parts; each task sends a row of sums for each entry it used."""
    assign, n_near, size = assigner(pivots, books, width), sum(map(len, pivots)), max(map(len, books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(books) * size, dtype=np.int64)
        sums = np.zeros((len(books) * size, width), dtype=np.int64)
        for _, x, near in chunks(batches, width * len(books), n_near):
            index, _ = assign(x, near)
            for k in range(len(books)):
                slots = k * size + index[:, k]
                order = np.argsort(slots, kind="stable")
                used, first = np.unique(slots[order], return_index=True)
                sums[used] += np.add.reduceat(x[order, k * width : (k + 1) * width], first, axis=0)
                count += np.bincount(slots, minlength=len(count))
        used = np.nonzero(count)[0]
        offsets = np.arange(len(used) + 1, dtype=np.int32) * width
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(count[used]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums[used].ravel()))], names=["slot", "n", "sums"]
        )

    parts = rows.select("vec", "near").mapInArrow(run, "slot int, n long, sums array<long>")
    total = parts.groupBy("slot").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).cast("array<long>").alias("sums"))
    new = [b.copy() for b in books]
    for slot, n, sums in total.collect():  # a row for each entry of the codebooks at most
        new[slot // size][slot % size] = [s // n for s in sums]
    return new


def coded(rows: DataFrame, pivots: list[np.ndarray], books: list[np.ndarray], width: int) -> DataFrame:
    """(vec_id, label, code, error)."""
    assign, n_near = assigner(pivots, books, width), sum(map(len, pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x, near in chunks(batches, width * len(books), n_near):
            index, far = assign(x, near)
            codes = [bytes(i).hex() for i in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(codes), pa.array(far.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    slim = rows.select("vec_id", "label", "vec", "near")
    return slim.mapInArrow(run, wider(rows.select("vec_id", "label"), "code string, error long"))


def compressed(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, pivots: int = 12) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each row of ``rows(vec_id, embedding, label)`` that can be coded.

    The first codebooks are the parts of the ``entries`` smallest vec_ids (all rows where there are fewer; null ids
    come last, equal ids ascend by vector). Every round reads all rows and sends at most a row an entry to the driver.
    Rows with a null id or label are coded like others, null labels are one label, repeated rows stay,
    other columns are ignored, and an empty table gives an empty result. At most 256 entries, for two digits each.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    whole, width = integer_vectors(rows, parts)
    whole = stored(whole)
    first = [r["vec"] for r in whole.orderBy(F.asc_nulls_last("vec_id"), "vec").select("vec").limit(entries).collect()]
    seeds = np.array(first, dtype=np.int64).reshape(len(first), width * parts)
    books = [seeds[:, k * width : (k + 1) * width] for k in range(parts)]
    fixed = [spread_pivots(b, pivots) for b in books]
    near = stored(with_pivot_distances(whole, fixed, width))
    for _ in range(rounds):
        books = refined(near, fixed, books, width)
    digest = hashlib.sha256(ints([int(x) for b in books for x in b.ravel()]).encode()).hexdigest()
    out = stored(coded(near, fixed, books, width))
    sums = cut(out.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    return with_groups(out, sums, "label", "n").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
