"""Vector code compression: product codebooks of whole numbers, searched by partial distances.

Components become whole numbers (floor of 256 times the value) and vectors are cut into
equal parts; each part position has a codebook, and a vector's code is the index of the
nearest entry for each of its parts.  Codebooks start as the parts of the smallest ids and are
improved for a few rounds: all parts are assigned, and an entry becomes the floored mean of its parts.

Partial-distance search: the dimensions of a codebook are taken in descending variance of
its entries.  The squared distances of the first dimension name a likely entry for each
part, whose complete distance is the best so far; from then on a part's entries are dropped, by
masks over all parts of a block, as soon as their accumulated distance strictly exceeds its best.
The best is renewed from the least accumulated distances; while most entries are left they stay a
matrix, then only those left are gone through.  Distances are whole numbers, so nothing is lost by rounding and ties go to the lower index.

A round is one scan: every task adds up its parts by codebook entry, and at most (entries x
dimensions) sums of a task are shuffled.  The driver holds the codebooks alone, and they alone are
broadcast: entries x dimensions numbers, whatever the rows.

Defined cases: vectors that are null or hold a null, NaN or infinite component are
dropped, and so are those with a component so large that no long holds a distance; vectors
shorter than the longest kept one, or than a multiple of the parts, are filled up
with zeros; rows that repeat an id are kept and count each (for the first
codebook in order of their vectors, null ids last); fewer rows than entries give smaller
codebooks; an empty table gives an empty result; columns that are not named are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.scratch import lookup, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vectors that are searched at once, and the part of their entries, one in DENSE, from which on only those left are gone through.
BLOCK = 2048
DENSE = 8


@dataclass
class Codebooks:
    entries: np.ndarray  # (part, entry, position in part)
    width: int  # components of a vector, zeros that fill it up included
    limit: int  # whole numbers beyond it make a vector unusable

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _finite(vec: Column) -> Column:
    """True for vectors of finite components alone."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf)))


def _usable(vectors: DataFrame, vec_col: str, limit: int) -> DataFrame:
    within = F.forall(vec_col, lambda x: F.abs(F.floor(x.cast("double") * SCALE)) <= F.lit(limit))
    return vectors.where(F.when(_finite(F.col(vec_col)), within).otherwise(False))


def whole_numbers(column: pa.Array, width: int) -> np.ndarray:
    """(row, component) of a list column without nulls, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    if len(values) == out.size:
        return values.reshape(out.shape)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _firsts(row: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, row[1:] != row[:-1]])


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of a codebook for each point; ties to the lower index."""
    order = np.argsort(-book.var(axis=0), kind="stable")
    if len(order) <= 64 and max(np.abs(points).max(initial=0), np.abs(book).max(initial=0)) < 1 << 11:
        points, book = points.astype(np.int32), book.astype(np.int32)  # no sum can leave them
    sums, best = np.zeros((len(points), len(book)), points.dtype), None
    for done, dim in enumerate(order, 1):
        gap = points[:, dim, None] - book[None, :, dim]
        sums += gap * gap
        if done == len(order):
            break
        if done > 1:  # the least so far may be nearer as a whole than the best so far
            whole = ((points - book[sums.argmin(1)]) ** 2).sum(1, dtype=points.dtype)
            best = whole if best is None else np.minimum(best, whole)
            alive = np.flatnonzero(sums <= best[:, None])
            if len(alive) * DENSE < sums.size:
                return _of_few(points, book, order[done:], best, alive, sums.ravel()[alive])
    index = sums.argmin(1)
    return index, sums[np.arange(len(points)), index].astype(np.int64)


def _of_few(points: np.ndarray, book: np.ndarray, dims: np.ndarray, best: np.ndarray, alive: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same over the entries that are left, (point, entry) by place, with their accumulated distances."""
    row, entry = np.divmod(alive, len(book))
    for done, dim in enumerate(dims, 1):
        step = points[row, dim] - book[entry, dim]
        part = part + step * step
        if done & (done - 1) == 0:
            least = np.minimum.reduceat(part, _firsts(row))
            at = np.flatnonzero(part == least[np.cumsum(np.r_[False, row[1:] != row[:-1]])])
            at = at[_firsts(row[at])]
            best[row[at]] = np.minimum(best[row[at]], ((points[row[at]] - book[entry[at]]) ** 2).sum(1, dtype=points.dtype))
        keep = part <= best[row]
        row, entry, part = row[keep], entry[keep], part[keep]
    least = np.minimum.reduceat(part, _firsts(row))
    at = np.flatnonzero(part == least[row])  # every point has an entry left: that of its best
    return entry[at[_firsts(row[at])]], least.astype(np.int64)


def assign(numbers: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """(row, part) indices of the nearest entries and their squared distances."""
    n, (parts, _, size) = len(numbers), books.entries.shape
    index, distance = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
    for at in range(0, n, BLOCK):
        block = numbers[at : at + BLOCK]
        for p in range(parts):
            index[at : at + BLOCK, p], distance[at : at + BLOCK, p] = nearest(block[:, p * size : (p + 1) * size], books.entries[p])
    return index, distance


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks over all rows; None if no vector is usable."""
    longest = vectors.where(_finite(F.col(vec_col))).agg(F.max(F.size(vec_col))).first()[0]
    if longest is None:
        return None
    width = max(1, -(-longest // parts)) * parts
    limit = math.isqrt((1 << 62) // max(1, width)) // 2
    used = _usable(vectors, vec_col, limit)
    first = used.select(id_col, F.col(vec_col).alias("_v")).orderBy(F.asc_nulls_last(id_col), "_v").limit(entries).select("_v").toArrow()
    if not first.num_rows:
        return None
    size = width // parts
    books = Codebooks(np.ascontiguousarray(whole_numbers(first["_v"], width).reshape(-1, parts, size).transpose(1, 0, 2)), width, limit)
    for _ in range(rounds):
        books = _improved(used, books, vec_col)
    return books


def _improved(used: DataFrame, books: Codebooks, vec_col: str) -> Codebooks:
    held = used.sparkSession.sparkContext.broadcast(books)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = held.value
        total = np.zeros(b.entries.shape, np.int64)
        count = np.zeros(b.entries.shape[:2], np.int64)
        for batch in batches:
            numbers = whole_numbers(batch.column(0), b.width)
            index, _ = assign(numbers, b)
            size = total.shape[2]
            for p in range(len(total)):
                count[p] += np.bincount(index[:, p], minlength=count.shape[1])
                np.add.at(total[p], index[:, p], numbers[:, p * size : (p + 1) * size])
        part, entry, place = np.nonzero(np.broadcast_to(count[:, :, None] > 0, total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, entry, place, count[part, entry], total[part, entry, place])], ["part", "entry", "place", "n", "total"])

    sums = used.select(vec_col).mapInArrow(summed, "part long, entry long, place long, n long, total long")
    entries = books.entries.copy()
    # at most one row for each number of the codebooks
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).toLocalIterator():
        entries[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return Codebooks(entries, books.width, books.limit)


def encode(vectors: DataFrame, books: Codebooks | None, keep: tuple[str, ...] = ("vec_id",), vec_col: str = "embedding") -> DataFrame:
    """The columns of keep, code and error of each usable row; code has two hex digits for each part."""
    fields = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in keep)
    held = vectors.sparkSession.sparkContext.broadcast(books)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = held.value
        for batch in batches:
            index, distance = assign(whole_numbers(batch.column(len(keep)), b.width), b)
            digits = index.astype(np.uint8).tobytes().hex()
            wide = 2 * index.shape[1]
            codes = [digits[i * wide : (i + 1) * wide] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(codes, pa.string()), pa.array(distance.sum(1))], [*keep, "code", "error"])

    used = _usable(vectors, vec_col, books.limit) if books else vectors.where("false")
    return used.select(*keep, vec_col).mapInArrow(convert, f"{fields}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) for each usable row."""
    if entries > 256:
        raise ValueError("an index has two hex digits")
    named = vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_vec"), F.col(label_col).alias("_label"))
    books = fit(named, "_id", "_vec", parts, entries, rounds)
    coded = stored(encode(named, books, ("_id", "_label"), "_vec"), "codes")
    totals = lookup(coded.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error")), "label_errors")
    rows = coded.join(totals, coded["_label"].eqNullSafe(totals["_of"]))
    return rows.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(books.digest if books else "").alias("codebooks_sha256"))
