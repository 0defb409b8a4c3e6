"""Periodic runs of words: harmonic grid probing.

A run is a maximal stretch of words that repeats with its smallest period p, of at
least ``min_length`` words and ``min_repeats`` periods.  Words become numbers inside a
document, so equality is exact.  For each period p the grid 0, p, 2p, ... is probed:
a stretch of three periods holds three grid points in a row, so that the words at jp and
(j+1)p, and those at (j+1)p and (j+2)p, are equal, and so are words at any one offset from the first two.  The
probes of all periods are n / 1 + n / 2 + n / 3 + ... of n words; periods of like size are
probed at once.  What survives is extended to both sides by comparing the words with
those p places on, in chunks that double.

A grid pair inside a run of p, or of a divisor of p, is skipped: the period-p stretch around
it is that run (the period's window repeats with the divisor, and so does all of the
stretch).  By the same argument a stretch that no such run covers has p as its smallest
period.  A text of one repeated word is settled by its first extension.

A document is handled alone and whole, in the task that scans it; nothing is shuffled.

Defined cases: a null or empty text has no words, no runs and an empty collapsed
text; a document without an id is like any other (an edit that needs the id leaves it
alone); repeated rows give repeated results; an empty table gives an empty result; columns
of the input but the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.kernels import SLICE_BYTES

MIN_LENGTH = 24
MIN_REPEATS = 3
#: Grid points that are probed at once.
PROBES = 1 << 16

Run = tuple[int, int, int]  # start, length, period


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word; equal words have equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """The number of first places at which a and b agree; chunks double."""
    at, size, n = 0, 64, len(a)
    while at < n:
        differs = a[at : at + size] != b[at : at + size]
        if differs.any():
            return at + int(differs.argmax())
        at += size
        size *= 2
    return n


def _extend(w: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The stretch of period p around at and at + p."""
    stop = at + _agreeing(w[at:-p], w[at + p :])
    start = at - _agreeing(w[:at][::-1], w[p : at + p][::-1])
    return start, stop + p


def _survivors(w: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(period, place) of the grid pairs of the periods first..last - 1 whose probes agree, by period and place."""
    n = len(w)
    p = np.arange(first, last)[:, None]
    grid = p * np.arange((n - 1) // first + 1)
    here = w[np.minimum(grid, n - 1)]
    equal = (here[:, :-1] == here[:, 1:]) & (grid[:, 1:] < n)
    row, j = np.nonzero(equal[:, :-1] & equal[:, 1:])
    period = row + first
    at = j * period
    for share in (0.5, 0.25, 0.75):  # words of the first period against those of the second
        x = at + (period * share).astype(np.int64)
        same = w[x] == w[x + period]
        period, at = period[same], at[same]
    return period, at


def find_runs(w: np.ndarray, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> list[Run]:
    """All runs of numbered words, by start and period."""
    if min_repeats < 3:
        raise ValueError("the grid shows runs of three periods or more")
    n, found, p = len(w), [], 1
    while p * min_repeats <= n and n >= min_length:
        # periods up to a quarter larger, as many as fill the probes
        last = min(max(p + 1, min(p + p // 4, p + PROBES // ((n - 1) // p + 1))), n // min_repeats + 1)
        period, at = _survivors(w, p, last)
        for start, length, q in found if len(at) else ():
            if length > p:
                covered = (period % q == 0) & (at >= start) & (at + period < start + length)
                period, at = period[~covered], at[~covered]
        while len(at):
            q = int(period[0])
            start, stop = _extend(w, int(at[0]), q)
            if stop - start >= max(min_length, min_repeats * q):
                found.append((start, stop - start, q))
                rest = (period % q != 0) | (at < start) | (at + period >= stop)
            else:
                rest = (period != q) | (at < start) | (at + period >= stop)
            period, at = period[rest], at[rest]
        p = last
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """False for the words that a run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, p in runs:
        change[start + p] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def periodic_tail(doc_id: object, words: list[bytes]) -> list[bytes]:
    """An edit that plants a run: of a tenth of all ids, by their checksum, the words from a place on repeat their first ones."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def runs_of(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS,
    edit: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """(id_col, n_words, runs, collapsed): the runs of each row's words and its text without their repeats.

    runs is an array of (start, length, period) by start and period; collapsed has the
    words that no run holds after its first period, joined by a space.  edit changes a
    row's words, given its id, before the search.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, out = 0, 0, []
            for i, (key, text) in enumerate(zip(batch.column(0).to_pylist() if edit else repeat(None, batch.num_rows), batch.column(1))):
                words = (text.as_py() or "").encode().split()
                if edit:
                    words = edit(key, words)
                runs = find_runs(numbered(words), min_length, min_repeats)
                if runs:
                    words_kept = [words[k] for k in np.flatnonzero(kept_words(len(words), runs))]
                    out.append((len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(words_kept).decode()))
                else:
                    out.append((len(words), [], b" ".join(words).decode()))
                size += len(out[-1][2])
                if size > SLICE_BYTES or i == batch.num_rows - 1:
                    n, found, text_out = zip(*out)
                    yield pa.RecordBatch.from_arrays([batch.column(0)[first : i + 1], pa.array(n, pa.int64()), pa.array(found, pa.list_(run)), pa.array(text_out, pa.string())], [id_col, "n_words", "runs", "collapsed"])
                    first, size, out = i + 1, 0, []

    return docs.select(id_col, text_col).mapInArrow(convert, f"`{id_col}` {kind}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def densest(runs: Column) -> Column:
    """The run with the greatest length / period, compared as whole numbers; of equals the first by start, then period; null if there is none."""
    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    nothing = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, nothing, better)


def run_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_runs, the densest run and digests of all runs and of the collapsed text, for each row of runs_of()."""
    best = densest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select(id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("_best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        id_col, "n_runs", "_best.start", "_best.length", "_best.period", F.expr("1000 * _best.length div _best.period AS exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
