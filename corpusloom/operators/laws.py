"""Rank-frequency and vocabulary-growth tables, and least-squares fits of the laws behind them."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.scratch import lookup

#: Lines whose bytes are summed up in one window.
LINES_IN_RANGE = 4096


def line_pieces(lines: DataFrame, n: int, book: str = "book", order: str = "line", text: str = "text") -> DataFrame:
    """Adds piece (0 .. n - 1): each book's lines cut into n pieces of about equal bytes, at line ends.

    The bytes before a line are those of the ranges of lines before its own, a small
    table, and those inside its range, so that a long book is no single task.  order:
    a whole number.
    """
    size = F.octet_length(text) + 1
    placed = lines.withColumn("_range", F.floor(F.col(order) / LINES_IN_RANGE))
    ranges = placed.groupBy(book, "_range").agg(F.sum(size).alias("_size"))
    up = Window.partitionBy(book).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(F.col(book).alias("_book"), F.col("_range").alias("_at"), F.coalesce(F.sum("_size").over(up), F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy(book)).alias("_total"))
    inside = Window.partitionBy(book, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    joined = own.join(lookup(starts, "ranges"), F.col(book).eqNullSafe(F.col("_book")) & F.col("_range").eqNullSafe(F.col("_at")))
    piece = F.floor(F.lit(n) * (F.col("_before") + F.col("_inside")) / F.col("_total")).cast("int")
    return joined.withColumn("piece", piece).drop("_range", "_book", "_at", "_before", "_total", "_inside")


def growth(words: DataFrame, n: int, book: str = "book") -> DataFrame:
    """(book, piece, n_unique, n_words), cumulative over pieces.

    words has a row for each token with its piece.  A word counts as new in the
    first piece that has it, so each piece is read once.
    """
    first = words.groupBy(book, "word").agg(F.min("piece").alias("piece"))
    new = first.groupBy(book, "piece").agg(F.count("*").alias("u"))
    all_ = words.groupBy(book, "piece").agg(F.count("*").alias("w"))
    grid = words.select(book).distinct().withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    up = Window.partitionBy(book).orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.join(new, [book, "piece"], "left").join(all_, [book, "piece"], "left").select(
        book, "piece", F.coalesce(F.sum("u").over(up), F.lit(0)).alias("n_unique"), F.coalesce(F.sum("w").over(up), F.lit(0)).alias("n_words")
    )


def without_tail(points: DataFrame, tail: int = 3150, book: str = "book", x: str = "n_words") -> DataFrame:
    """Points below the book's largest x less tail."""
    top = F.max(x).over(Window.partitionBy(book))
    return points.withColumn("_top", top).where(F.col(x) < F.col("_top") - tail).drop("_top")


def log_log_fit(points: DataFrame, x: str, y: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, slope, intercept, r2) of ln y over ln x, by the regression aggregates."""
    ly, lx = F.ln(F.col(y)), F.ln(F.col(x))
    positive = points.where((F.col(x) > 0) & (F.col(y) > 0))
    return positive.groupBy(*groups).agg(F.regr_slope(ly, lx).alias("slope"), F.regr_intercept(ly, lx).alias("intercept"), F.regr_r2(ly, lx).alias("r2"))


def goodness(points: DataFrame, y: str, fitted: Column, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, rmse, r2) of a fitted column."""
    with_fit = points.withColumn("_f", fitted)
    mean = F.avg(y).over(Window.partitionBy(*groups)) if groups else None
    if mean is None:
        with_fit = with_fit.join(F.broadcast(points.agg(F.avg(y).alias("_m"))))
    else:
        with_fit = with_fit.withColumn("_m", mean)
    residual = F.sum(F.pow(F.col(y) - F.col("_f"), 2))
    return with_fit.groupBy(*groups).agg(
        F.sqrt(F.avg(F.pow(F.col(y) - F.col("_f"), 2))).alias("rmse"), (1 - residual / F.sum(F.pow(F.col(y) - F.col("_m"), 2))).alias("r2")
    )


def least_squares(
    points: DataFrame, x: str, y: str,
    model: Callable[[Column, Sequence[float]], Column], gradient: Callable[[Column, Sequence[float]], Sequence[Column]],
    start: Sequence[float], bounds: Sequence[tuple[float, float]] | None = None, tolerance: float = 1e-15,
) -> tuple[list[float], float]:
    """Levenberg-Marquardt with box bounds by projection: (parameters, sum of squares).

    Each step is one aggregation of the normal equations over the points; only
    these few numbers come to the driver.
    """
    p = np.array(start, float)
    low, high = (np.array(b, float) for b in zip(*(bounds or [(-np.inf, np.inf)] * len(p))))
    p = np.clip(p, low, high)
    n = len(p)
    data = points.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).persist()

    def equations(q: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        params = [float(v) for v in q]
        r = F.col("_y") - model(F.col("_x"), params)
        g = gradient(F.col("_x"), params)
        sums = [F.sum(r * r)] + [F.sum(r * gi) for gi in g] + [F.sum(g[i] * g[j]) for i in range(n) for j in range(i, n)]
        row = [float("inf") if v is None or v != v else v for v in data.agg(*(s.alias(f"c{i}") for i, s in enumerate(sums))).first()]
        jtj = np.zeros((n, n))
        k = 1 + n
        for i in range(n):
            for j in range(i, n):
                jtj[i, j] = jtj[j, i] = row[k]
                k += 1
        return row[0], np.array(row[1 : 1 + n]), jtj

    try:
        return levenberg_marquardt(p, equations, low, high, tolerance)
    finally:
        data.unpersist()


def levenberg_marquardt(p: np.ndarray, equations: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], low: np.ndarray, high: np.ndarray, tolerance: float = 1e-15) -> tuple[list[float], float]:
    """(parameters, sum of squares); equations gives the sum of squares, J'r and J'J at some parameters."""
    damping, (cost, jr, jtj) = 1e-3, equations(p)
    while True:  # the sum of squares falls by a share of itself, or the damping grows to its end
        free = ~(((p <= low) & (jr < 0)) | ((p >= high) & (jr > 0)))
        if not free.any() or not np.isfinite(cost):
            break
        a = jtj[np.ix_(free, free)]
        # in units of the diagonal: parameters of very different sizes would look dependent
        scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
        moved = p.copy()
        moved[free] += np.linalg.lstsq(a / np.outer(scale, scale) + damping * np.eye(len(a)), jr[free] / scale, rcond=None)[0] / scale
        moved = np.clip(moved, low, high)
        new = equations(moved)
        if new[0] < cost:
            done = cost - new[0] <= tolerance * cost
            p, (cost, jr, jtj), damping = moved, new, max(damping / 10, 1e-12)
            if done:
                break
        else:
            damping *= 10
            if damping > 1e12:
                break
    return [float(v) for v in p], float(cost)


def fit_zipf(ranks: DataFrame, skip: int = 0, bounded: bool = True, rank: str = "rank", count: str = "freq") -> tuple[list[float], float]:
    """(a, b, c) of c * (rank + b) ** -a; bounded keeps all three at 0 or more; the first skip ranks are left out."""
    pts = ranks.where(F.col(rank) > skip)

    def model(x: Column, p: Sequence[float]) -> Column:
        return F.lit(p[2]) * F.pow(x + p[1], F.lit(-p[0]))

    def gradient(x: Column, p: Sequence[float]) -> list[Column]:
        base = F.pow(x + p[1], F.lit(-p[0]))
        return [F.lit(-p[2]) * base * F.ln(x + p[1]), F.lit(-p[0] * p[2]) * base / (x + p[1]), base]

    line = log_log_fit(pts, rank, count).first()
    start = [1.0, 1.0, 1.0]
    if line and line["slope"] is not None:
        start = [max(-line["slope"], 0.01), 1.0, float(np.exp(line["intercept"]))]
    return least_squares(pts, rank, count, model, gradient, start, [(0, np.inf)] * 3 if bounded else [(-np.inf, np.inf), (-0.999999, np.inf), (-np.inf, np.inf)])


def fit_heaps(points: DataFrame, x: str = "n_words", y: str = "n_unique") -> tuple[list[float], float]:
    """(k, beta) of k * n ** beta with k >= 0 and 0 <= beta <= 1."""

    def model(n: Column, p: Sequence[float]) -> Column:
        return F.lit(p[0]) * F.pow(n, F.lit(p[1]))

    def gradient(n: Column, p: Sequence[float]) -> list[Column]:
        return [F.pow(n, F.lit(p[1])), F.lit(p[0]) * F.pow(n, F.lit(p[1])) * F.ln(n)]

    line = log_log_fit(points, x, y).first()
    start = [10.0, 0.5] if not line or line["slope"] is None else [float(np.exp(line["intercept"])), float(np.clip(line["slope"], 0, 1))]
    return least_squares(points.where(F.col(x) > 0), x, y, model, gradient, start, [(0, np.inf), (0, 1)])


def fit_heaps_of_each(points: DataFrame, group: str, x: str = "n_words", y: str = "n_unique") -> DataFrame:
    """(group, k, beta, cost): fit_heaps() of each group in a task of its own; a group is a growth table of few points; with points of one size beta is 0.5."""
    kind = points.schema[group].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf[x] > 0].sort_values([x, y])
        n, u = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        if not len(n):
            return pd.DataFrame({group: [], "k": [], "beta": [], "cost": []})
        known = u > 0
        start = np.array([10.0, 0.5])
        if len(np.unique(n[known])) > 1:
            slope, shift = np.polyfit(np.log(n[known]), np.log(u[known]), 1)
            start = np.array([np.exp(shift), np.clip(slope, 0, 1)])

        def equations(p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            base = n ** p[1]
            j, r = np.stack([base, p[0] * base * np.log(n)]), u - p[0] * base
            return float(r @ r), j @ r, j @ j.T

        if len(np.unique(n)) < 2:  # one size of text determines no beta: it stays at its start
            k = float(u @ np.sqrt(n) / n.sum())
            return pd.DataFrame({group: pdf[group].iloc[:1].tolist(), "k": [k], "beta": [0.5], "cost": [float(((u - k * np.sqrt(n)) ** 2).sum())]})
        (k, beta), cost = levenberg_marquardt(start, equations, np.zeros(2), np.array([np.inf, 1.0]))
        return pd.DataFrame({group: pdf[group].iloc[:1].tolist(), "k": [k], "beta": [beta], "cost": [cost]})

    return points.select(group, x, y).groupBy(group).applyInPandas(one, f"`{group}` {kind}, k double, beta double, cost double")


def density(values: DataFrame, column: str, points: int = 50) -> DataFrame:
    """(x, density): Gaussian kernel density on evenly spaced points, three bandwidths beyond both ends.

    The bandwidth is the standard deviation times n ** -0.2.  Equal values are
    counted first, so the work is that of the distinct values times the points.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    whole = values.agg(F.count(column).alias("n"), F.stddev_samp(column).alias("s"), F.min(column).alias("lo"), F.max(column).alias("hi")).where("s > 0")
    shape = whole.withColumn("h", F.col("s") * F.pow("n", F.lit(-0.2)))
    at = shape.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select("n", "h", (F.col("lo") - 3 * F.col("h") + F.col("i") * (F.col("hi") - F.col("lo") + 6 * F.col("h")) / float(points - 1)).alias("x"))
    kernel = F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / F.col("h"), 2)) / (F.col("h") * math.sqrt(2 * math.pi))
    return counts.join(F.broadcast(at)).groupBy("x").agg((F.sum(F.col("c") * kernel) / F.max("n")).alias("density"))


def fit_power(points: DataFrame, x: str = "degree", y: str = "n") -> tuple[list[float], float]:
    """(a, gamma) of a * x ** -gamma over the positive points."""
    pts = points.where((F.col(x) > 0) & (F.col(y) > 0))

    def model(v: Column, p: Sequence[float]) -> Column:
        return F.lit(p[0]) * F.pow(v, F.lit(-p[1]))

    def gradient(v: Column, p: Sequence[float]) -> list[Column]:
        return [F.pow(v, F.lit(-p[1])), F.lit(-p[0]) * F.pow(v, F.lit(-p[1])) * F.ln(v)]

    line = log_log_fit(pts, x, y).first()
    start = [1.0, 1.0] if not line or line["slope"] is None else [float(np.exp(line["intercept"])), -line["slope"]]
    return least_squares(pts, x, y, model, gradient, start)


def curve(points: DataFrame, low: str, high: str, n: int, value: Callable[[Column], Column], groups: Sequence[str]) -> DataFrame:
    """(groups, x, y): n evenly spaced x from low to high of each group, and the curve there."""
    steps = points.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    x = F.col(low) + F.col("_i") * (F.col(high) - F.col(low)) / float(n - 1)
    return steps.withColumn("x", x).withColumn("y", value(F.col("x"))).select(*groups, "x", "y")


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    """(bin, n): counts of values in bins [bin * width, (bin + 1) * width)."""
    return df.where(F.col(column).isNotNull()).groupBy(F.floor(F.col(column) / width).alias("bin")).agg(F.count("*").alias("n"))
