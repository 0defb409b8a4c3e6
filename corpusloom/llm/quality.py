"""Quality by hierarchical empirical Bayes over documents, paths and hosts.

Document evidence is the log-odds of a logistic regression, fitted by Newton's
method in numpy on one executor.  It reads densities measured on whole texts
(repetition, symbols, lines, word lengths and the like) and the mean log-odds of
a text's words, which are learned from the labels into a hashed table.  For the
fit each half of the sample gets its words' log-odds from the other half, so the
regression sees how well they hold for new texts.

Sites have two levels, host and path below it.  Each document is an observation
of its site: a labelled one (not held out) counts 1 with its label, any other
counts ``soft_weight`` with its classifier probability.  Counts are summed by
grouped aggregation.  Between-host and within-host variances, by moments, give
the concentration of the Beta priors: a host's rate is shrunk towards the global
rate, a path's towards its host's, the more the fewer observations it has.

The posterior log-odds of a document are its evidence plus the log-odds of its
path minus the global log-odds.  All three rates are those without the
document's own observation, so nothing is counted twice and no label scores itself.

Learning uses a hash sample of at most ``fit_rows`` labelled rows of up to
``fit_chars`` characters; counts and scores are over all rows and whole texts.

Defined cases: null or empty text has all densities 0; a null host or path is a
site of its own; without labels of both classes the evidence is that of the
share of good labels (one half without any); null ids are scored; repeated rows
are kept, and each of them is an observation; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.kernels import slices, word_hashes, words
from corpusloom.llm.learning import held_out, one_label, texts_of
from corpusloom.scratch import lookup, stored

THRESHOLD = 0.5
BUCKET_BITS = 16
FEATURES = (
    "log_words", "distinct_words", "repeated_words", "distinct_lines", "words_per_line", "word_length",
    "symbols", "pipes", "marks", "digits", "capitals", "other",
)
_DROP = {
    "symbols": b"%&*$#@=+<>[]{}^~\\/",
    "pipes": b"|",
    "marks": b"!?",
    "digits": b"0123456789",
    "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "other": b"\"'()-_:;`",
}


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    found = raw.split()
    n = len(found)
    if not n:
        return [0.0] * len(FEATURES)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = sum(a == b for a, b in zip(found, found[1:]))
    counts = [(len(raw) - len(raw.translate(None, d))) / n for d in _DROP.values()]
    return [
        math.log1p(n), len(set(found)) / math.sqrt(n), repeats / n, len(set(lines)) / len(lines), math.log1p(n / len(lines)),
        sum(map(len, found)) / n, *(math.log1p(20 * c) for c in counts),
    ]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (intercept last) of a ridge logistic regression."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + penalty @ w
        w -= np.linalg.solve((a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a + penalty, g)
    return mean, scale, w


def _quadratic(x: np.ndarray) -> np.ndarray:
    return np.c_[x, x * x]


def _word_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, and each text's first word (and one more)."""
    parts, heads = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    for _, data, offsets in slices(column):
        starts, ends, first = words(data, offsets)
        parts.append((word_hashes(data, starts, ends) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        heads.append(first[1:] + heads[-1][-1])
    return np.concatenate(parts), np.concatenate(heads)


def _means(table: np.ndarray, buckets: np.ndarray, heads: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(table[buckets], dtype=np.float64)])
    return (sums[heads[1:]] - sums[heads[:-1]]) / np.maximum(np.diff(heads), 1)


def _word_table(buckets: np.ndarray, heads: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log-odds of each bucket from the numbers of good and other texts (of rows) that have it."""
    seen = np.zeros((2, 1 << BUCKET_BITS))
    for i in np.flatnonzero(rows):
        seen[int(y[i]), np.unique(buckets[heads[i] : heads[i + 1]])] += 1
    total = np.array([np.sum(rows & (y == c)) for c in (0, 1)])
    rate = (seen + 0.5) / (total[:, None] + 1)
    return (np.log(rate[1]) - np.log(rate[0])).astype(np.float32)


@dataclass
class Evidence:
    """The document classifier: a table of words, and a quadratic logistic regression."""

    table: np.ndarray
    slope: np.ndarray
    shift: float

    @staticmethod
    def inputs(texts: list[str | None], word_means: np.ndarray) -> np.ndarray:
        return _quadratic(np.c_[np.array([features(t) for t in texts]).reshape(-1, len(FEATURES)), word_means])

    def log_odds(self, column: pa.Array) -> np.ndarray:
        x = self.inputs(column.to_pylist(), _means(self.table, *_word_buckets(column)))
        return np.clip(x @ self.slope + self.shift, -12.0, 12.0)


def train(texts: list[str | None], labels: list[int]) -> Evidence | float:
    """The classifier from texts in a fixed order, or the log-odds of the labels where it can't be fitted."""
    y = np.array(labels, float)
    if len(y) < 20 or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        return math.log(share / (1 - share))
    buckets, heads = _word_buckets(pa.array(texts, pa.large_string()))
    fold = np.zeros(len(y), bool)
    for c in (0, 1):
        fold[np.flatnonzero(y == c)[::2]] = True
    crossed = np.where(fold, _means(_word_table(buckets, heads, y, ~fold), buckets, heads), _means(_word_table(buckets, heads, y, fold), buckets, heads))
    mean, scale, w = logistic(Evidence.inputs(texts, crossed), y)
    slope = w[:-1] / scale
    return Evidence(_word_table(buckets, heads, y, np.ones(len(y), bool)), slope, float(w[-1] - slope @ mean))


def fit(docs: DataFrame, known: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 4_000, fit_chars: int = 20_000) -> Evidence | float:
    """Train on a bounded hash sample of known (id_col, label), in one task of an executor."""
    sample = known.orderBy(F.xxhash64(F.col(id_col).cast("string"), F.lit(5)), id_col).limit(fit_rows)
    rows = texts_of(docs.select(id_col, text_col).where(F.length(text_col) <= fit_chars), sample, id_col)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(3))))
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([t for _, t, _ in got], [y for _, _, y in got]))], pa.binary())], ["model"])

    models = rows.select(id_col, text_col, label).repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(models[0][0]) if models else 0.0


def measure(docs: DataFrame, model: Evidence | float, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, host, path, evidence) of each row's whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            odds = np.full(batch.num_rows, m) if isinstance(m, float) else m.log_odds(batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(odds)], [id_col, "host", "path", "evidence"])

    site = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    chosen = docs.select(id_col, site(host).alias("host"), site(path).alias("path"), text_col)
    return chosen.mapInArrow(convert, f"`{id_col}` {kind}, host string, path string, evidence double")


def _rate(s: Column, n: Column, prior: Column, strength: Column) -> Column:
    return (s + strength * prior) / (n + strength)


def _strength(groups: DataFrame, within: str, low: float = 1.0, high: float = 10_000.0) -> tuple[float, float]:
    """Mean rate and Beta concentration of groups (s, n, prior) by moments; within: column with the expected rate."""
    r = groups.agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count("*").alias("k"),
        F.sum(F.when(F.col("n") > 0, F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(within), 2)).otherwise(0.0)).alias("q"),
    ).first()
    if not r["n"]:
        return 0.5, high
    mean = min(max(r["s"] / r["n"], 1e-3), 1 - 1e-3)
    noise = mean * (1 - mean)
    spread = r["n"] - r["n2"] / r["n"]
    between = (r["q"] - (r["k"] - 1) * noise) / spread if spread > 1e-9 else 0.0
    return mean, high if between <= 0 else min(max(noise / between - 1, low), high)


def _clipped(rate: Column) -> Column:
    return F.greatest(F.least(rate, F.lit(1 - 1e-3)), F.lit(1e-3))


def site_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", soft_weight: float = 0.1, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, host, path, held_out, evidence, host_rate, path_rate, score, keep) for each row."""
    known = one_label(labels, label, id_col)
    measured = measure(docs, fit(docs, known, label, id_col, text_col), host, path, id_col, text_col)
    vote = F.coalesce(F.col(label).cast("double"), 1 / (1 + F.exp(-F.col("evidence"))))
    weight = F.when(F.col(label).isNull(), F.lit(soft_weight)).otherwise(F.lit(1.0))
    seen = stored(measured.join(known, id_col, "left").select(id_col, "host", "path", "evidence", (vote * weight).alias("_s"), weight.alias("_n")), "quality")
    paths = stored(seen.groupBy("host", "path").agg(F.sum("_s").alias("s"), F.sum("_n").alias("n")), "sites")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    overall = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = min(max(overall["s"] / overall["n"], 1e-3), 1 - 1e-3) if overall["n"] else 0.5
    _, host_strength = _strength(hosts.withColumn("prior", F.lit(mean)), "prior")
    sums = hosts.select("host", F.col("s").alias("host_s"), F.col("n").alias("host_n"))
    nested = lookup(paths.join(sums, "host"), "sites")
    _, path_strength = _strength(nested.withColumn("_expected", _rate(F.col("host_s"), F.col("host_n"), F.lit(mean), F.lit(host_strength))), "_expected")
    # each document's rates are those of the others
    left_s, left_n = F.lit(overall["s"] or 0.0) - F.col("_s"), F.lit(overall["n"] or 0.0) - F.col("_n")
    rated = (
        seen.join(nested, ["host", "path"])
        .withColumn("_mean", F.when(left_n > 1e-9, _clipped(left_s / left_n)).otherwise(F.lit(0.5)))
        .withColumn("host_rate", _clipped(_rate(F.col("host_s") - F.col("_s"), F.col("host_n") - F.col("_n"), F.col("_mean"), F.lit(host_strength))))
        .withColumn("path_rate", _clipped(_rate(F.col("s") - F.col("_s"), F.col("n") - F.col("_n"), F.col("host_rate"), F.lit(path_strength))))
    )
    odds = lambda c: F.ln(F.col(c) / (1 - F.col(c)))
    score = 1 / (1 + F.exp(-(F.col("evidence") + odds("path_rate") - odds("_mean"))))
    return rated.select(
        id_col, "host", "path", held_out(F.col(id_col)).alias("held_out"), "evidence", "host_rate", "path_rate",
        score.alias("score"), (score >= threshold).alias("keep"),
    )
