"""Toxicity: bags of subword embeddings averaged into a linear softmax, trained jointly in numpy.

Texts are lower-cased, their white space becomes single spaces, and a word that
directly repeats the one before it counts once.  A word gives
its byte n-grams of 3 to 6, its own boundaries included as spaces, so unseen
misspellings and inflections share most of their n-grams with known words.  Each
n-gram has an embedding in a hashed table; a bag's embeddings are averaged and a
linear softmax over {clean, toxic} reads the average.  Embeddings and softmax
are trained together by stochastic gradient descent, with steps of a set length
that shrinks to none.

A toxic document is mostly harmless words, so bags are segments of
``SEGMENT_WORDS`` words and a document is as toxic as the mean of its ``TOP`` worst.
Training starts with whole documents as bags and goes on with each document's currently
worst segments (for clean documents these are the hard negatives).
A logistic curve, fitted on a part of the sample that the
embeddings have not seen, turns this mean margin into a score.  Segment length, TOP,
CLIP and ``min_texts`` are those with the least log loss when trained on rows with
crc32(doc_id) mod 3 = 0 and read on rows with 2; rows with 1 took no part in the choice.

As the softmax is linear, a trained n-gram adds one number to its bag's margin;
scoring looks these numbers up, vectorised over whole slices of text, and keeps no
word list.

Learning uses a hash sample of at most ``fit_rows`` labelled rows of each class,
out of those that are not held out; rows of over ``fit_chars`` characters are not
drawn for it.  Scoring reads every whole text.

Defined cases: null and empty texts have an empty bag and get the share of toxic
labels as score; without labels of both classes, or with fewer than ``FEWEST_TEXTS``
sampled texts that have words or such texts in one class alone, every text gets that
share (0 without any); null ids are scored; repeated rows are kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.kernels import SLICE_BYTES
from corpusloom.llm.learning import balanced_sample, held_out, one_label, texts_of
from corpusloom.llm.tables import by_position

GRAMS = range(3, 7)
BUCKET_BITS = 18
SEGMENT_WORDS = 2
DIMENSIONS = 8
#: A document's margin is the mean of those of this many worst segments.
TOP = 3
#: Margins beyond this count as this.
CLIP = 3.0
THRESHOLD = 0.7
#: With fewer sampled texts that have words, or words in one class alone, every text gets the share.
FEWEST_TEXTS = 8


def normal(text: str | None) -> bytes:
    words = (text or "").lower().split()
    return " ".join([w for w, last in zip(words, [None, *words]) if w != last]).encode("utf-8", "replace")


def _grams(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: positions and buckets of the n-grams inside words of a text that starts and ends with a space."""
    size = len(data)
    spaces = np.flatnonzero(data == 32)
    after = spaces[np.minimum(np.searchsorted(spaces, np.arange(1, size + 1)), len(spaces) - 1)] - np.arange(size)  # to the next space
    h = np.zeros(size, np.uint32)
    wide = data.astype(np.uint32)
    for n in range(1, GRAMS.stop):
        h = h[: size - n + 1] * np.uint32(0x01000193) + wide[n - 1 :] + np.uint32(1)
        if n in GRAMS:
            at = np.flatnonzero(after[: len(h)] >= n - 1)
            x = h[at]
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            yield at, x >> np.uint32(32 - BUCKET_BITS)


def segments(data: np.ndarray, heads: np.ndarray, words: int) -> np.ndarray:
    """Starts of the segments: each words-th word of each document; heads: starts of the documents."""
    spaces = np.flatnonzero(data[:-1] == 32)
    spaces = spaces[data[spaces + 1] != 32]
    first = np.searchsorted(spaces, heads)
    doc = np.searchsorted(heads, spaces, "right") - 1
    rank = np.arange(len(spaces)) - first[doc]
    return spaces[rank % words == 0]


@dataclass
class Model:
    weight: np.ndarray  # of each bucket
    bias: float
    slope: float
    shift: float
    words: int
    base: float  # score of an empty bag

    def margins(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The mean margin of the worst segments of each text, and whether it has any n-gram."""
        out, any_gram = np.full(len(texts), -np.inf), np.zeros(len(texts), bool)
        batch: list[bytes] = []
        size = first = 0
        for i, t in enumerate(texts):
            batch.append(normal(t))
            size += len(batch[-1]) + 1
            if size > SLICE_BYTES or i == len(texts) - 1:
                self._batch(batch, out[first : i + 1], any_gram[first : i + 1])
                batch, size, first = [], 0, i + 1
        return out, any_gram

    def _batch(self, texts: list[bytes], out: np.ndarray, any_gram: np.ndarray) -> None:
        data = np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8)
        heads = np.cumsum([0, *(len(t) + 2 for t in texts)])[:-1]
        starts = segments(data, heads, self.words)
        if not len(starts):
            return
        value, number = np.zeros(len(data), np.float32), np.zeros(len(data), np.float32)
        for at, bucket in _grams(data):
            value[at] += self.weight[bucket]
            number[at] += 1
        total = np.add.reduceat(value, starts, dtype=np.float64)
        count = np.add.reduceat(number, starts, dtype=np.float64)
        margin = total / np.maximum(count, 1) + self.bias
        doc = np.searchsorted(heads, starts, "right") - 1
        real = count > 0
        margin, doc = margin[real], doc[real]
        heads = np.searchsorted(doc, np.arange(len(texts) + 1))
        top, owner = _top(margin, heads, TOP)
        n = np.bincount(owner, minlength=len(texts))
        any_gram[:] = n > 0
        out[:] = np.where(n > 0, np.bincount(owner, margin[top], len(texts)) / np.maximum(n, 1), -np.inf)

    def score(self, texts: list[str | None]) -> np.ndarray:
        margin, known = self.margins(texts)
        with np.errstate(over="ignore"):
            return np.where(known, 1 / (1 + np.exp(-(self.slope * np.clip(np.where(known, margin, 0), -CLIP, CLIP) + self.shift))), self.base)


def _bags(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n-gram buckets in order of segments, offsets of the segments, the first segment of each text (and
    one more), and the number of texts that have each bucket."""
    buckets, sizes, first, spread = [], [], [0], np.zeros(1 << BUCKET_BITS, np.int32)
    for text in texts:
        data = np.frombuffer(b" " + normal(text) + b" ", np.uint8)
        starts = segments(data, np.zeros(1, np.int64), words)
        at, bucket = (np.concatenate(x) for x in zip(*_grams(data)))
        seg = np.searchsorted(starts, at, "right") - 1
        buckets.append(bucket[np.argsort(seg, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(seg, minlength=len(starts)))
        first.append(first[-1] + len(starts))
        spread[np.unique(buckets[-1])] += 1
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return np.concatenate(buckets), offsets, np.array(first), spread


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a slightly damped logistic curve, by Newton's method."""
    scale = max(float(np.std(x)), 1e-6)
    a, w = np.stack([x / scale, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + 1e-2 * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        w -= np.linalg.solve(h, g)
    return float(w[0] / scale), float(w[1])


def _top(values: np.ndarray, heads: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each group's most largest values, and the group of each; heads: first place of each group, and one more."""
    group = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
    order = np.lexsort((-values, group))
    keep = np.arange(len(values)) - heads[:-1][group] < most  # order keeps the groups' places
    return order[keep], group[keep]


def train(texts: list[str], labels: list[int], share: float, words: int = SEGMENT_WORDS, dims: int = DIMENSIONS, warm_up: int = 6, epochs: int = 24, rate: float = 2.0, decay: float = 1e-3, min_texts: int = 4, seed: int = 11) -> Model:
    """Train on texts in a fixed order; share: of label 1 among all labelled rows.

    Gradients are scaled to a fixed norm for each array as a whole, so n-grams
    move in proportion to the evidence for them and rare ones hardly at all.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels)
    bucket, seg, doc, spread = _bags(texts, words)
    full = np.flatnonzero(np.diff(doc) > 0)
    order = rng.permutation(full)
    held, used = order[: len(order) // 4], order[len(order) // 4 :]
    # too few texts for a part of their own: all of them are learned from, and all give the curve
    held, used = (part if len(np.unique(y[part])) == 2 else full for part in (held, used))
    alive = spread >= min_texts
    table = rng.uniform(-1 / dims, 1 / dims, (1 << BUCKET_BITS, dims)).astype(np.float32)
    table[~alive] = 0  # what few texts have is noise: it counts in its bag's size but gets no weight
    out, bias = np.zeros((dims, 2), np.float32), np.zeros(2, np.float32)

    def step(bags: np.ndarray, marks: np.ndarray, eta: float) -> None:
        sizes = bags[:, 1] - bags[:, 0]
        ids = np.concatenate([bucket[a:b] for a, b in bags])
        owner = np.repeat(np.arange(len(bags)), sizes)
        h = np.add.reduceat(table[ids], np.cumsum([0, *sizes[:-1]]), axis=0) / sizes[:, None]
        z = h @ out + bias
        p = np.exp(z - z.max(1, keepdims=True))
        g = p / p.sum(1, keepdims=True)
        g[np.arange(len(bags)), marks] -= 1
        weight = np.where(marks == 1, 0.5 / max(1, marks.sum()), 0.5 / max(1, (1 - marks).sum()))
        g *= weight[:, None]
        back = (g @ out.T) / sizes[:, None]
        touched, where = np.unique(ids, return_inverse=True)
        d_table = np.stack([np.bincount(where, back[owner, k], len(touched)) for k in range(dims)], 1).astype(np.float32)
        d_table *= alive[touched, None]
        for x, d, part, size in ((table, d_table, touched, 1.0), (out, h.T @ g, slice(None), 0.05), (bias, g.sum(0), slice(None), 0.02)):
            x[part] -= eta * size * (d / (np.linalg.norm(d) + 1e-12)).astype(np.float32)
            x *= 1 - decay

    def margins() -> np.ndarray:
        value = (table @ (out[:, 1] - out[:, 0]))[bucket]
        sizes = np.diff(seg)
        total = np.add.reduceat(np.append(value, np.float32(0)), seg[:-1], dtype=np.float64)
        return np.where(sizes > 0, total / np.maximum(sizes, 1), -1e9) + float(bias[1] - bias[0])

    for epoch in range(warm_up + epochs):
        eta = rate * (1 - epoch / (warm_up + epochs))
        if epoch < warm_up:
            first, last, owner = doc[:-1], doc[1:], np.arange(len(texts))
        else:
            first, owner = _top(margins(), doc, TOP)
            last = first + 1
        bags = np.stack([seg[first], seg[last]], 1)
        ok = (bags[:, 1] > bags[:, 0]) & np.isin(owner, used)
        bags, marks = bags[ok], y[owner[ok]]
        todo = rng.permutation(len(bags))
        for part in np.array_split(todo, max(1, len(todo) // (64 if epoch < warm_up else 256))):
            if len(part):
                step(bags[part], marks[part], eta)
    top, owner = _top(margins(), doc, TOP)
    level = np.bincount(owner, margins()[top], len(texts)) / np.maximum(np.bincount(owner, minlength=len(texts)), 1)
    positive = max(1, int(y[held].sum()))
    weight = np.where(y[held] == 1, share / positive, (1 - share) / max(1, len(held) - positive)) * len(held)
    slope, shift = _logistic(np.clip(level[held], -CLIP, CLIP), y[held], weight)
    return Model(table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]), slope, shift, words, share)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 1_200, fit_chars: int = 12_000) -> Model | float:
    """A model, or the constant score where the labels do not have both classes."""
    known = one_label(labels, label, id_col)
    share = float(known.agg(F.avg(label)).first()[0] or 0.0)
    if share in (0.0, 1.0):
        return share
    sample = balanced_sample(known, label, fit_rows, id_col)
    rows = texts_of(docs.select(id_col, text_col).where(F.length(text_col) <= fit_chars), sample, id_col)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(3))))
        full = [y for _, t, y in got if normal(t)]
        if len(set(full)) == 2 and len(full) >= FEWEST_TEXTS:
            model = train([t for _, t, _ in got], [y for _, _, y in got], share)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # one task of a bounded number of rows, on an executor: the driver only gets the model
    models = rows.select(id_col, text_col, label).repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(models[0][0]) if models else share


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, held_out, score, predicted) for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            s = np.full(batch.num_rows, m) if isinstance(m, float) else m.score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    return docs.select(id_col, held_out(F.col(id_col)).alias("held_out"), text_col).mapInArrow(convert, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model | float, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose whole text scores below the threshold, with all their columns; nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    plain, at = by_position(docs), docs.columns.index(text_col)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            s = np.full(batch.num_rows, m) if isinstance(m, float) else m.score(batch.column(at).to_pylist())
            yield batch.filter(pa.array(s < threshold))

    return plain.mapInArrow(convert, plain.schema).toDF(*docs.columns)
