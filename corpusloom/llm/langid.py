"""Language identification by prediction by partial matching.

For each language a byte context tree of order 0 to 3 is counted.  The
probability of the next byte is that of the longest context known to the
language: a byte seen there gets n / (T + d), where T counts the context and d
its distinct successors; else d / (T + d) is paid for the escape and the shorter
context decides among the bytes not yet excluded (escape method C with full
exclusion), down to a uniform choice.  Statistics are frozen after training, so
a text has an exact code length under each language; the shortest wins.

As they are frozen, each language's tree is compiled into sorted tables of its own:
the code lengths of the bytes seen in each context, and the cost of its escape.  A
block of text is scored by its distinct runs of four bytes.  Capitals A-Z count as
small letters.

The trees are counted by the executors over a hash sample of about ``fit_rows``
labelled rows of each language, whole texts (all rows of a language that has no
more), and compiled there, all contexts that share their last two bytes in one task.
All counts of the samples are kept: no language or context is dropped.

Defined cases: a null text, or one without a letter (Unicode category L; numerals are none), is ``und`` with score 0; ties
go to the first language in order; no labelled rows at all: every text is ``und``
with score 0; null ids are not held out; repeated rows are kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.kernels import slices
from corpusloom.llm.learning import held_out
from corpusloom.scratch import stored

ORDER = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


def _previous(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The bytes one, two and three places before each; 0 before a text's start."""
    out = []
    heads = offsets[:-1]
    for k in range(1, ORDER + 1):
        x = np.zeros(len(data), np.uint8)
        x[k:] = data[:-k] if k < len(data) else x[k:]
        for j in range(k):
            at = heads + j
            x[at[at < len(data)]] = 0
        out.append(x)
    return out


def count_grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (three bytes of context, byte) codes of some texts and their counts."""
    codes, counts = [], []
    for _, data, offsets in slices(column):
        data = _LOWER[data]
        p1, p2, p3 = (x.astype(np.uint32) for x in _previous(data, offsets))
        c, n = np.unique((p3 << 24) | (p2 << 16) | (p1 << 8) | data, return_counts=True)
        codes.append(c)
        counts.append(n)
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, where = np.unique(np.concatenate(codes), return_inverse=True)
    return code.astype(np.int64), np.bincount(where, np.concatenate(counts)).astype(np.int64)


@dataclass
class Tree:
    """The contexts of one language: one byte dense, two and three bytes as sorted codes."""

    one: np.ndarray  # last byte, next byte -> code length
    orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # contexts, cost of the escape, (context, byte) seen, code length

    def lengths(self, codes: np.ndarray) -> np.ndarray:
        """Code lengths of (three bytes of context, byte) codes."""
        out = self.one[codes & 0xFFFF]
        for order, (contexts, escape, seen, bits) in zip((2, 3), self.orders):
            if not len(contexts):
                continue
            code = codes & ((1 << 8 * (order + 1)) - 1)
            at = np.minimum(np.searchsorted(contexts, code >> 8), len(contexts) - 1)
            out = np.where(contexts[at] == code >> 8, out + escape[at], out)
            at = np.minimum(np.searchsorted(seen, code), len(seen) - 1)
            out = np.where(seen[at] == code, bits[at], out)
        return out


@dataclass
class Model:
    langs: list[str]
    trees: list[Tree]

    @property
    def bits(self) -> list[np.ndarray]:
        """For each language the code lengths of all 256 bytes after each of its contexts."""
        out = []
        for tree in self.trees:
            contexts = [np.arange(256), *(o[0] for o in tree.orders)]
            rows = []
            for order, c in enumerate(contexts, 1):
                part = Tree(tree.one, tree.orders[: order - 1])
                rows.append(part.lengths((c[:, None] << 8 | np.arange(256)).ravel()).reshape(-1, 256))
            out.append(np.concatenate(rows))
        return out

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Code lengths (text, language) in bits, and whether the text has a letter."""
        total, letters = np.zeros((len(column), len(self.langs))), np.zeros(len(column), bool)
        for first, data, offsets in slices(column):
            if not len(data):
                continue
            raw, data = data, _LOWER[data]
            p1, p2, p3 = (x.astype(np.uint32) for x in _previous(data, offsets))
            where, codes = pd.factorize((p3 << 24) | (p2 << 16) | (p1 << 8) | data)
            codes = codes.astype(np.int64)
            full = np.flatnonzero(np.diff(offsets))
            heads = offsets[full]
            for k, tree in enumerate(self.trees):
                total[first + full, k] = np.add.reduceat(tree.lengths(codes)[where], heads, dtype=np.float64)
            letters[first + full] = np.logical_or.reduceat(_LETTER[data], heads)
            for i in full[~letters[first + full]]:
                letters[first + i] = any(map(str.isalpha, raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
        return total, letters


def _ppm(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Distributions of contexts (rows) from their counts and the shorter contexts' distributions."""
    seen = counts > 0
    total, kinds = counts.sum(1, keepdims=True), seen.sum(1, keepdims=True)
    rest = np.where(seen, 0, lower)
    mass = rest.sum(1, keepdims=True)
    escape = np.where(mass > 0, kinds / np.maximum(total + kinds, 1), 0)
    scale = np.where(mass > 0, total + kinds, np.maximum(total, 1))
    mixed = np.where(seen, counts / np.maximum(scale, 1), escape * rest / np.where(mass > 0, mass, 1))
    return np.where(total > 0, mixed, lower)


def _order(codes: np.ndarray, n: np.ndarray, shorter: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tables of an order from its counts; (context, byte) codes are distinct and sorted."""
    contexts, at = np.unique(codes >> 8, return_inverse=True)
    total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
    # what the shorter context leaves to the bytes not seen here
    mass = np.maximum(1 - np.bincount(at, np.exp2(-shorter.lengths(codes)), len(contexts)), 0)
    few = np.flatnonzero(mass < 1e-3)
    if len(few):  # a difference of near numbers: add the unseen bytes instead
        seen = np.zeros((len(few), 256), bool)
        own = np.isin(at, few)
        seen[np.searchsorted(few, at[own]), codes[own] & 0xFF] = True
        lower = np.exp2(-shorter.lengths((contexts[few][:, None] << 8 | np.arange(256)).ravel())).reshape(-1, 256)
        mass[few] = np.where(seen, 0, lower).sum(1)
    left = mass > 0
    escape = np.log2(np.where(left, mass, 1)) - np.log2(np.where(left, kinds / (total + kinds), 1))
    bits = np.log2(np.where(left, total + kinds, total))[at] - np.log2(n)
    return contexts, escape, codes, bits


def _one(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Code lengths of a byte after each single byte, from counts of (byte, byte) codes."""
    p0 = _ppm(np.bincount(codes & 0xFF, n, 256)[None, :], np.full((1, 256), 1 / 256))
    return -np.log2(_ppm(np.bincount(codes, n, 65536).reshape(256, 256), np.repeat(p0, 256, 0))).ravel()


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, where = np.unique(codes, return_inverse=True)
    return code, np.bincount(where, n, len(code)).astype(np.int64)


def _longer(one: np.ndarray, codes: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The tables of two and three bytes of context from four-byte runs, all of each context of two."""
    out = Tree(one, [])
    for c, m in (_summed(codes & 0xFFFFFF, n), _summed(codes, n)):
        out.orders.append(_order(c, m, out))
    return out.orders


def tree(codes: np.ndarray, n: np.ndarray) -> Tree:
    """The tree of one language from distinct runs of four bytes and their counts."""
    one = _one(*_summed(codes & 0xFFFF, n))
    return Tree(one, _longer(one, codes, n))


def _joined(one: np.ndarray, parts: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]) -> Tree:
    """One tree from tables of different contexts."""
    out = Tree(one, [])
    for of_order in zip(*parts):
        contexts, escape, seen, bits = (np.concatenate(x) for x in zip(*of_order))
        by, order = np.argsort(contexts), np.argsort(seen)
        out.orders.append((contexts[by], escape[by], seen[order], bits[order]))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = 20_000, fit_chars: int = 100_000_000, most_chars: int = 1_000_000) -> Model | None:
    """Count the context trees over labelled rows that are not held out; None if there are none.

    Of each language some fit_rows rows, of some fit_chars characters in all, are learned
    from; texts of over most_chars are not drawn.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)) & (F.coalesce(F.length(text_col), F.lit(0)) <= most_chars))
    sizes = usable.groupBy(lang_col).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars")).collect()
    # the share of a language's rows that is drawn
    rows = {r[0]: min(1.0, fit_rows / r["n"], fit_chars / max(1, r["chars"])) for r in sizes}
    if not rows:
        return None
    # the draw of a row without an id, or of a copied id, is that of its text
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(8)), F.lit(1 << 40))
    shares = docs.sparkSession.createDataFrame([(k, int(share * (1 << 40))) for k, share in rows.items()], "_lang string, _share long")
    sample = usable.join(F.broadcast(shares), F.col(lang_col) == F.col("_lang")).where(draw < F.col("_share")).select(F.col("_lang"), text_col)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            for name in names.unique():
                code, n = count_grams(batch.column(1).filter(pa.compute.equal(names, name)))
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(code), pa.string()), pa.array(code), pa.array(n)], ["lang", "code", "n"])

    grams = stored(sample.mapInArrow(convert, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "grams")
    pairs = grams.groupBy("lang", F.col("code").bitwiseAND(0xFFFF).alias("code")).agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(pairs["lang"].unique().to_pylist())
    ones = {}
    for name in langs:
        own = pairs.filter(pa.compute.equal(pairs["lang"], name))
        ones[name] = _one(own["code"].to_numpy(), own["n"].to_numpy())
    held = docs.sparkSession.sparkContext.broadcast(ones)

    def compile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            counted = pa.Table.from_batches(got)
            for name in counted["lang"].unique():
                own = counted.filter(pa.compute.equal(counted["lang"], name))
                part = _longer(held.value[name.as_py()], own["code"].to_numpy(), own["n"].to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([pickle.dumps(part)], pa.binary())], ["lang", "part"])

    # the counts below each context of two bytes meet in one task; the driver puts the tables together
    parts: dict[str, list] = {name: [] for name in langs}
    for r in grams.repartition("lang", F.shiftright("code", 8).bitwiseAND(0xFFFF)).mapInArrow(compile, "lang string, part binary").collect():
        parts[r["lang"]].append(pickle.loads(r["part"]))
    return Model(langs, [_joined(ones[k], parts[k]) for k in langs]) if langs else None


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, lang_pred, score, bits): score is the posterior of the prediction, bits its code length."""
    held = model and docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            names, score, bits = ["und"] * n, np.zeros(n), np.zeros(n)
            if held:
                m = held.value
                total, letters = m.score(batch.column(2))
                best = total.argmin(1)
                bits = total[np.arange(n), best]
                score = np.where(letters, 1 / np.exp2(np.maximum(bits[:, None] - total, -1000)).sum(1), 0.0)
                names = [m.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(bits)], [id_col, "held_out", "lang_pred", "score", "bits"])

    return docs.select(id_col, held_out(F.col(id_col)).alias("held_out"), text_col).mapInArrow(convert, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, bits double")
