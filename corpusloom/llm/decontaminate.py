"""Benchmark decontamination by pigeonhole edit matching.

A document is contaminated by an item if some passage of it is within k edits of
the item, k being ``rate`` (a tenth by default) of the item's characters.  Texts
are compared in a normal form: lower case, every run of other characters than
letters and digits a single space.

If an item is cut into k + 1 pieces, k edits leave at least one piece whole.
Whole pieces are found by rolling hashes: pieces have at most a few distinct
lengths, a bit table of the piece hashes of a length drops almost all positions,
and the rest are looked up and compared exactly.  A hit is verified by Myers'
bit-parallel edit distance for substrings on growing ranges of pieces: if j
neighbouring pieces together have under j errors, so has one half of them for its
own number, so a match passes every range on some path from a whole piece to the
item, and chance hits fail on the first short one.

Items whose normal form has under ``min_chars`` characters have no error budget:
they match where they stand as whole words.

The items' texts are held by the driver and each task if they have at most
``BENCHMARK_CHARS`` characters; a larger benchmark stays a table, of which groups of that size are
taken one after the other, and the documents are read once for each.  Items are searched in
blocks of at most ``MAX_ITEMS`` items and ``MAX_CHARS`` characters (a longer item is
a block of its own); with more than one block a task gathers some documents and
searches them for one block after the other.  Documents are read in one narrow
pass, without a shuffle, in parts that overlap by the longest passage, so long
documents need no more memory than short ones.

Defined cases: null and empty items, and items without a letter or digit, match
nothing; null and empty texts are clean; repeated
items count once for each id; repeated rows are kept; an empty benchmark leaves
everything clean.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.tables import by_position, place
from corpusloom.scratch import stored

RATE = 0.1
#: Characters of normal form scanned at once.
BLOCK = 250_000
#: Items and their characters that are compiled at once, and characters of documents held for several such blocks.
MAX_ITEMS, MAX_CHARS, HELD_CHARS = 20_000, 4_000_000, 50_000_000
#: Characters of items that the driver and a task hold at once.
BENCHMARK_CHARS = 50_000_000
_OTHER = re.compile(r"[\W_]+")
#: Multiplier of the rolling hash (fixed value).
_BASE = 0x9E3779B1
TABLE_BITS = 22


def _by_id(found: tuple[object, int]) -> tuple[bool, object]:
    return isinstance(found[0], str), found[0]


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def myers(pattern_masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern of m characters to any substring of text, and where it first ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, ch in enumerate(text):
        eq = pattern_masks.get(ch, 0)
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        hp = minus | (~(d0 | plus) & full)
        hn = d0 & plus
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
            if score < best:
                best, end = score, j + 1
        hp = (hp << 1) & full
        plus = ((hn << 1) | (~(d0 | hp))) & full
        minus = d0 & hp
    return best, end


class Item:
    """A benchmark item with the pieces of its error budget and the halving tree over them."""

    def __init__(self, key: object, text: str, rate: float):
        self.key, self.text, self.budget, self.whole_words = key, text, int(len(text) * rate), False
        self.cuts = [round(i * len(text) / (self.budget + 1)) for i in range(self.budget + 2)]
        self._nodes: dict[tuple[int, int], dict[str, int]] = {}
        self._sides: dict[int, tuple[int, int, list[str]]] = {}

    def beside(self, text: str, at: int, piece: int) -> bool:
        """False if the range above a piece is certainly beyond its budget of k: its other half, cut
        into k + 1 parts, has none of them whole within k places."""
        side = self._sides.get(piece)
        if side is None:
            path = self.path(piece)
            if not path:
                side = (0, 0, [""])
            else:
                lo, hi = path[0]
                a, b = (piece + 1, hi) if piece == lo else (lo, piece) if piece == hi - 1 else (lo, hi)
                k, start, size = hi - lo - 1, self.cuts[a], self.cuts[b] - self.cuts[a]
                cuts = [start + round(i * size / (k + 1)) for i in range(k + 2)]
                side = (start - self.cuts[piece] - k, size + 2 * k, [self.text[x:y] for x, y in zip(cuts, cuts[1:])])
            self._sides[piece] = side
        shift, size, parts = side
        window = text[max(0, at + shift) : max(0, at + shift + size)]
        return any(part in window for part in parts)

    def path(self, piece: int) -> list[tuple[int, int]]:
        """The nodes above a piece, from the smallest; a node is a range of pieces."""
        lo, hi, out = 0, self.budget + 1, []
        while hi - lo > 1:
            out.append((lo, hi))
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if piece < mid else (mid, hi)
        return out[::-1]

    def masks(self, lo: int, hi: int) -> dict[str, int]:
        found = self._nodes.get((lo, hi))
        if found is None:
            found = defaultdict(int)
            for i, ch in enumerate(self.text[self.cuts[lo] : self.cuts[hi]]):
                found[ch] |= 1 << i
            self._nodes[lo, hi] = found
        return found

    def verify(self, text: str, at: int, piece: int, known: dict[tuple[int, int, int], int]) -> int | None:
        """Edit distance of the item to the text around a whole piece found at place at; None beyond the budget.

        If a range of j pieces has under j errors, so has one of its halves for
        its own number; so only hits whose every node passes can be matches.
        known keeps the distances of a node at a place of this text for its other pieces.
        """
        distance = 0 if self.budget == 0 else None
        for lo, hi in self.path(piece):
            k = hi - lo - 1
            start = at - (self.cuts[piece] - self.cuts[lo])
            m = self.cuts[hi] - self.cuts[lo]
            distance = known.get((lo, hi, start))
            if distance is None:
                distance = known[lo, hi, start] = myers(self.masks(lo, hi), m, text[max(0, start - k) : start + m + k])[0]
            if distance > k:
                return None
        return distance


class Matcher:
    """Finds the items that some passage of a text is within the error budget of."""

    def __init__(self, items: list[tuple[object, str]], rate: float = RATE, min_chars: int = 40):
        self.items: list[Item] = []
        by_length: dict[int, dict[str, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for key, text in items:
            text = normal(text)
            if not text:
                continue
            item = Item(key, text, rate if len(text) >= min_chars else 0.0)
            item.whole_words = len(text) < min_chars
            for j, (a, b) in enumerate(zip(item.cuts, item.cuts[1:])):
                by_length[b - a][text[a:b]].append((len(self.items), j))
            self.items.append(item)
        self.longest = max((len(x.text) + 2 * x.budget for x in self.items), default=0)
        self.up = self.down = np.ones(1, np.uint32)
        self.lengths = []
        for n, table in sorted(by_length.items()):
            bits = np.zeros(1 << TABLE_BITS, bool)
            chars = np.array([list(map(ord, p)) for p in table], np.uint32)
            up, _ = self._powers(n)
            bits[self._slots((chars * up[:n]).sum(1, dtype=np.uint32))] = True
            self.lengths.append((n, bits, dict(table)))

    @staticmethod
    def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 32)):
            x = np.full(n, base, np.uint32)
            x[:1] = 1
            out.append(np.multiply.accumulate(x, dtype=np.uint32))
        return out[0], out[1]

    @staticmethod
    def _slots(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - TABLE_BITS)

    def _hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, piece, place) of each whole piece in a block."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(self.up) < len(codes) + 1:
            self.up, self.down = self._powers(2 * len(codes) + 2)
        sums = np.zeros(len(codes) + 1, np.uint32)
        np.cumsum(codes * self.up[: len(codes)], out=sums[1:], dtype=np.uint32)
        for n, bits, table in self.lengths:
            if len(codes) < n:
                continue
            h = (sums[n:] - sums[:-n]) * self.down[: len(codes) - n + 1]
            for at in np.flatnonzero(bits[self._slots(h)]).tolist():
                for item, piece in table.get(text[at : at + n], ()):
                    yield item, piece, at

    def search_all(self, texts: list[str | None]) -> list[list[tuple[int, int]]]:
        """For each text the (item id, distance) of the items that it contains."""
        found: list[dict[int, int]] = [{} for _ in texts]
        if not self.items:
            return [[] for _ in texts]
        parts: list[str] = []
        owner: list[tuple[int, bool, bool]] = []
        size = 0
        step = max(BLOCK, self.longest)
        for i, t in enumerate(texts):
            whole = normal(t)
            for a in range(0, max(1, len(whole)), step):
                # a character more on both sides tells whether a word ends there
                parts.append(whole[max(0, a - 1) : a + step + self.longest + 1])
                owner.append((i, a == 0, a + step + self.longest + 1 >= len(whole)))
                size += len(parts[-1])
                if size > BLOCK:
                    self._block(parts, owner, found)
                    parts, owner, size = [], [], 0
        if parts:
            self._block(parts, owner, found)
        return [sorted(f.items(), key=_by_id) for f in found]

    def _block(self, parts: list[str], owner: list[tuple[int, bool, bool]], found: list[dict[int, int]]) -> None:
        """owner: for each part its text, and whether it has the text's start and its end."""
        heads = np.cumsum([0, *(len(p) + 1 for p in parts)])
        known: dict[tuple[int, int], dict[tuple[int, int, int], int]] = defaultdict(dict)
        for number, piece, at in self._hits("\n".join(parts)):  # no normal form has a line break
            part = bisect_right(heads, at) - 1
            of, start, end = owner[part]
            item, got = self.items[number], found[of]
            if got.get(item.key) == 0:
                continue
            place = at - int(heads[part])
            if item.whole_words:
                text, stop = parts[part], place + len(item.text)
                if (text[place - 1] == " " if place else start) and (text[stop] == " " if stop < len(text) else end):
                    got[item.key] = 0
                continue
            if not item.beside(parts[part], place, piece):
                continue
            distance = item.verify(parts[part], place, piece, known[number, part])
            if distance is not None and distance < got.get(item.key, item.budget + 1):
                got[item.key] = distance

    def search(self, text: str | None) -> list[tuple[int, int]]:
        return self.search_all([text])[0]


def benchmark_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", most_chars: int = BENCHMARK_CHARS) -> list[tuple[object, str]] | DataFrame:
    """The items: on the driver if they have at most most_chars characters together, else as a table."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) > most_chars:
        return items
    return [(r[0], r[1]) for r in items.orderBy("item_id", "text").collect()]


def _groups(items: DataFrame, most_chars: int) -> Iterator[list[tuple[object, str]]]:
    """A table of items in groups of some most_chars characters; the driver holds one at a time."""
    n = -(-items.agg(F.sum(F.length("text"))).first()[0] // most_chars)
    for g in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == g)
        yield [(r[0], r[1]) for r in part.orderBy("item_id", "text").collect()]


def _hits(rows: DataFrame, items: DataFrame, text_col: str, rate: float, most_chars: int) -> DataFrame:
    """(_row, item_ids, least_distance) of the contaminated of numbered rows, which are read once for each group of items."""
    found = None
    for group in _groups(items, most_chars):
        whole = isinstance(items.schema["item_id"].dataType, T.IntegralType)
        part = stored(_contamination(rows, group, "_row", text_col, rate, whole).where("contaminated").select("_row", "item_ids", "least_distance"), "hits")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.min("least_distance").alias("least_distance"))


def item_blocks(items: list[tuple[object, str]], max_items: int = MAX_ITEMS, max_chars: int = MAX_CHARS) -> list[list[tuple[object, str]]]:
    """The items in blocks of bounded size; an item of more characters is a block of its own."""
    blocks: list[list[tuple[object, str]]] = []
    size = 0
    for key, text in items:
        n = len(text or "")
        if not blocks or len(blocks[-1]) == max_items or size + n > max_chars:
            blocks.append([])
            size = 0
        blocks[-1].append((key, text))
        size += n
    return blocks


def searched(batches: Iterator[pa.RecordBatch], at: int, blocks: list[list[tuple[object, str]]], rate: float, held_chars: int = HELD_CHARS) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[int, int]]]]]:
    """Each batch with what search_all() finds in its column at, over all blocks of items."""
    if len(blocks) <= 1:
        matcher = Matcher(blocks[0] if blocks else [], rate)
        for batch in batches:
            yield batch, matcher.search_all(batch.column(at).to_pylist())
        return
    some: list[pa.RecordBatch] = []
    size = 0

    def flush() -> Iterator[tuple[pa.RecordBatch, list[list[tuple[int, int]]]]]:
        found: list[list[dict[int, int]]] = [[{} for _ in range(b.num_rows)] for b in some]
        for block in blocks:
            matcher = Matcher(block, rate)
            for batch, rows in zip(some, found):
                for row, new in zip(rows, matcher.search_all(batch.column(at).to_pylist())):
                    for key, distance in new:
                        row[key] = min(distance, row.get(key, distance))
        for batch, rows in zip(some, found):
            yield batch, [sorted(r.items(), key=_by_id) for r in rows]

    for batch in batches:
        some.append(batch)
        size += batch.column(at).nbytes
        if size >= held_chars:
            yield from flush()
            some, size = [], 0
    yield from flush()


def contamination(docs: DataFrame, items: list[tuple[object, str]] | DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, most_chars: int = BENCHMARK_CHARS) -> DataFrame:
    """(id_col, contaminated, n_items, item_ids, least_distance) for each row; ids of items that are not all integers come as text."""
    if not isinstance(items, DataFrame):
        return _contamination(docs, items, id_col, text_col, rate, all(isinstance(k, int) for k, _ in items))
    rows = stored(docs.select(F.monotonically_increasing_id().alias("_row"), id_col, text_col), "rows")
    every = rows.select("_row", id_col).join(_hits(rows, items, text_col, rate, most_chars), "_row", "left")
    none = F.array().cast("array<long>" if isinstance(items.schema["item_id"].dataType, T.IntegralType) else "array<string>")
    ids = F.coalesce("item_ids", none)
    return every.select(id_col, F.col("item_ids").isNotNull().alias("contaminated"), F.size(ids).alias("n_items"), ids.alias("item_ids"), "least_distance")


def _contamination(docs: DataFrame, items: list[tuple[object, str]], id_col: str, text_col: str, rate: float, whole: bool) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(items)
    kind = docs.schema[id_col].dataType.simpleString()
    listed = pa.list_(pa.int64() if whole else pa.string())

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in searched(batches, 1, item_blocks(held.value), rate):
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([bool(f) for f in found]),
                pa.array([len(f) for f in found], pa.int32()),
                pa.array([[i if whole else str(i) for i, _ in f] for f in found], listed),
                pa.array([min((d for _, d in f), default=None) for f in found], pa.int32()),
            ], [id_col, "contaminated", "n_items", "item_ids", "least_distance"])

    return docs.select(id_col, text_col).mapInArrow(convert, f"`{id_col}` {kind}, contaminated boolean, n_items int, item_ids array<{'long' if whole else 'string'}>, least_distance int")


def keep_uncontaminated(docs: DataFrame, items: list[tuple[object, str]] | DataFrame, text_col: str = "text", rate: float = RATE, most_chars: int = BENCHMARK_CHARS) -> DataFrame:
    """The rows of docs that contain no item, with all their columns; nothing is shuffled but for a table of items, where rows of hits are."""
    if isinstance(items, DataFrame):
        rows = stored(by_position(docs).withColumn("_row", F.monotonically_increasing_id()), "rows")
        hits = _hits(rows, items, place(docs, text_col), rate, most_chars)
        return rows.join(hits.select("_row"), "_row", "left_anti").drop("_row").toDF(*docs.columns)
    held = docs.sparkSession.sparkContext.broadcast(items)
    plain, at = by_position(docs), docs.columns.index(text_col)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in searched(batches, at, item_blocks(held.value), rate):
            yield batch.filter(pa.array([not f for f in found], pa.bool_()))

    return plain.mapInArrow(convert, plain.schema).toDF(*docs.columns)
