"""SimHash near-duplicates: Golay-code fuzzy hashing of fingerprint segments.

The 64 bits of a fingerprint are cut into three segments of at most 23 bits.
The perfect binary Golay code [23, 12, 7] puts each segment, padded with zeros,
within three bits of exactly one codeword, whose 12-bit index is its key.

Two fingerprints that differ in at most four bits meet at a word that differs
from either in at most two, whatever the errors' places.  So each fingerprint
takes as keys the index triples of all words within two flips: none, one flip in
any segment, two in one segment, or one in each of two segments (the pigeonhole
over segments).  Neighbouring words mostly decode to the same codewords, so the
2081 words give at most 139 keys of 36 bits.  Equal keys make candidates; each
candidate is verified by its Hamming distance.  No pair within the distance is
missed and none beyond it is kept.

Only distinct fingerprints take part; copies join their fingerprint's component
at the end.  A bucket of equal keys is not expanded into pairs: a breadth-first
search inside it compares each member only with the members not reached yet and
gives the edges of a spanning forest, so a group of m mutual near copies costs
about m comparisons and gives m - 1 edges.  Buckets that a sample of the fingerprints shows to be large
are dealt into blocks, and each pair of blocks is searched by itself: which keys
these are changes where the search runs, not what it finds.

Defined cases: texts without words, empty or null have fingerprint 0 and are
linked like any other; fewer than four words give one shingle of all words; null
document ids take part but never name a component unless all its ids are null;
rows that repeat are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tables import by_position, place
from corpusloom.operators.components import connected_components
from corpusloom.scratch import checkpoint, lookup, stored

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the binary Golay code (fixed value).
GOLAY = 0b110001110101
#: Bits of the three segments, from the lowest.
SEGMENTS = (22, 21, 21)
#: Shingles whose bits are counted at once.
BLOCK = 16384
#: Fingerprints whose keys one task makes.
KEY_ROWS = 16_384
#: Members beyond which a key's bucket is searched in blocks, and the most blocks; one in SAMPLED fingerprints tells which keys have as many.
BUCKET = 50_000
MOST_BLOCKS = 4096
SAMPLED = 64

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, n: int = 4) -> int:
    """SimHash of one text: a bit is 1 if it is set in over half of the shingle hashes."""
    found = (text or "").encode().translate(_LOWER).split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= n:
        return xxhash.xxh64_intdigest(line, 42)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: len(found) - n + 1].tolist(), ends[n - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(first), BLOCK):
        hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK])), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(first), bitorder="little").tobytes(), "little")


def _check(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4) -> DataFrame:
    """(id_col, fp, check): the signed 64-bit fingerprint of each row's whole text, and a hash of the text."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t, n) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), batch.column(2)], [id_col, "fp", "check"])

    return docs.select(id_col, text_col, _check(text_col)).mapInArrow(convert, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long, check long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder modulo the generator polynomial."""
    words = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        words = np.where(words >> np.uint32(bit) & np.uint32(1), words ^ np.uint32(GOLAY << (bit - 11)), words)
    return words


class Golay:
    """Decoding by a table of the 2048 syndromes; the index of a codeword is its upper 12 bits."""

    def __init__(self) -> None:
        single = np.uint32(1) << np.arange(23, dtype=np.uint32)
        pairs = (single[:, None] | single[None, :]).ravel()
        patterns = np.unique(np.concatenate([[0], pairs, (pairs[:, None] | single[None, :]).ravel()])).astype(np.uint32)
        self.leader = np.zeros(2048, np.uint32)
        self.leader[_syndromes(patterns)] = patterns
        self.flip = _syndromes(single)

    def index(self, words: np.ndarray, syndromes: np.ndarray) -> np.ndarray:
        return (words ^ self.leader[syndromes]) >> np.uint32(11)

    def balls(self, words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices of each word itself, of its one-flip and of its two-flip neighbours (a column each)."""
        s = _syndromes(words)
        single = np.uint32(1) << np.arange(bits, dtype=np.uint32)
        one = self.index(words[:, None] ^ single, s[:, None] ^ self.flip[:bits])
        i, j = np.triu_indices(bits, 1)
        two = self.index(words[:, None] ^ (single[i] | single[j]), s[:, None] ^ (self.flip[i] ^ self.flip[j]))
        return self.index(words, s), one, two


def _distinct(rows: np.ndarray) -> Iterator[np.ndarray]:
    """Columns of the row-wise distinct values; a repeated value is -1."""
    rows = np.sort(rows.astype(np.int64), axis=1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = -1
    keep = -np.sort(-rows, axis=1)
    return (keep[:, i] for i in range(int((keep >= 0).sum(axis=1).max(initial=0))))


def segment_keys(prints: np.ndarray, golay: Golay) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of all keys of unsigned 64-bit fingerprints."""
    shift, segs = 0, []
    for bits in SEGMENTS:
        segs.append(((prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.uint32))
        shift += bits
    balls = [golay.balls(s, b) for s, b in zip(segs, SEGMENTS)]
    base = [b[0].astype(np.int64) for b in balls]
    rows = np.arange(len(prints))

    def others(own: np.ndarray, near: np.ndarray, skip: np.ndarray | None = None) -> list[np.ndarray]:
        near = near.astype(np.int64)
        near[near == own[:, None]] = -1
        if skip is not None:
            for c in skip.T:
                near[near == c[:, None]] = -1
        return list(_distinct(near))

    one = [others(base[k], balls[k][1]) for k in range(3)]
    two = [others(base[k], balls[k][2], np.stack(one[k], 1) if one[k] else None) for k in range(3)]

    def key(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (a >= 0) & (b >= 0) & (c >= 0)
        return rows[ok], (a[ok] << 24) | (b[ok] << 12) | c[ok]

    yield key(*base)
    for k in range(3):
        for near in (*one[k], *two[k]):
            yield key(*(near if i == k else base[i] for i in range(3)))
    for k, m in ((0, 1), (0, 2), (1, 2)):
        for x in one[k]:
            for y in one[m]:
                yield key(*(x if i == k else y if i == m else base[i] for i in range(3)))


def spanning_edges(members: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a forest that connects exactly what links within the distance connect."""
    out, rest = [], members
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                found = rest[near]
                out.append((np.full(len(found), x), found))
                frontier.extend(found)
                rest = rest[~near]
    return out


def near_edges(prints: DataFrame, distance: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(src, dst) between distinct fingerprints (column fp); they connect what links within distance <= 4 connect."""
    if not 0 <= distance <= 4:
        raise ValueError("the keys are complete for distances from 0 to 4")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                found = list(segment_keys(part.view(np.uint64), golay))
                row, key = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], ["key", "fp"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []

        def closed(key_members: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            members = np.unique(np.concatenate(key_members)).view(np.uint64)
            if len(members) > 1 and (e := spanning_edges(members, distance)):
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*e))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            if held and key[0] == held_key:
                held.append(fp[: cuts[1]].copy())
                cuts = cuts[1:]
            if len(cuts) > 1:
                if held:
                    yield from closed(held)
                held_key, held = key[-1], [fp[cuts[-2] :].copy()]
                runs = np.flatnonzero(np.diff(cuts[:-1]) > 1)
                twos = runs[np.diff(cuts[:-1])[runs] == 2]
                a, b = fp[cuts[twos]], fp[cuts[twos] + 1]
                near = (np.bitwise_count((a ^ b).view(np.uint64)) <= distance) & (a != b)
                if near.any():
                    a, b = a[near], b[near]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["src", "dst"])
                for r in runs[np.diff(cuts[:-1])[runs] > 2]:
                    yield from closed([fp[cuts[r] : cuts[r + 1]]])
        if held:
            yield from closed(held)

    def keyed(part: DataFrame) -> DataFrame:
        return part.select("fp").mapInArrow(keys, "key long, fp long")

    pairs = keyed(prints)
    sampled = keyed(prints.where(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(SAMPLED)) == 0))
    crowded = stored(sampled.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLED > bucket), "crowded")
    if not crowded.isEmpty():
        # dealt into blocks; each pair of blocks is searched as a bucket of its own
        blocks = crowded.select("key", F.least(F.ceil(F.col("n") * SAMPLED / bucket), F.lit(MOST_BLOCKS)).alias("_m"))
        pairs = pairs.join(lookup(blocks, "blocks"), "key", "left").withColumn("_b", F.pmod(F.xxhash64("fp"), F.coalesce("_m", F.lit(1))))
        pairs = pairs.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_m", F.lit(1)) - 1)))
        pair = F.least("_b", "_o") * MOST_BLOCKS + F.greatest("_b", "_o")
        pairs = pairs.select((F.col("key") * (MOST_BLOCKS * MOST_BLOCKS) + pair).alias("key"), "fp")
    return pairs.repartition("key").sortWithinPartitions("key").mapInArrow(links, "src long, dst long").distinct()


def _components(docs: DataFrame, id_col: str, text_col: str, distance: int, n: int) -> DataFrame:
    """(id_col, fp, check, part, component_id) for each row; part names a group, check is a hash of the row's text."""
    marked = stored(fingerprints(docs, id_col, text_col, n), "simhash")
    prints = stored(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "prints")
    # by number, not by bytes: a fingerprint becomes some hundred keys
    spread = prints.repartition(max(1, math.ceil(prints.count() / KEY_ROWS)), "fp")
    edges = checkpoint(near_edges(spread, distance))
    parts = connected_components(edges).select(F.col("node").alias("fp"), F.col("component").alias("part"))
    linked = stored(prints.join(parts, "fp"), "linked")
    # stored, so that the join has two plain shuffles and a group with a large share of the fingerprints is split
    named = stored(linked.groupBy("part").agg(F.min("least").alias("component_id")), "named")
    owner = linked.select("fp", "part").join(named, "part")
    # one row for each linked fingerprint; a fingerprint with many rows is split by adaptive skew handling
    alone = prints.select(F.col("fp"), F.col("least"))
    named_prints = stored(alone.join(owner, "fp", "left").select("fp", F.coalesce("part", "fp").alias("part"), F.when(F.col("part").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")), "owners")
    return marked.join(named_prints, "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, n: int = 4) -> DataFrame:
    """(id_col, fingerprint, component_id) for each row."""
    parts = _components(docs, id_col, text_col, distance, n)
    return parts.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, n: int = 4) -> DataFrame:
    """The rows of docs that represent their groups, one of each, with all their columns.

    It is the row with the smallest id; of rows that share it, the one whose text's hash
    is least, and one of those that repeat both.  A row without an id represents a
    group only where no row has one.
    """
    plain, key, text = by_position(docs), place(docs, id_col), place(docs, text_col)
    own = F.concat_ws(":", F.isnull(key).cast("string"), F.col(key).cast("string"), _check(text).cast("string"))
    parts = _components(docs, id_col, text_col, distance, n)
    best = F.min(F.struct(F.isnull(id_col), F.col(id_col), F.col("check")))
    kept = parts.groupBy("part").agg(best.alias("best")).select(
        F.concat_ws(":", F.isnull(f"best.{id_col}").cast("string"), F.col(f"best.{id_col}").cast("string"), F.col("best.check").cast("string")).alias("_own"))
    marked = plain.select(own.alias("_own"), F.struct(*plain.columns).alias("_row"))
    return marked.join(kept.distinct(), "_own", "left_semi").dropDuplicates(["_own"]).select("_row.*").toDF(*docs.columns)
