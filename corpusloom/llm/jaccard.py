"""N-gram Jaccard join: rare-first prefix filtering, each pair verified at most once.

A document's set is that of its distinct word n-grams (64-bit hashes).  Documents with equal
sets are one class, named by a 128-bit digest of the set; everything below is done once for a class.

* Rare first: n-grams are ordered by the number of documents that have them, then by hash.
  The number is read from a count-min table of a fixed size over all documents; any
  one order keeps the filters exact, and this one puts what many documents share last.
* Prefix filter: of a set of n, two sets of Jaccard t can only link if they share one of their first
  n - ceil(t n) + 1 n-grams.  Only these become rows; those of one class alone are dropped.
* Length, positional and suffix filters, inside a prefix n-gram's bucket: sizes
  within t; the places of the shared n-gram leave room for the overlap; and the sets' sizes in
  fixed ranges of hashes (64 of them) differ by no more in all than two linked sets can.
* A bucket is not expanded into pairs: a search inside it gives the edges of a forest that
  connects what the filters connect.  The trees of all buckets make clusters; whatever links lies inside one.
* Clusters are searched again in the same way by the suffix filter with as many ranges as a set's size asks
  for (some eight n-grams in each), as 64 tell large sets apart badly; they fall into finer ones.
* Verification: inside a cluster, sets are met exactly; a search compares each set
  only with those it has not yet been connected to, so a pair is verified at most
  once and m mutual near copies give m - 1 links.

A bucket or cluster may hold a large share of all classes.  It is dealt into blocks of bounded
size, and each pair of blocks is searched in a task of its own: a class is copied once for each block, and
pairs are never rows.  Sets are made again from the texts of clusters' classes; a bitmap
of fixed size over the classes' names spares the others' sets the shuffle.

Defined cases: a null or empty text, or one without words, has an empty set and is linked
with nothing; fewer than n words are one n-gram; rows without an id take part but never name
a component unless all its ids are null; repeated rows are kept; an empty table gives an empty result; columns
but the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.kernels import WordSums, slices, word_hashes, words
from corpusloom.operators.components import connected_components
from corpusloom.scratch import checkpoint, discard, lookup, stored

#: Words of an n-gram, and the least Jaccard similarity of a link in hundredths.
WORDS = 3
PERCENT = 90
#: Counters of each of the two rows of the count-min table, as a power of two, and counters of a piece of it.
COUNTER_BITS = 18
PIECE = 1 << 14
#: Ranges of hashes of the suffix filter inside buckets; inside clusters there are up to MOST_RANGES, a power of two.
RANGES = 64
MOST_RANGES = 8192
#: Classes of a bucket, and classes and n-grams of a cluster, that are searched as one block.
BUCKET_CLASSES = 512
CLUSTER_CLASSES = 1024
CLUSTER_NGRAMS = 1_000_000
#: Bits of the bitmap of names, as a power of two.
BITMAP_BITS = 24

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U64 = np.uint64


def ngram_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of each row that has a word."""
    for first, data, offsets in slices(column):
        data = _LOWER[data]
        starts, ends, heads = words(data, offsets)
        if not len(starts):
            continue
        sums = WordSums(word_hashes(data, starts, ends))
        grams = sums.grams(n)
        for d in np.flatnonzero(np.diff(heads)):
            a, b = int(heads[d]), int(heads[d + 1])
            yield first + int(d), np.unique(grams[a : b - n + 1]) if b - a >= n else sums.ranges(np.array([a]), b - a)


def _name(grams: np.ndarray) -> bytes:
    return blake2b(grams.tobytes(), digest_size=16).digest()


def _counters(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of n-grams in the two rows of the count-min table."""
    return (grams >> _U64(64 - COUNTER_BITS)).astype(np.int64), ((grams >> _U64(20)) & _U64((1 << COUNTER_BITS) - 1)).astype(np.int64) + (1 << COUNTER_BITS)


def document_counts(docs: DataFrame, text_col: str, n: int) -> np.ndarray:
    """The count-min table of the numbers of documents that have an n-gram, over all documents.

    A task adds up its documents' counters; their pieces are summed by number, so
    what is shuffled and collected depends on the table's size, not on the texts.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 << COUNTER_BITS, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def add() -> None:
            for places in _counters(np.concatenate(held)):
                np.add(table, np.bincount(places, minlength=len(table)), out=table)

        for batch in batches:
            for _, grams in ngram_sets(batch.column(0), n):
                held.append(grams)
                size += len(grams)
                if size > 1_000_000:
                    add()
                    held, size = [], 0
        if held:
            add()
        for i in range(0, len(table), PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([table[i : i + PIECE].tobytes()], pa.binary())], ["piece", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[piece] = total.get(piece, 0) + np.frombuffer(counts.as_buffer(), np.int64)
        for piece, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([counts.tobytes()], pa.binary())], ["piece", "counts"])

    table = np.zeros(2 << COUNTER_BITS, np.int64)
    pieces = docs.select(text_col).mapInArrow(counted, "piece long, counts binary").repartition("piece")
    for r in pieces.mapInArrow(summed, "piece long, counts binary").collect():
        table[r["piece"] : r["piece"] + PIECE] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(table, (1 << 32) - 1).astype(np.uint32)


def _sizes(grams: np.ndarray, ranges: int) -> np.ndarray:
    """The number of n-grams in each range of hashes; halves of the array added up are those of half as many ranges."""
    return np.bincount((grams >> _U64(8)).astype(np.int64) & (ranges - 1), minlength=ranges)


def _least(n: int, percent: int) -> int:
    """The smallest size of a set that a set of n can link with."""
    return -(-percent * n // 100)


def signed_sets(docs: DataFrame, counts: np.ndarray, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """(id_col, n, key, prefix, coarse, ranges): size and name of each row's set, its prefix, rarest first, and its sizes in few and in more ranges of hashes."""
    held = docs.sparkSession.sparkContext.broadcast(counts)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            rows: list[tuple[int, int, bytes, np.ndarray, bytes, bytes]] = []
            size = done = 0

            def flush(stop: int) -> Iterator[pa.RecordBatch]:
                at = {r[0]: r for r in rows}
                kept = [at.get(i, (i, 0, None, None, None, None)) for i in range(done, stop)]
                if kept:
                    _, n_col, keys, prefixes, coarse, ranges = zip(*kept)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[done:stop], pa.array(n_col, pa.int64()), pa.array(keys, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(coarse, pa.binary()), pa.array(ranges, pa.binary())],
                        [id_col, "n", "key", "prefix", "coarse", "ranges"])

            for row, grams in ngram_sets(batch.column(1), n):
                m = len(grams)
                if _least(m, percent) == m and percent * (m + 1) > 100 * m:
                    prefix = grams[:0]  # too small to link with another set
                else:
                    one, two = _counters(grams)
                    order = np.argsort(np.minimum(table[one], table[two]), kind="stable")  # grams are in order of their hashes
                    prefix = grams[order[: m - _least(m, percent) + 1]]
                fine = _sizes(grams, max(RANGES, min(MOST_RANGES, 1 << (m // 8).bit_length()))) if len(prefix) else grams[:0]
                coarse = np.minimum(fine.reshape(-1, RANGES).sum(0), 255).astype(np.uint8)
                rows.append((row, m, _name(grams), prefix.view(np.int64), coarse.tobytes(), np.minimum(fine, 65535).astype(np.uint16).tobytes()))
                size += len(prefix)
                if size > 50_000:
                    yield from flush(row + 1)
                    rows, size, done = [], 0, row + 1
            yield from flush(batch.num_rows)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(convert, f"`{id_col}` {kind}, n long, key binary, prefix array<long>, coarse binary, ranges binary")


def _needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that links sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def _forest(m: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Edges of a forest that connects what near(x, others) connects; it never sees a pair twice."""
    a, b, rest = [], [], np.arange(m)
    while len(rest) > 1:
        frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            ok = near(x, rest)
            if ok.any():
                found = rest[ok].tolist()
                a += [x] * len(found)
                b += found
                frontier += found
                rest = rest[~ok]
    return a, b


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (equal first width columns, rows in order of them) and the groups' first rows, and one more."""
    left: list[pa.RecordBatch] = []
    for batch in (*batches, None):
        if batch is not None and not batch.num_rows:
            continue
        if batch is not None and left:
            same = all(left[-1].column(i)[-1].as_py() == batch.column(i)[-1].as_py() for i in range(width))
            if same:  # the open group goes on
                left.append(batch)
                continue
        if batch is not None:
            left.append(batch)
        if not left:
            continue
        table = pa.Table.from_batches(left)
        values = [table.column(i).combine_chunks() for i in range(width)]
        codes = [v.dictionary_encode().indices.to_numpy(zero_copy_only=False) for v in values]
        change = np.zeros(table.num_rows - 1, bool)
        for c in codes:
            change |= c[1:] != c[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])
        if batch is not None:  # the last group may go on
            last = int(cuts[-2])
            left = table.slice(last).to_batches()
            table, cuts = table.slice(0, last), cuts[:-1]
        if len(cuts) > 1:
            yield table.combine_chunks(), cuts


def _edges_of(table: pa.Table, at: list[int], to: list[int]) -> pa.RecordBatch:
    keys = table.column("key").combine_chunks()
    a, b = keys.take(pa.array(at, pa.int64())).to_pylist(), keys.take(pa.array(to, pa.int64())).to_pylist()
    return pa.RecordBatch.from_arrays([pa.array(list(map(min, a, b)), pa.binary()), pa.array(list(map(max, a, b)), pa.binary())], ["src", "dst"])


def _dealt(rows: DataFrame, blocks: Column, *keys: str) -> DataFrame:
    """rows copied to each pair (i, j) of blocks of their group that holds their own block b."""
    own = rows.withColumn("_blocks", blocks).withColumn("b", F.pmod(F.xxhash64("key", F.lit(5)), F.col("_blocks")).cast("int"))
    pairs = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks").cast("int") - 1)))
    placed = pairs.select(*keys, F.least("b", "_o").alias("i"), F.greatest("b", "_o").alias("j"), *(c for c in own.columns if c not in (*keys, "_blocks")))
    return placed.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def candidate_edges(classes: DataFrame, percent: int = PERCENT, bucket_classes: int = BUCKET_CLASSES) -> DataFrame:
    """(src, dst) keys; they connect all classes whose pairs pass the prefix, length, positional and suffix filters."""
    posts = classes.select("key", "n", F.posexplode("prefix").alias("pos", "gram"))
    shared = lookup(posts.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1"), "shared")
    # few n-grams of a prefix are shared; only their rows get the ranges
    narrow = stored(posts.join(shared, "gram"), "postings")
    wide = narrow.join(classes.select("key", "coarse"), "key")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _groups(batches, 3):
            n, pos = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "pos"))
            side = table.column("b").to_numpy()
            across = table.column("i").to_numpy() != table.column("j").to_numpy()
            ranges = np.frombuffer(b"".join(table.column("coarse").to_pylist()), np.uint8).reshape(-1, RANGES).astype(np.int32)

            def passes(x: np.ndarray | int, y: np.ndarray) -> np.ndarray:
                nx, ny = n[x], n[y]
                need = _needed(nx, ny, percent)
                room = np.minimum(pos[x], pos[y]) + 1 + np.minimum(nx - pos[x], ny - pos[y]) - 1
                ok = (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & (room >= need) & ((side[x] != side[y]) | ~across[y])
                at = np.flatnonzero(ok)
                here = ranges[x[at]] if isinstance(x, np.ndarray) else ranges[x]
                apart = np.abs(here - ranges[y[at]]).sum(1)
                ok[at] = apart <= (nx[at] if isinstance(x, np.ndarray) else nx) + ny[at] - 2 * need[at]
                return ok

            size = np.diff(cuts)
            twos = cuts[:-1][size == 2]
            twos = twos[passes(twos, twos + 1)] if len(twos) else twos
            a, b = twos.tolist(), (twos + 1).tolist()
            for g in np.flatnonzero(size > 2):
                first = int(cuts[g])
                x, y = _forest(int(size[g]), lambda x, rest: passes(first + x, first + rest))  # noqa: B023
                a += [first + k for k in x]
                b += [first + k for k in y]
            if a:
                yield _edges_of(table, a, b)

    dealt = _dealt(wide, F.ceil(F.col("m") / bucket_classes), "gram")
    return dealt.mapInArrow(search, "src binary, dst binary").distinct()


def _resembling(table: pa.Table, percent: int) -> tuple[list[int], list[int]]:
    """Edges of a forest between the members of one group whose sizes in ranges are near enough for a link."""
    n = table.column("n").to_numpy().astype(np.int64)
    side = table.column("b").to_numpy()
    across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
    sizes = [np.frombuffer(r, np.uint16).astype(np.int32) for r in table.column("ranges").to_pylist()]
    level = np.array([len(r).bit_length() for r in sizes])
    halved = [r.reshape(2, -1).sum(0) for r in sizes]
    slot = np.zeros(len(n), np.int64)
    own, half = {}, {}
    for k in np.unique(level).tolist():
        of_level = np.flatnonzero(level == k)
        slot[of_level] = np.arange(len(of_level))
        own[k], half[k] = np.stack([sizes[i] for i in of_level]), np.stack([halved[i] for i in of_level])

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        need = _needed(n[x], n[rest], percent)
        ok = np.minimum(n[x], n[rest]) >= need
        if across:
            ok &= side[rest] != side[x]
        k = int(level[x])
        for other, mine, theirs in ((k, sizes[x], own), (k - 1, halved[x], own), (k + 1, sizes[x], half)):
            at = np.flatnonzero(ok & (level[rest] == other))
            if len(at):
                ok[at] = np.abs(theirs[other][slot[rest[at]]] - mine).sum(1) <= n[x] + n[rest[at]] - 2 * need[at]
        return ok & (np.abs(level[rest] - k) <= 1)  # sizes that can link are no further apart

    return _forest(len(n), near)


def finer_edges(clusters: DataFrame, classes: DataFrame, percent: int, cluster_classes: int) -> DataFrame:
    """(src, dst) keys; they connect all classes of a cluster whose sizes in ranges are near enough for a link."""
    sized = stored(clusters.join(classes.select("key", "n", "ranges"), "key"), "ranges")
    blocks = F.greatest(F.ceil(F.count("*") / cluster_classes), F.ceil(F.sum(F.length("ranges")) / (cluster_classes * 4096)))
    large = lookup(sized.groupBy("cluster").agg(blocks.alias("m")).where("m > 1"), "large")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _each_group(batches, lambda part: _resembling(part, percent))

    return _dealt(sized.join(large, "cluster", "left").withColumn("m", F.coalesce("m", F.lit(1))), F.col("m"), "cluster").mapInArrow(search, "src binary, dst binary")


def _each_group(batches: Iterator[pa.RecordBatch], edges: Callable[[pa.Table], tuple[list[int], list[int]]]) -> Iterator[pa.RecordBatch]:
    for table, cuts in _groups(batches, 3):
        for first, last in zip(cuts[:-1], cuts[1:]):
            if last - first > 1:
                part = table.slice(int(first), int(last - first))
                a, b = edges(part)
                if a:
                    yield _edges_of(part, a, b)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bit for the first BITMAP_BITS bits of each key; its size does not depend on the keys."""
    bits = BITMAP_BITS // 8
    number = F.conv(F.hex(F.substring("key", 1, bits)), 16, 10).cast("long") + 1
    parts = keys.select(number.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    out = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for r in parts.collect():
        at = (r["bucket"] - 1) * len(r["bits"])
        out[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def _sets(docs: DataFrame, keys: DataFrame, text_col: str, n: int) -> DataFrame:
    """(key, grams): the sets of the classes of keys, and of a few others."""
    held = docs.sparkSession.sparkContext.broadcast(_bitmap(keys))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            rows: list[tuple[bytes, bytes]] = []
            size = 0
            for _, grams in ngram_sets(batch.column(0), n):
                key = _name(grams)
                x = int.from_bytes(key[: BITMAP_BITS // 8], "big")
                if bits[x >> 3] >> (x & 7) & 1:
                    rows.append((key, grams.tobytes()))
                    size += len(grams)
                    if size > 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], ["key", "grams"])
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], ["key", "grams"])

    found = docs.select(text_col).mapInArrow(convert, "key binary, grams binary")
    return found.groupBy("key").agg(F.first("grams").alias("grams"))


def _verified(table: pa.Table, percent: int) -> tuple[list[int], list[int]]:
    """Links between the sets of one group, as edges of a forest; exact overlaps by the members of each n-gram."""
    sets = [np.frombuffer(g, _U64) for g in table.column("grams").to_pylist()]
    n = np.array([len(s) for s in sets], np.int64)
    m = len(sets)
    side = table.column("b").to_numpy()
    across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
    owner = np.repeat(np.arange(m), n)
    every = np.concatenate(sets)
    ranges = np.bincount(owner * RANGES + (every >> _U64(8)).astype(np.int64) % RANGES, minlength=m * RANGES).reshape(m, RANGES)
    _, code = np.unique(every, return_inverse=True)
    members = owner[np.argsort(code, kind="stable")]
    count = np.bincount(code)
    begin = np.cumsum(count) - count
    heads = np.cumsum(n) - n

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        need = _needed(n[x], n[rest], percent)
        ok = (np.minimum(n[x], n[rest]) >= need) & (np.abs(ranges[x] - ranges[rest]).sum(1) <= n[x] + n[rest] - 2 * need)
        if across:
            ok &= side[rest] != side[x]
        if not ok.any():
            return ok
        own = code[heads[x] : heads[x] + n[x]]
        sizes = count[own]
        flat = np.repeat(begin[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return ok & (np.bincount(members[flat], minlength=m)[rest] >= need)

    return _forest(m, near)


def links(docs: DataFrame, classes: DataFrame, text_col: str = "text", n: int = WORDS, percent: int = PERCENT, bucket_classes: int = BUCKET_CLASSES, cluster_classes: int = CLUSTER_CLASSES, cluster_ngrams: int = CLUSTER_NGRAMS) -> DataFrame:
    """(src, dst) keys of verified links; they connect exactly what all links connect."""
    def clusters_of(edges: DataFrame, name: str) -> DataFrame:
        return stored(connected_components(checkpoint(edges)).select(F.col("node").alias("key"), F.col("component").alias("cluster")), name)

    coarse = clusters_of(candidate_edges(classes, percent, bucket_classes), "coarse")
    clusters = clusters_of(finer_edges(coarse, classes, percent, cluster_classes).distinct(), "clusters")
    sized = stored(clusters.join(classes.select("key", "n"), "key"), "sized")
    blocks = F.greatest(F.ceil(F.count("*") / cluster_classes), F.ceil(F.sum("n") / cluster_ngrams))
    large = lookup(sized.groupBy("cluster").agg(blocks.alias("m")).where("m > 1"), "large")
    members = sized.join(large, "cluster", "left").join(_sets(docs, clusters, text_col, n), "key").select("cluster", "key", "grams", F.coalesce("m", F.lit(1)).alias("m"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _each_group(batches, lambda part: _verified(part, percent))

    return _dealt(members, F.col("m"), "cluster").mapInArrow(verify, "src binary, dst binary")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT, **blocks: int) -> DataFrame:
    """(id_col, n_shingles, component_id) for each row; component_id is the smallest id that links reach."""
    marked = stored(signed_sets(docs, document_counts(docs, text_col, n), id_col, text_col, n, percent), "sets")
    named = marked.where("key IS NOT NULL")
    classes = stored(named.groupBy("key").agg(F.min(id_col).alias("least"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("coarse").alias("coarse"), F.first("ranges").alias("ranges")), "classes")
    edges = checkpoint(links(docs, classes, text_col, n, percent, **blocks).distinct())
    parts = connected_components(edges).select(F.col("node").alias("key"), F.col("component").alias("part"))
    linked = stored(classes.select("key", "least").join(parts, "key"), "linked")
    # stored, so that the join has two plain shuffles and a part with a large share of the classes is split
    smallest = stored(linked.groupBy("part").agg(F.min("least").alias("component_id")), "smallest")
    known = linked.join(smallest, "part").select("key", "component_id")
    owners = stored(classes.select("key", "least").join(known, "key", "left").select("key", F.coalesce("component_id", "least").alias("component_id")), "owners")
    discard(classes)
    full = named.select(id_col, "key", "n").join(owners, "key").select(id_col, F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(marked.where("key IS NULL").select(id_col, F.col("n").alias("n_shingles"), F.col(id_col).alias("component_id")))
