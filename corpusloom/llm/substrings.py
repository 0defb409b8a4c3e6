"""Substring deduplication with prefix-partitioned suffix trees.

A suffix of a document starts at any of its words; the trees are cut off at the
depth of ``window`` (50 words), so a deep node is one of that depth with leaves
in two documents, and neighbouring deep nodes together are the maximal repeats.

1. Shared stretches first.  Every window is assigned to the least of the hashes of
   its 8-word grams, which equal windows share.  Neighbouring windows mostly have
   the same one, so a document gives one row for a run of windows (about 22).  A
   gram that one document alone has lies on no path to a deep node, and its runs
   are dropped.  Runs with equal words are one leaf of many documents: they
   are settled at once, and only the smallest document's run goes on.
2. Variable-length prefixes.  The remaining suffixes are counted by prefix.  A prefix of 8
   words that more than ``most_leaves`` suffixes have is lengthened to 16 words,
   and if needed to 32 and to all of them (rare short prefixes share a group), so
   that each group of suffixes fits into memory many times over.
3. Subtrees.  A task takes the suffixes of its groups in the order of their paths and
   compares neighbours: the depth down to which two agree (their longest common
   prefix, at the tree's branching depths) gives the inner nodes as intervals of
   the sorted suffixes.  Deep ones are read off as they close, so a task holds a
   batch of leaves and one open node.  A window that alone has too many suffixes is a
   hot node: its least document is an aggregate that all tasks get (there are few
   such windows), and no task gathers its leaves.

Edges of the trees are named by 64-bit rolling hashes of their words; whole windows,
and whole runs, by two independent ones, 128 bits.  Of each repeat, all words are
removed but those in the document with the smallest id.  Windows are judged on
the input.

Defined cases: null text has no words; documents of under ``window`` words and rows
without an id stay whole; rows that repeat an id are expected to repeat its text,
and do not count as repeats of each other; a repeat inside one document stays;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.kernels import WordSums, slices, sliding_min, word_hashes, words
from corpusloom.scratch import discard, stored

WINDOW = 50
GRAM = 8
#: Words down to which the trees branch above the deep nodes; prefixes are lengthened from each to the next.
DEPTHS = (8, 16, 32)
#: Suffixes of a group; more, where there would be more than so many prefixes to lengthen.
MOST_LEAVES = 10_000
MOST_PREFIXES = 100_000


def _runs(ids: pa.Array, texts: pa.Array, window: int, gram: int) -> Iterator[list[pa.Array]]:
    for first, data, offsets in slices(texts):
        starts, ends, heads = words(data, offsets)
        if len(starts) < window:
            continue
        sums, second = (WordSums(word_hashes(data, starts, ends, x), x) for x in (False, True))
        least = sliding_min(sums.grams(gram), window - gram + 1)
        counts = np.diff(heads) - window + 1
        docs = np.flatnonzero(counts > 0)
        if not len(docs):
            continue
        doc = np.repeat(docs, counts[docs])
        at = np.arange(len(doc)) - np.repeat(np.cumsum(counts[docs]) - counts[docs], counts[docs]) + heads[doc]
        m = least[at]
        begin = np.concatenate([[0], np.flatnonzero((m[1:] != m[:-1]) | (doc[1:] != doc[:-1])) + 1])
        length = np.diff(np.append(begin, len(doc)))
        labels = (pa.array(x.ranges(at[begin], length + window - 1).view(np.int64)) for x in (sums, second))
        yield [
            pa.array(m[begin].view(np.int64)), *labels, ids.take(pa.array(first + doc[begin])),
            pa.array((at - heads[doc])[begin].astype(np.int32)), pa.array(length.astype(np.int32)),
        ]


def runs(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """(part, label, label_2, id_col, start, n): runs of n windows with the same least gram."""
    kind = docs.schema[id_col].dataType.simpleString()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in _runs(batch.column(0), batch.column(1), window, gram):
                yield pa.RecordBatch.from_arrays(columns, ["part", "label", "label_2", id_col, "start", "n"])

    return docs.select(id_col, text_col).mapInArrow(convert, f"part long, label long, label_2 long, `{id_col}` {kind}, start int, n int")


def suffixes(joined: DataFrame, id_col: str, window: int) -> DataFrame:
    """(short, path, w1, w2, id_col, start): paths of the suffixes in spans (start, n) of each text.

    short and the halves of path name the prefixes of DEPTHS words, w1 and w2 all window words.
    """
    kind = joined.schema[id_col].dataType.simpleString()
    names = ["short", "path", "w1", "w2", id_col, "start"]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, spans = (batch.column(i) for i in range(3))
            listed = spans.to_pylist()
            for first, data, offsets in slices(texts):
                starts, ends, heads = words(data, offsets)
                places, owners = [], []
                for i in range(len(offsets) - 1):
                    last = heads[i + 1] - heads[i] - window
                    for s in listed[first + i]:
                        stop = min(s["start"] + s["n"], last + 1)
                        if stop > s["start"]:
                            places.append(np.arange(s["start"], stop))
                            owners.append(np.full(stop - s["start"], i))
                if places:
                    place, owner = np.concatenate(places), np.concatenate(owners)
                    at = heads[owner] + place
                    sums, second = (WordSums(word_hashes(data, starts, ends, x), x) for x in (False, True))
                    a, b, c = (sums.ranges(at, min(d, window)) >> np.uint64(32) for d in DEPTHS)
                    columns = [a.astype(np.uint32).view(np.int32), (b << np.uint64(32) | c).view(np.int64), sums.ranges(at, window).view(np.int64), second.ranges(at, window).view(np.int64)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), ids.take(pa.array(first + owner)), pa.array(place.astype(np.int32))], names)

    return joined.mapInArrow(convert, f"short int, path long, w1 long, w2 long, `{id_col}` {kind}, start int")


def by_prefix(leaves: DataFrame, most_leaves: int = MOST_LEAVES) -> tuple[DataFrame, DataFrame | None]:
    """Groups suffixes by prefixes of variable length: columns p0 to p3 name a group.

    The second result has the suffixes of windows that alone have too many of them; None if there are none.
    The driver takes the names of the prefixes that are lengthened, at most MOST_PREFIXES at each depth.
    """
    total = leaves.count()
    most_leaves = max(most_leaves, total // MOST_PREFIXES)
    bits = min(32, (4 * total // most_leaves).bit_length())

    def bucket(hashed: Column) -> Column:
        return F.shiftright(hashed.bitwiseAND(F.lit(0xFFFFFFFF)), 32 - bits)

    depths = [bucket(c) for c in (F.col("short").cast("long"), F.shiftright("path", 32), F.col("path"), F.shiftright("w1", 32))]
    names = [f"p{i}" for i in range(len(depths))]
    grouped = leaves.withColumns({n: F.lit(-1).cast("long") for n in names}).withColumn("p0", depths[0])
    open_ = F.lit(True)
    for i in range(len(depths)):
        # the last are whole windows, not groups of them
        name = F.xxhash64(*names[: i + 1]) if i + 1 < len(depths) else F.xxhash64("w1", "w2")
        large = [r[0] for r in grouped.where(open_).groupBy(name.alias("name")).count().where(F.col("count") > most_leaves).select("name").collect()]
        if not large:
            return grouped, None
        open_ = open_ & name.isin(large)
        if i + 1 < len(depths):
            grouped = grouped.withColumn(names[i + 1], F.when(open_, depths[i + 1]).otherwise(F.col(names[i + 1])))
    return grouped.where(~open_), grouped.where(open_)


def common_depths(paths: Sequence[np.ndarray], before: Sequence[int] | None, window: int) -> np.ndarray:
    """Words down to which each suffix agrees with the one before it; before: the path of the one before the first."""
    n = len(paths[0])
    depth, agree = np.zeros(n, np.int32), np.ones(n, bool)
    agree[:1] = before is not None
    for i, below in enumerate((*(min(d, window - 1) for d in DEPTHS), window, window)):
        x = paths[i]
        agree[1:] &= x[1:] == x[:-1]
        if before is not None:
            agree[:1] &= x[:1] == before[i]
        if i != len(DEPTHS):  # the two halves of a window's name count together
            depth[agree] = below
    return depth


def subtree_repeats(grouped: DataFrame, id_col: str, window: int) -> DataFrame:
    """(id_col, start): the leaves of deep nodes in other documents than the node's smallest."""
    kind = grouped.schema[id_col].dataType.simpleString()
    path = ["short", "path", "w1", "w2"]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, least = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            short, middle, w1, w2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            paths = [short, middle >> 32, middle & 0xFFFFFFFF, w1, w2]
            deep = common_depths(paths, before, window) == window
            ids = batch.column(4)
            known = pa.concat_arrays([least if least is not None else ids.slice(0, 1), ids])
            # leaves of a node are in order of their documents: its first leaf has the smallest
            first = np.maximum.accumulate(np.where(deep, 0, np.arange(1, len(deep) + 1)))
            owners = known.take(pa.array(first))
            gone = pa.compute.and_(pa.array(deep), pa.compute.not_equal(ids, owners))
            yield pa.RecordBatch.from_arrays([ids.filter(gone), batch.column(5).filter(gone)], [id_col, "start"])
            before, least = [int(x[-1]) for x in paths], owners.slice(len(owners) - 1)

    ordered = grouped.repartition("p0", "p1", "p2", "p3").sortWithinPartitions(*path, id_col)
    return ordered.select(*path, id_col, "start").mapInArrow(convert, f"`{id_col}` {kind}, start int")


def hot_repeats(hot: DataFrame, id_col: str) -> DataFrame:
    """(id_col, start) as subtree_repeats() gives, for windows of which each has very many leaves.

    Such windows are few, at most MOST_PREFIXES; their least documents, an aggregate, go to every task.
    """
    found = hot.groupBy("w1", "w2").agg(F.min(id_col).alias("least"), F.max(id_col).alias("most")).where("least < most").select("w1", "w2", "least").toArrow().sort_by("w1")
    w1, w2, least = found["w1"].to_numpy(), found["w2"].to_numpy(), found["least"].combine_chunks()
    held = hot.sparkSession.sparkContext.broadcast((w1, w2, least))
    kind = hot.schema[id_col].dataType.simpleString()
    repeats = int(np.unique(w1, return_counts=True)[1].max(initial=1))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w1, w2, least = held.value
        for batch in batches:
            a, b, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            first = np.searchsorted(w1, a)
            for k in range(repeats):
                at = np.minimum(first + k, len(w1) - 1)
                same = np.flatnonzero((w1[at] == a) & (w2[at] == b)) if len(w1) else np.zeros(0, np.int64)
                own = ids.take(pa.array(same))
                gone = pa.compute.not_equal(own, least.take(pa.array(at[same])))
                yield pa.RecordBatch.from_arrays([own.filter(gone), batch.column(3).take(pa.array(same)).filter(gone)], [id_col, "start"])

    return hot.select("w1", "w2", id_col, "start").mapInArrow(convert, f"`{id_col}` {kind}, start int")


def deep_leaves(joined: DataFrame, id_col: str, window: int, most_leaves: int = MOST_LEAVES) -> DataFrame:
    """(id_col, start): the suffixes in spans of each text whose window also starts in a smaller document's spans."""
    leaves = stored(suffixes(joined, id_col, window), "suffixes")
    grouped, hot = by_prefix(leaves, most_leaves)
    found = subtree_repeats(grouped, id_col, window)
    if hot is None:
        return found
    return found.unionByName(hot_repeats(hot, id_col))


def _cut(joined: DataFrame, id_col: str) -> DataFrame:
    """(id_col, n_words, n_removed, kept_text) after removing spans (start, n) of words."""
    kind = joined.schema[id_col].dataType.simpleString()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept, size, done = [], [], [], 0, 0

            def flush(upto: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, upto - done), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                    [id_col, "n_words", "n_removed", "kept_text"],
                )

            for i in range(batch.num_rows):
                found = (batch.column(1)[i].as_py() or "").encode().split()
                spans = batch.column(2)[i].as_py()
                gone = 0
                n_words.append(len(found))
                if spans:
                    depth = np.zeros(len(found) + 1, np.int32)
                    begin = np.minimum([s["start"] for s in spans], len(found))
                    end = np.minimum([s["start"] + s["n"] for s in spans], len(found))
                    np.add.at(depth, begin, 1)
                    np.add.at(depth, end, -1)
                    stay = np.cumsum(depth[:-1]) == 0
                    gone = len(found) - int(stay.sum())
                    found = [w for w, s in zip(found, stay.tolist()) if s]
                n_removed.append(gone)
                kept.append(b" ".join(found).decode())
                size += len(kept[-1])
                if size > 8_000_000:
                    yield flush(i + 1)
                    n_words, n_removed, kept, size, done = [], [], [], 0, i + 1
            yield flush(batch.num_rows)

    return joined.mapInArrow(convert, f"`{id_col}` {kind}, n_words long, n_removed long, kept_text string")


def _gone(named: DataFrame, id_col: str, text_col: str, window: int, gram: int, most_leaves: int) -> DataFrame:
    """(id_col, spans): the words (start, n) to remove, for each document that has any; named has no null ids."""
    found = stored(runs(named, id_col, text_col, window, gram), "runs")
    labels = found.groupBy("part", "label", "label_2").agg(F.min(id_col).alias("least"), F.max(id_col).alias("most"))
    branches = labels.groupBy("part").agg(F.count("*").alias("k"), F.min("least").alias("lo"), F.max("least").alias("hi")).where("k > 1 AND lo < hi")
    nodes = labels.join(branches.select("part", F.lit(True).alias("open")), "part", "left").where("open OR least < most").select("part", "label", "label_2", "least", "open")
    marked = stored(
        found.join(nodes, ["part", "label", "label_2"]).where((F.col(id_col) > F.col("least")) | F.col("open"))
        .select(id_col, "start", "n", (F.col(id_col) > F.col("least")).alias("whole")),
        "marked",
    )
    discard(found)
    whole = marked.where("whole").select(id_col, "start", (F.col("n") + (window - 1)).alias("n"))
    opened = marked.where("NOT whole").groupBy(id_col).agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    single = deep_leaves(named.select(id_col, text_col).join(opened, id_col), id_col, window, most_leaves)
    return whole.unionByName(single.select(id_col, "start", F.lit(window).alias("n"))).groupBy(id_col).agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, most_leaves: int = MOST_LEAVES) -> DataFrame:
    """(id_col, start, n): the longest stretches of words of which each window also starts in a smaller document."""
    gone = _gone(docs.where(F.col(id_col).isNotNull()), id_col, text_col, window, gram, most_leaves)
    ordered = F.array_sort("spans")

    def joined(done: Column, s: Column) -> Column:
        # windows of one stretch follow each other without a gap: the next starts where, or a word after, one before it did
        top = F.element_at(done, -1)
        more = F.size(done) > 0
        end = s["start"] + s["n"]
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(top["start"].alias("start"), (F.greatest(top["start"] + top["n"], end) - top["start"]).alias("n"))))
        return F.when(more & (s["start"] <= top["start"] + top["n"] - (window - 1)), grown).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["n"].alias("n")))))

    merged = F.aggregate(ordered, F.array().cast("array<struct<start:int,n:int>>"), joined)
    return gone.select(id_col, F.explode(merged).alias("_s")).select(id_col, "_s.start", "_s.n")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, most_leaves: int = MOST_LEAVES) -> DataFrame:
    """(id_col, n_words, n_removed, kept_text) for each row; see the module's text."""
    texts = docs.select(id_col, text_col)
    named = texts.where(F.col(id_col).isNotNull())
    joined = named.join(_gone(named, id_col, text_col, window, gram, most_leaves), id_col, "left")
    rest = texts.where(F.col(id_col).isNull()).withColumn("spans", F.lit(None).cast(joined.schema["spans"].dataType))
    return _cut(joined.unionByName(rest), id_col)
