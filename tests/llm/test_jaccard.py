import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import jaccard

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def brute_set(text, n=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(rows, percent=90):
    """(id, size of set, smallest id of the component) of each row, from all pairs."""
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def family(rng, size, length, changes):
    base = [f"w{rng.randrange(400)}" for _ in range(length)]
    out = []
    for _ in range(size):
        words = list(base)
        for _ in range(rng.randrange(changes + 1)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = [f"x{rng.randrange(10**6)}"][: rng.randrange(1, 2)]
        out.append(" ".join(words))
    return out


def corpus(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        texts += family(rng, rng.randrange(2, 14), rng.choice([9, 10, 11, 12, 13, 40, 60, 61, 150, 900]), rng.choice([0, 1, 2, 5]))
    texts += [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 14))) for _ in range(60)]
    texts += ["a b", "A  b", "a", "a b c", "A\tB\x0bC", None, "", "  "]
    # a chain: neighbours link, ends do not
    words = [f"c{i}" for i in range(120)]
    texts += [" ".join(words[i : i + 100]) for i in range(0, 20, 2)]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("blocks", [{}, {"bucket_classes": 3, "cluster_classes": 2}])
def test_against_all_pairs(spark, blocks):
    rows = corpus(3 if blocks else 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(jaccard.jaccard_components(df, **blocks)) == brute(rows)


def test_hot_group_in_blocks(spark):
    """Many near copies, some linked over others alone: blocks of 40 give the whole component, and the links stay few."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(70)]
    texts = [" ".join(base)]
    for i in range(299):
        words = list(base)
        words[rng.randrange(70)] = f"x{i}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = jaccard.document_counts(df, "text", 3)
    classes = jaccard.signed_sets(df, counts, "doc_id", "text", 3, 90).withColumn("least", F.col("doc_id"))
    dealt = {"bucket_classes": 40, "cluster_classes": 40}
    edges = jaccard.links(df, jaccard.stored(classes), **dealt)
    assert edges.count() < 300 * 300 / 40 * 3
    assert got(jaccard.jaccard_components(df, **dealt)) == brute(rows)


def test_counts_are_no_less_than_the_truth():
    texts = [t for _, t in corpus(5)]
    sets = dict(jaccard.ngram_sets(pa.array(texts), 3))
    assert {i: len(s) for i, s in sets.items()} == {i: len(brute_set(t)) for i, t in enumerate(texts) if (t or "").split()}
    one, two = jaccard._counters(np.concatenate(list(sets.values())))
    assert one.max() < 1 << jaccard.COUNTER_BITS <= two.min() and two.max() < 2 << jaccard.COUNTER_BITS


def test_oracle(spark, oracle):
    oracle(spark, "op11_ngram_jaccard_join")


def test_edges(spark):
    long = " ".join(f"w{i % 9973}x{i % 31}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "one two three"), (4, "ONE two THREE"), (5, long), (6, long + " end"), (None, "one two three"), (None, "alone here"), (None, "alone  here"), (7, "x" * 300_000), (7, "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n", "key", "prefix", "ranges", "coarse", "least", "part", "a.b")})
    assert got(jaccard.jaccard_components(df)) == brute(rows)
    assert jaccard.jaccard_components(df.where("false")).count() == 0
