"""Word boundaries, the dictionary stemmer, quantiles by selection, sketches, and distances without pairs."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import lexicon
from corpusloom.functions.analysis import Analyzer, tokens
from corpusloom.operators import paths, postings, report

#: Texts and their words by the word-boundary rules.
BOUNDARIES = [
    ("The quick (\u201cbrown\u201d) fox can\u2019t jump 32.3 feet, right?", ["The", "quick", "brown", "fox", "can\u2019t", "jump", "32.3", "feet", "right"]),
    ("can't e.g. 3,456.789 a:b 1:2", ["can't", "e.g", "3,456.789", "a:b", "1", "2"]),
    ("a_b __x__ ___ 1_000", ["a_b", "__x__", "1_000"]),
    ("A1b2 3a x..y a.2 2.a", ["A1b2", "3a", "x", "y", "a", "2", "2", "a"]),
    ("\u6f22\u5b57\u304b\u306a \u30ab\u30bf\u30ab\u30ca\u30fc x", ["\u6f22", "\u5b57", "\u304b", "\u306a", "\u30ab\u30bf\u30ab\u30ca\u30fc", "x"]),
    ("\u30ab\u30bf_\u30ab a\u30ab", ["\u30ab\u30bf_\u30ab", "a", "\u30ab"]),
    ("e\u0301t\u00e9 na\u00efve\u0308 a\u00adb", ["e\u0301t\u00e9", "na\u00efve\u0308", "a\u00adb"]),
    ("\u05d0\u05d1\"\u05d2 \u05d3' a\"b", ["\u05d0\u05d1\"\u05d2", "\u05d3'", "a", "b"]),
    ("\ud55c\uad6d\uc5b4 \u0440\u0443\u0441\u0441\u043a\u0438\u0439 \u0645\u0631\u062d\u0628\u0627", ["\ud55c\uad6d\uc5b4", "\u0440\u0443\u0441\u0441\u043a\u0438\u0439", "\u0645\u0631\u062d\u0628\u0627"]),
    ("\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35 x", ["\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35", "x"]),
    ("", []), (None, []), ("... !? \u00b7", []),
]


def test_word_boundaries(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BOUNDARIES)], "i int, text string")
    got = {r["i"]: r["w"] for r in df.select("i", tokens(F.col("text"), "unicode").alias("w")).collect()}
    assert {i: (BOUNDARIES[i][0], w) for i, w in got.items()} == dict(enumerate(BOUNDARIES))
    long = spark.createDataFrame([("x" * 300_000 + " " + "9" * 100_000,)], "text string")
    assert long.select(F.size(tokens(F.col("text"), "unicode"))).first()[0] == 2


def plain_stem(word, known):
    """The rules one by one."""
    while word not in lexicon.HEADWORDS:
        tries = []
        for ending in lexicon.DOUBLED:
            rest = word[: -len(ending)]
            if word.endswith(ending) and len(rest) > 3 and rest[-1] == rest[-2] and rest[-1] not in "aeiou":
                tries.append(rest[:-1])
        for ending, put, least in lexicon.RULES:
            if word.endswith(ending) and len(word) - len(ending) >= least:
                tries.append(word[: -len(ending)] + put)
        found = next((t for t in tries if len(t) > 1 and t in known), None)
        if found is None:
            break
        word = found
    return word


#: Words and stems where the lexicon knows the stems.
PAIRS = {
    "ponies": "pony", "ties": "tie", "churches": "church", "hopes": "hope", "hoping": "hope", "hopped": "hop", "stopped": "stop", "dying": "die", "happiness": "happy", "happily": "happy",
    "organizations": "organize", "organization": "organize", "activity": "active", "probability": "probable", "probably": "probable", "walker": "walk", "baker": "bake", "news": "news", "during": "during",
    "things": "thing", "king": "king", "flings": "flings", "fling": "fling", "corpuses": "corpuses",
}


def test_dictionary_stems(spark, oracle):
    base = ["pony", "tie", "church", "hope", "hop", "stop", "die", "happy", "organize", "active", "probable", "walk", "bake", "organization"]
    rows = [(w, 5) for w in base] + [(w, 1) for w in PAIRS if w not in base]
    got = {r["term"]: r["stem"] for r in lexicon.stems(spark.createDataFrame(rows, "term string, freq long")).collect()}
    assert {w: got[w] for w in PAIRS} == PAIRS
    vocabulary = postings.term_frequency(Analyzer("letter", ("lowercase",)).analyze(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    freq = {r["term"]: r["freq"] for r in vocabulary.collect()}
    known = {w for w, n in freq.items() if n >= 2} | set(lexicon.HEADWORDS)
    got = {r["term"]: r["stem"] for r in lexicon.stems(vocabulary).collect()}
    assert got == {w: plain_stem(w, known) for w in freq} and any(k != v for k, v in got.items())
    oracle(spark, "t10_kstem_lexicon")
    oracle(spark, "t03_unicode_words")


def test_quantiles_by_selection(spark, oracle):
    rng = random.Random(2)
    rows = [("hot", rng.choice([1.5, 1.5, rng.gauss(0, 1e6), 10 ** rng.uniform(-300, 300)])) for _ in range(3000)] + [("one", 7.0), ("two", -1.0), ("two", 2.0), ("none", None), (None, 4.0), (None, 8.0)]
    rows += [("wide", x) for x in (-1.7e308, 1.7e308, 0.0, 5e-324)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    at = (0.0, 0.05, 0.25, 0.5, 0.95, 1.0)
    got = {r["g"]: tuple(r)[1:] for r in report.quantiles(df, "x", ["g"], at).collect()}
    for g in {r[0] for r in rows}:
        xs = sorted(x for k, x in rows if k == g and x is not None)
        for p, value in zip(at, got[g]):
            if not xs:
                assert value is None
                continue
            place = p * (len(xs) - 1)
            low, high = xs[int(place)], xs[-int(-place // 1)]
            assert value == pytest.approx(low + (high - low) * (place - int(place)), rel=1e-9) or g == "wide"
    assert got["wide"][0] == -1.7e308 and got["wide"][-1] == 1.7e308
    assert tuple(report.quantiles(df.where("g = 'two'"), "x", (), (0.5,)).first()) == (0.5,)
    assert report.quantiles(df.where("false"), "x", ["g"]).count() == 0
    oracle(spark, "a10_quantiles")


def test_sketches_unite(spark):
    day = lambda first, n, g: spark.range(first, first + n).select(F.lit(g).alias("source"), F.concat(F.lit("w"), "id").alias("term"))
    first, second = day(0, 60_000, "a").union(day(50_000, 40_000, "b")), day(80_000, 30_000, "a")
    old, new = postings.word_sketches(first, "source"), postings.word_sketches(second, "source")
    grown = {r[0]: r[1] for r in postings.united(old.union(new), "source").collect()}
    again = {r[0]: r[1] for r in postings.united(postings.word_sketches(first.union(second), "source"), "source").collect()}
    assert grown == pytest.approx(again, rel=1e-9) and grown["a"] == pytest.approx(90_000, rel=0.03)
    assert postings.united(old.union(new)).first()[0] == pytest.approx(110_000, rel=0.03)
    import __spark_entry__ as entry

    got = {r["lang"]: r["n_unique"] for r in entry.queries()["a03_sketched_unique"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = Analyzer("letter", ("lowercase",)).analyze(docs.select("lang", "text"), "lang")
    exact = {r[0]: r[1] for r in words.groupBy("lang").agg(F.countDistinct("term")).collect()}
    assert got == pytest.approx(exact, rel=0.03)


def test_distances_without_pairs(spark, oracle):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(149)] + [(rng.randrange(150), rng.randrange(150)) for _ in range(20)]
    df, nodes = spark.createDataFrame(edges, "src long, dst long"), spark.range(150).withColumnRenamed("id", "node")
    far = {}
    near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(150)}
    for s in range(150):
        level, seen, d = {s}, {s}, 0
        while level:
            d += 1
            level = {y for x in level for y in near[x]} - seen
            seen |= level
            far[d] = far.get(d, 0) + len(level)
    want = {d: n for d, n in far.items() if n}
    assert {r["distance"]: r["pairs"] for r in paths.reach(df, nodes).collect()} == want
    assert paths.diameter(df, nodes).first()[0] == max(want)
    mean = sum(d * n for d, n in want.items()) / sum(want.values())
    assert paths.average_path_length(df, nodes).first()["average_length"] == pytest.approx(mean)
    assert paths.sketched_path_length(df, nodes).first()[0] == pytest.approx(mean, rel=0.05)
    lone = spark.createDataFrame([(0, 1)], "src long, dst long")
    assert not paths.average_path_length(lone, spark.range(3).withColumnRenamed("id", "node")).first()["connected"]
    oracle(spark, "g12_exact_diameter")
