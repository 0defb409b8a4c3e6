"""Every operator over rows with nulls, empty and long texts, repeats and clashing columns, and over empty tables."""

import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat, decontaminate, langid, mixing, multiset, quality, sharding, simhash, substrings, toxicity
from corpusloom.operators.components import connected_components

CLASHES = ["fp", "part", "label", "window", "start", "n", "spans", "epoch", "domain", "shard", "size", "score", "model", "bits", "host", "path", "f", "least", "key", "budget", "turn", "_range", "law"]
LONG = " ".join(f"w{i % 9973}x{i % 31}" for i in range(60_000))


def rows():
    base = [
        (1, None, "en", "src0", 0), (2, "", "en", "src0", 0), (3, " \n\t ", "fr", None, 3), (4, "one", None, "src1", 3), (5, "the same words again and again", "en", "src1", 30),
        (5, "the same words again and again", "en", "src1", 30), (6, "the same words again and again", "en", "src2", 30), (7, LONG, "en", "src3", len(LONG)),
        (None, "a text without an id", "en", "src3", 20), (None, None, None, None, None), (8, "Ünï ©ode text 𝒳 ß", "de", "src4", 18), (9, "x" * 300_000, "es", "src4", 300_000),
    ]
    return base


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(10)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


N = len(rows())


def op2(d, labels):
    return multiset.fingerprint_edits(d)


def op3(d, labels):
    return sharding.shard_documents(d)


def op4(d, labels):
    return simhash.simhash_components(d)


def op6(d, labels):
    return toxicity.score(d, toxicity.fit(d, labels))


def op7(d, labels):
    return substrings.remove_repeats(d)


def op8(d, labels):
    return langid.identify(d, langid.fit(d))


def op9(d, labels):
    return decontaminate.contamination(d, [(1, "the same words again and again and some more of them here"), (2, ""), (3, "short")])


def op10(d, labels):
    return quality.site_quality(d, labels, F.col("source"), F.concat_ws("/", "source", "lang"))


@pytest.mark.parametrize("op", [op2, op3, op4, op6, op7, op8, op9, op10])
def test_one_row_for_each_document(op, docs, labels):
    got = op(docs, labels).select("doc_id").collect()
    assert sorted((r[0] is None, r[0] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows())


@pytest.mark.parametrize("op", [op2, op3, op4, op6, op7, op8, op9, op10])
def test_empty_tables(op, empty, labels):
    assert op(empty, labels.where("false")).count() == 0


def test_mixing_edges(docs, empty):
    got = mixing.mix(docs, F.lit("all"), {}, total_share=1.0, max_epochs=1).collect()
    assert {r["doc_id"] for r in got if r["n_tokens"]} == {r[0] for r in rows() if (r[1] or "").split()}
    again = next(r for r in got if r["doc_id"] == 5)
    assert again["n_tokens"] == 12  # repeated rows are one document, drawn together
    assert mixing.mix(empty, F.lit("all"), {}).count() == 0
    drawn = mixing.draw(docs, F.lit("all"), {}, total_share=5.0, max_epochs=1)
    assert drawn.columns == docs.columns and drawn.where("doc_id = 5").count() == 2


def test_filters_keep_columns(docs, empty, labels):
    clean = toxicity.keep_clean(docs, 0.0)
    assert clean.columns == docs.columns and clean.count() == N
    kept = decontaminate.keep_uncontaminated(docs, [])
    assert kept.columns == docs.columns and kept.count() == N
    one = simhash.deduplicate(docs)
    assert one.columns == docs.columns
    ids = [r[0] for r in one.select("doc_id").collect()]
    # texts without words, one of them without an id, share fingerprint 0; 5 and 6 are copies
    assert sorted(i for i in ids if i) == [1, 4, 5, 7, 8, 9] and ids.count(None) == 1
    assert simhash.deduplicate(empty).count() == 0


def test_chat_edges(spark):
    rows_ = [(1, 0, "user", None), (1, 1, None, "x"), (2, 0, "assistant", ""), (None, 0, "user", "y"), (1, 1, None, "x"), (3, None, "a\\b\nc", "<|im_end|>\n<|" + "long " * 100_000)]
    df = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("clash"))
    turns = chat.format_turns(chat.canonical_turns(chat.turn_records(df), "conv_id", "record"))
    got = {r["conv_id"]: r for r in chat.conversation_digest(turns, "conv_id").collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, 2: 1, None: 1, 3: 1}
    nothing = chat.canonical_turns(chat.turn_records(df.where("false")), "conv_id", "record")
    assert chat.conversation_digest(chat.format_turns(nothing), "conv_id").count() == 0


def test_defined_values(docs, labels):
    got = {r["doc_id"]: r for r in op8(docs, labels).collect() if r["doc_id"]}
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (1, 2, 3))
    got = {r["doc_id"]: r for r in op4(docs, labels).collect() if r["doc_id"]}
    assert all(got[i]["fingerprint"] == "0" * 16 and got[i]["component_id"] == 1 for i in (1, 2, 3))
    got = {r["doc_id"]: r for r in op2(docs, labels).collect() if r["doc_id"]}
    assert got[1]["n_chars"] == 0 and got[5]["fingerprint"] == got[6]["fingerprint"]
    assert got[6]["near_next"] == 1.0 and got[8]["near_next"] < 0.3


def test_near_dedup_with_shared_ids(spark):
    a, b = "one two three four five six seven", "quite another text that has nothing in common with it"
    df = spark.createDataFrame([(1, a, "x"), (1, b, "x"), (2, a, "x"), (3, b, "x"), (1, a, "y"), (None, a, "x"), (None, "without an id " * 3, "x"), (None, "without an id " * 3, "z")], "doc_id long, text string, part string")
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.deduplicate(df).collect()), key=str)
    # both groups are named by id 1, each keeps one row of its own; the group without an id keeps one
    assert got == sorted([(1, a), (1, b), (None, "without an id " * 3)], key=str)


NAMED = ["a.b", "c0", "_row", "x y", "back`tick", "_row_0"]


def test_stages_pass_any_column_names(docs, labels):
    """Names with dots, blanks or those of a stage's own columns."""
    named = docs.toDF(*(NAMED[CLASHES.index(c)] if c in CLASHES[: len(NAMED)] else c for c in docs.columns))
    values = lambda df: sorted(map(repr, df.collect()))
    assert values(toxicity.keep_clean(named, 0.0)) == values(named)
    assert values(decontaminate.keep_uncontaminated(named, [])) == values(named)
    one = simhash.deduplicate(named)
    assert one.columns == named.columns and one.where("`a.b` = 'clash'").count() == 7
    drawn = mixing.draw(named, F.lit("all"), {}, total_share=5.0, max_epochs=1)
    assert drawn.columns == named.columns and drawn.where("doc_id = 5 AND `a.b` = 'clash'").count() == 2


def test_few_texts_to_learn_from(spark):
    """Eight labelled rows or more of both classes, of which few have words: scores are numbers all the same."""
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids[:16])], "doc_id long, toxic int")
    for texts in (["bad words here", "good words there", "more bad ones"], ["bad words"] * 5 + ["fine"] * 4, ["same"] * 12, [f"w{i} x" for i in range(16)]):
        rows = [(i, texts[k] if k < len(texts) else "  ") for k, i in enumerate(ids[:16])]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert len(got) == 16 and all(0 <= r["score"] <= 1 for r in got)
        if len(texts) < toxicity.FEWEST_TEXTS:
            assert {r["score"] for r in got} == {0.5}


def test_numerals_are_no_letters(spark):
    docs = spark.createDataFrame([(i, "plain english words", "en") for i in range(9)] + [(20, "½", None), (21, "①② 12 _ Ⅷ", None), (22, "ß", None), (23, "漢", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert [got[i] for i in (20, 21, 22, 23)] == ["und", "und", "en", "en"]


def test_a_benchmark_of_any_size(spark, docs):
    """Groups of items, one after the other, find what all items at once find."""
    bench = spark.createDataFrame([(1, "the same words again and again and some more of them here"), (2, ""), (3, "short"), (4, "one"), (5, "a text without an id"), (6, None)], "item_id long, text string")
    whole, table = (decontaminate.benchmark_items(bench, most_chars=n) for n in (1000, 10))
    assert isinstance(whole, list) and not isinstance(table, list)
    want = sorted(map(repr, decontaminate.contamination(docs, whole).collect()))
    assert sorted(map(repr, decontaminate.contamination(docs, table, most_chars=25).collect())) == want and any("contaminated=True" in r for r in want)
    kept = [sorted(map(repr, decontaminate.keep_uncontaminated(docs, items, most_chars=25).collect())) for items in (whole, table)]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < N


def _largest_task(spark, run):
    """Rows that the largest task of a job read by shuffles, over all jobs of run()."""
    spark.sparkContext.setJobGroup("largest", "largest")
    run()
    store = spark.sparkContext._jsc.sc().statusStore()
    largest = 0
    for job in spark.sparkContext.statusTracker().getJobIdsForGroup("largest"):
        for stage in spark.sparkContext.statusTracker().getJobInfo(job).stageIds:
            for task in _seq(store.taskList(stage, 0, 1_000)):
                m = task.taskMetrics()
                if m.isDefined():
                    largest = max(largest, m.get().shuffleReadMetrics().recordsRead())
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return largest


def _seq(items):
    return [items.apply(i) for i in range(items.length())]


def test_equal_rows_of_a_hot_key_are_spread(spark):
    """Three quarters of all rows are equal, without an id and a text: they are counted, and slots and neighbours are those of single rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
        sharded = sharding.shard_documents(hot, large_rows=100)
        assert _largest_task(spark, lambda: sharded.write.format("noop").mode("overwrite").save()) < 5_000
        assert sorted(map(repr, sharded.collect())) == sorted(map(repr, sharding.shard_documents(hot, large_rows=10**6).collect()))
        few = spark.range(0, 700, 1, 4).select(F.when(F.col("id") % 4 == 0, F.col("id") % 40).alias("doc_id"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("text "), (F.col("id") % 80).cast("string"))).alias("text"))
        plain = sorted(map(repr, multiset.fingerprint_edits(few).collect()))
        multiset.MANY_ROWS, multiset.COPIES = 100, 7
        assert sorted(map(repr, multiset.fingerprint_edits(few).collect())) == plain
    finally:
        multiset.MANY_ROWS, multiset.COPIES = 10_000, 1_000
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_crowded_buckets_are_dealt_into_blocks(spark):
    """Fingerprints a few bits from one word share keys; blocks of them give the components of one bucket."""
    word = 0x0123456789ABCDEF
    near = {word}
    for i in range(40):
        near |= {word ^ (1 << i) ^ (1 << j) for j in range(i + 1, 40, 3)}
    prints = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in sorted(near | {word ^ 0xFFFFF << 40})], "fp long").repartition(3)
    parts = lambda edges: sorted(map(tuple, connected_components(edges).collect()))
    whole, dealt = parts(simhash.near_edges(prints)), parts(simhash.near_edges(prints, bucket=64))
    assert whole == dealt and len({c for _, c in whole}) == 1 and len(whole) == len(near)
