from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import mixing, sharding


def test_sharding_laws(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    got = sharding.shard_documents(docs).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(slots) == 8
    moved = np.mean([r["grown_shard"] == 8 for r in got])
    assert abs(moved - 1 / 9) < 0.01 and max(map(len, slots.values())) < 1.1 * min(map(len, slots.values()))


def test_a_key_with_many_rows_is_cut_without_changing_slots(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 2, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 500).alias("text"))
    once, cut = (sorted(map(str, sharding.shard_documents(docs, (1.0,) * 4, large_rows=n).collect())) for n in (10**6, 50))
    assert once == cut and len(once) == 3000


def test_weights_set_the_shares(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = Counter(r[0] for r in sharding.shard_documents(docs, (1.0, 2.0, 5.0)).select("shard").collect())
    assert [round(n[i] / 20_000, 1) for i in range(3)] == [0.1, 0.2, 0.6] or abs(n[2] / 20_000 - 0.625) < 0.02


def test_queries_equal_sql(spark, oracle):
    oracle(spark, "op3_rendezvous_sharding")
    oracle(spark, "op5_hierarchical_mixing")


def fill(budget, children):
    """Water filling by rounds; children: {name: (weight, capacity)}."""
    out, open_ = {k: 0.0 for k in children}, set(children)
    while open_ and budget > 1e-9:
        total = sum(children[k][0] for k in open_)
        if not total:
            break
        full = {k for k in open_ if out[k] + budget * children[k][0] / total >= children[k][1] - 1e-12}
        if not full:
            for k in open_:
                out[k] += budget * children[k][0] / total
            break
        spent = 0.0
        for k in full:
            spent += children[k][1] - out[k]
            out[k] = children[k][1]
        budget -= spent
        open_ -= full
    return out


def test_budgets_against_rounds(spark):
    rng = np.random.default_rng(6)
    leaves = {(d, l, s): int(rng.integers(1, 1000)) for d in "ab" for l in "xyz" for s in "123" if rng.random() < 0.8}
    weights = {"domain": {"a": 3.0, "b": 1.0}, "lang": {"x": 5.0, "y": 0.0, "z": 1.0}, "source": {"1": 2.0}}
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    for share, epochs in ((0.1, 1), (0.5, 1), (0.9, 2), (3.0, 1)):
        got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.leaf_budgets(df, ["domain", "lang", "source"], weights, share, epochs).collect()}
        cap = lambda *p: epochs * sum(v for k, v in leaves.items() if k[: len(p)] == p)
        top = fill(share * sum(leaves.values()), {d: (weights["domain"][d], cap(d)) for d in "ab"})
        want = {}
        for d, b in top.items():
            for l, c in fill(b, {l: (weights["lang"][l], cap(d, l)) for l in "xyz" if cap(d, l)}).items():
                want |= {(d, l, s): x for s, x in fill(c, {s: (weights["source"].get(s, 1.0), cap(d, l, s)) for s in "123" if cap(d, l, s)}).items()}
        assert all(abs(got[k] - v) <= 1.001 for k, v in want.items()), (share, got, want)


def test_prefix_reaches_the_budget_and_repeats(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "en", "s") for i in range(300)], "doc_id long, text string, lang string, source string")
    total = sum(i % 7 + 1 for i in range(300))
    for share, epochs in ((0.3, 2), (1.4, 2), (5.0, 2)):
        rows = mixing.mix(docs, F.lit("d"), {}, share, epochs).collect()
        drawn = sum(r["n_tokens"] for r in rows)
        want = min(share, epochs) * total
        assert want - 1 <= drawn < want + 7
        assert max(Counter((r["doc_id"], r["epoch"]) for r in rows).values()) == 1
    assert mixing.draw(docs, F.lit("d"), {}, 1.4, 2).count() == mixing.mix(docs, F.lit("d"), {}, 1.4, 2).count()
