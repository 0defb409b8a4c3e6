import hashlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import multiset, simhash


def fp(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return multiset.with_fingerprint(df, F.col("t"), "fp")


def test_paragraph_order_does_not_matter(spark):
    paragraphs = [f"line {i} of the text" for i in range(40)]
    a = fp(spark, "\n".join(paragraphs)).select(multiset.to_hex(F.col("fp"))).first()[0]
    b = fp(spark, "\n".join(reversed(paragraphs))).select(multiset.to_hex(F.col("fp"))).first()[0]
    c = fp(spark, "\n".join(paragraphs[:-1])).select(multiset.to_hex(F.col("fp"))).first()[0]
    assert a == b != c


def test_insertion_and_deletion(spark):
    a, b = "first one\nsecond one", "third here\nfourth there and more"
    both = fp(spark, f"{a}\n{b}").select(F.lit(1).alias("k"), F.col("fp").alias("ab"))
    parts = fp(spark, a).select(F.lit(1).alias("k"), F.col("fp").alias("a")).join(fp(spark, b).select(F.lit(1).alias("k"), F.col("fp").alias("b")), "k").join(both, "k")
    row = parts.select((multiset.add(F.col("a"), F.col("b")) == F.col("ab")).alias("plus"), (multiset.subtract(F.col("ab"), F.col("b")) == F.col("a")).alias("minus")).first()
    assert row["plus"] and row["minus"]


def test_edits_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in multiset.fingerprint_edits(docs).collect()}
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    for i, (k, t) in enumerate(rows):
        n, nxt = len(t), rows[(i + 1) % len(rows)][1]
        edited = t[: n - n // 3] + nxt[: n // 3]
        assert got[k]["n_chars"] == n and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    texts = {}
    for k, t in rows:
        assert texts.setdefault(t, got[k]["fingerprint"]) == got[k]["fingerprint"]
    assert len(set(texts.values())) == len(texts)
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.97
    assert all(0 <= r[c] <= 1 for r in got.values() for c in ("near_edited", "near_next"))


def reference_fingerprint(text):
    words = text.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, distance=4):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    arr = np.array(prints, np.uint64)
    for i in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= distance) + i + 1:
            parent[find(int(j))] = find(i)
    least = {}
    for i, k in enumerate(ids):
        least[find(i)] = min(k, least.get(find(i), k))
    return {k: least[find(i)] for i, k in enumerate(ids)}


def test_simhash_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in simhash.simhash_components(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    prints = [reference_fingerprint(r["text"]) for r in rows]
    assert all(got[r["doc_id"]]["fingerprint"] == f"{p:016x}" for r, p in zip(rows, prints))
    want = brute_components(prints, [r["doc_id"] for r in rows])
    assert {k: r["component_id"] for k, r in got.items()} == want


def test_near_fingerprints_always_meet():
    rng = np.random.default_rng(3)
    golay = simhash.Golay()
    a = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)

    def keys(v):
        out = [set() for _ in v]
        for r, k in simhash.segment_keys(v, golay):
            for x, y in zip(r.tolist(), k.tolist()):
                assert y not in out[x]
                out[x].add(y)
        return out

    ka, kb = keys(a), keys(b)
    assert all(x & y for x, y in zip(ka, kb)) and max(map(len, ka)) <= 139


def test_golay_decodes_to_the_nearest_codeword():
    golay = simhash.Golay()
    words = np.arange(0, 1 << 23, 4099, dtype=np.uint32)
    code = words ^ golay.leader[simhash._syndromes(words)]
    assert (simhash._syndromes(code) == 0).all() and np.bitwise_count(code ^ words).max() <= 3


def test_dense_and_chained_groups(spark):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**62))
    dense = {centre ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)}  # all within 4 of each other
    chain, x = [], int(rng.integers(0, 2**62))
    for i in range(15):
        chain.append(x)
        x ^= 0b1111 << (4 * i)
    prints = np.array(sorted(dense) + chain + rng.integers(0, 2**63, 200).tolist(), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in prints.view(np.int64)], "fp long")
    edges = simhash.near_edges(df).collect()
    assert len(edges) < 200 * len(dense)
    ids = list(range(len(prints)))
    place = {int(v): i for i, v in enumerate(prints.view(np.int64))}
    linked = brute_components(prints.tolist(), ids)
    parent = list(ids)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        parent[max(find(place[e[0]]), find(place[e[1]]))] = min(find(place[e[0]]), find(place[e[1]]))
    assert {i: find(i) for i in ids} == linked


def test_lanes_of_huge_texts_do_not_wrap(spark):
    # more pieces than a packed run of lanes holds, and no word in common
    a = spark.range(2).select("id", F.when(F.col("id") == 0, F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1_100_000)), lambda i: F.concat(F.lit("a"), i.cast("string"))), "\n"))
                              .otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1_100_000)), lambda i: F.concat(F.lit("b"), i.cast("string"))), "\n")).alias("t"))
    fps = multiset.with_fingerprint(a, F.col("t"), "fp").select("id", "fp")
    one, other = fps.where("id = 0").select(F.col("fp").alias("x")), fps.where("id = 1").select(F.col("fp").alias("y"))
    row = multiset.with_likeness(one.join(other, F.lit(True)), "near", "x", "y").first()
    assert row["x"]["n"] == row["y"]["n"] == 1_100_000 and all(540_000 < c < 560_000 for c in row["x"]["lanes"])
    assert row["near"] < 0.5


def test_identity_lanes_are_independent(spark):
    import hashlib

    got = fp(spark, "one\ntwo words\none").first()["fp"]
    want = [0] * 8
    for p in ("one", "two words", "one"):
        d = hashlib.sha512(p.encode()).hexdigest()
        want = [(w + int(d[16 * k : 16 * k + 15], 16)) % 2**60 for k, w in enumerate(want)]
    assert got["identity"] == want


def test_next_with_shared_and_missing_ids(spark):
    rows = [(i if i % 3 else (500 if i % 2 else None), f"text {i}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_tie", F.xxhash64("text"))
    got = multiset.with_next(df, "doc_id", "_tie", ["doc_id", "text"]).collect()
    order = sorted(((r["doc_id"] is None, -(r["doc_id"] or 0), r["_tie"], r["text"]) for r in got))
    after = {r["text"]: r["next_text"] for r in got}
    assert len(after) == len(rows) and [after[o[3]] for o in order] == [o[3] for o in order[1:] + order[:1]]
