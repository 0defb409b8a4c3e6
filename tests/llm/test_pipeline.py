import hashlib
import itertools
import math
import zlib
from collections import defaultdict

import numpy as np
import xxhash
from test_shards_and_mixing import fill

import corpus_pipeline
from corpusloom.llm import decontaminate, simhash, toxicity
from corpusloom.llm.queries import DOMAINS, OTHER_DOMAIN, WEIGHTS

DIR = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    sizes = {}
    for name in ("toxicity", "near_dedup", "decontamination"):
        out = stages[name](spark, docs, DIR)
        assert out.columns == docs.columns
        sizes[name] = {r[0] for r in out.select("doc_id").collect()}
    everything = {r[0] for r in docs.select("doc_id").collect()}
    parts = simhash.simhash_components(docs).collect()
    assert sizes["near_dedup"] == {r["component_id"] for r in parts}
    leaks = decontaminate.contamination(docs, decontaminate.benchmark_items(spark.read.parquet(f"{DIR}/benchmark.parquet"))).where("contaminated")
    assert sizes["decontamination"] == everything - {r[0] for r in leaks.select("doc_id").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    clean = [k for k, v in labels.items() if not v]
    assert sum(k in sizes["toxicity"] for k in clean) > 0.95 * len(clean)


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {r["law"] for r in rows} == {"key"}
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def _near_groups(rows):
    """Documents whose fingerprints are within 4 bits, directly or by others: smallest id of each group."""
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    prints = {}
    for k, text, *_ in rows:
        words = (text or "").encode().translate(lower).split()
        grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
    name = {k: k for k in prints}

    def root(k):
        while name[k] != k:
            k = name[k]
        return k

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = sorted((root(a), root(b)))
            name[y] = x
    return {root(k) for k in prints}


def _contains_an_item(text, items):
    """Sellers' algorithm, one column for each character of the text, for all items at once."""
    text = decontaminate.normal(text)
    longest = max(map(len, items))
    chars = np.array([[ord(c) for c in i.ljust(longest, "\0")] for i in items])
    lengths, steps = np.array([len(i) for i in items]), np.arange(longest + 1)
    column = np.tile(steps, (len(items), 1))
    least = lengths.copy()
    for c in text:
        free = np.minimum(column[:, :-1] + (chars != ord(c)), column[:, 1:] + 1)
        column = np.minimum.accumulate(np.concatenate([np.zeros((len(items), 1), int), free], 1) - steps, axis=1) + steps
        least = np.minimum(least, column[np.arange(len(items)), lengths])
    return bool((least <= (lengths * 0.1).astype(int)).any())


def _mixture(rows):
    """Drawn rows, by filling the tree with rounds and taking prefixes of the seeded order."""
    domain = lambda s: next((d for d, r in DOMAINS.items() if s in {f"src{i}" for i in r}), OTHER_DOMAIN)
    leaves = defaultdict(list)
    for r in rows:
        leaves[domain(r[3]), r[2] or "(none)", r[3] or "(none)"].append((r[0], len((r[1] or "").split()), r))
    tokens = {k: sum(n for _, n, _ in v) for k, v in leaves.items()}
    budgets = {(): 0.6 * sum(tokens.values())}
    for depth, level in enumerate(("domain", "lang", "source")):
        for above in [k for k in budgets if len(k) == depth]:
            under = {k[depth] for k in tokens if k[:depth] == above}
            room = {c: 2.0 * sum(n for k, n in tokens.items() if k[: depth + 1] == (*above, c)) for c in under}
            budgets |= {(*above, c): b for c, b in fill(budgets[above], {c: (WEIGHTS[level].get(c, 1.0), room[c]) for c in under}).items()}
    out = []
    for leaf, docs in leaves.items():
        budget = math.floor(budgets[leaf] + 1e-6)
        whole = min(budget // tokens[leaf], 2) if tokens[leaf] else 0
        out += [r for _, _, r in docs] * whole
        rest = budget - whole * tokens[leaf]
        for _, n, r in sorted(docs, key=lambda d: hashlib.md5(f"7:{whole}:{d[0]}".encode()).hexdigest()):
            if rest > 0:
                out.append(r)
            rest -= n
    return out


def _sharded(rows):
    digest = lambda x: hashlib.md5(str(x).encode()).hexdigest()
    cost = lambda k, i: -math.log((int(digest(f"{k}:{i}")[:13], 16) + 0.5) / 2**52)
    out, slots = [], defaultdict(int)
    for r in sorted(rows, key=lambda r: digest(r[0])):
        data = (r[1] or "").encode()
        shard, grown = (min(range(n), key=lambda i: cost(r[0], i)) for n in (8, 9))
        out.append((r[0], len(data) + 1, zlib.crc32(data), "key", shard, slots[shard], grown))
        slots[shard] += 1
    return out


def test_run_against_brute_force(spark):
    tables = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    model = toxicity.fit(tables["documents"], tables["labels"])
    rows = [tuple(r) for r in tables["documents"].select("doc_id", "text", "lang", "source").collect()]
    score = lambda t: model if isinstance(model, float) else model.score([t])[0]
    rows = [r for r in rows if score(r[1]) < 0.7]
    groups = _near_groups(rows)
    rows = [r for r in rows if r[0] in groups]
    items = [decontaminate.normal(r["text"]) for r in tables["benchmark"].collect()]
    rows = [r for r in rows if not _contains_an_item(r[1], items)]
    want = _sharded(_mixture(rows))
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50


def _tables(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(5)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "a passage of a benchmark that nobody may learn by heart"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp string, part string, shard string, epoch string, score string, _row string, _own string, domain string"


def test_edges_of_all_stages(spark, tmp_path):
    clash = ("x",) * 8
    rows = [
        (1, None, None, None, None, *clash), (2, "", "en", "src0", 0, *clash), (None, "a text without an id", "en", "src1", 20, *clash), (None, None, None, None, None, *clash),
        (3, "repeated row of some words", "en", "src1", 5, *clash), (3, "repeated row of some words", "en", "src1", 5, *clash), (4, "ordinary words in a text of their own", "fr", "src7", 5, *clash),
        (5, "It has A passage of a benchmark, that nobody may learn by heart!", "en", "src2", 5, *clash), (6, "very long " * 50_000, "de", "src9", 5, *clash),
    ]
    sf_dir = _tables(spark, tmp_path, spark.createDataFrame(rows, COLUMNS))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        out.collect()
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir).select("doc_id", "text").collect()
    assert sorted((r[0] or 0, (r[1] or "")[:9]) for r in kept) == [(0, "a text wi"), (1, ""), (3, "repeated "), (4, "ordinary "), (5, "It has A "), (6, "very long")]
    left = corpus_pipeline.drop_contaminated(spark, docs, sf_dir)
    assert left.count() == len(rows) - 1 and left.where("doc_id = 5").isEmpty()
    assert {r["law"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == {"key"}


def test_empty_tables(spark, tmp_path):
    sf_dir = _tables(spark, tmp_path, spark.createDataFrame([], COLUMNS))
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
