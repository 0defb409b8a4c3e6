import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import periodic
from corpusloom.llm.queries import op12_periodic_runs


def brute(words, least=24):
    """Runs by definition: all stretches of each period, those kept whose period is the smallest."""
    n, out = len(words), []
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j + p - i
            stretch = words[i : i + length]
            if length >= max(least, 3 * p) and not any(all(stretch[k] == stretch[k + q] for k in range(length - q)) for q in range(1, p)):
                out.append((i, length, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = [w for w in __import__("re").findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    text = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    return (doc_id, len(runs), *best, best[2] and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest())


@pytest.mark.parametrize("letters", [1, 2, 3, 20])
def test_runs_of_random_words(letters):
    rng = random.Random(letters)
    for _ in range(120):
        words = [rng.randrange(letters) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(4)):  # nested and neighbouring repeats
            at = rng.randrange(len(words) + 1)
            part = words[at : at + rng.randrange(1, 12)]
            words = words[:at] + part * rng.randrange(1, 9) + words[at + rng.randrange(3) :]
        assert periodic.find_runs(np.array(words, np.int64)) == brute(words), words


def test_long_texts():
    rng = random.Random(7)
    block = [rng.randrange(1000) for _ in range(9000)]
    words = np.array([0] * 50_000 + block * 4 + [1, 2] * 30_000 + block)
    found = periodic.find_runs(words)
    assert (0, 50_000, 1) in found and (86_000, 60_000, 2) in found
    assert [r for r in found if r[2] == 9000] == [(50_000, 36_000, 9000)]


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: tuple(r) for r in op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    small = [r for r in rows if len((r[1] or "").split()) <= 800]
    assert len(got) == len(rows) and len(small) > 150
    assert {k: got[k] for k, _ in small} == {k: brute_row(k, t) for k, t in small}
    assert sum(v[1] > 0 for v in got.values()) > 5


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a " * 23), (5, "a " * 24), (5, "a " * 24), (None, "b c " * 20), (6, "x" * 300_000), (7, "é 漢 " * 12 + "𝒳"), (8, "a b " * 12 + "c " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("runs", "collapsed", "n_words", "_best", "start", "a.b")})
    found = periodic.runs_of(df)
    got = {(r["doc_id"], r["n_words"]): r for r in found.collect()}
    assert [got[k]["collapsed"] for k in ((1, 0), (2, 0), (3, 0), (4, 23), (5, 24), (None, 40), (7, 25))] == ["", "", "", " ".join("a" * 23), "a", "b c", "é 漢 𝒳"]
    assert [tuple(r) for r in got[8, 54]["runs"]] == [(0, 24, 2), (24, 30, 1)] and got[8, 54]["collapsed"] == "a b c"
    digest = {r["doc_id"]: r for r in periodic.run_digest(found).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert all((digest[i]["n_runs"], digest[i]["start"], digest[i]["runs_sha256"], digest[i]["collapsed_sha256"]) == (0, None, empty, empty) for i in (1, 2, 3))
    assert (digest[8]["start"], digest[8]["period"], digest[8]["exponent_milli"]) == (24, 1, 30_000)
    assert periodic.run_digest(periodic.runs_of(df.where("false"))).count() == 0
