import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import codes


def brute(rows, entries=64, rounds=2, parts=16):
    """Plain loops over (id, vector, label)."""
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    first = sorted(kept, key=lambda r: (r[0], r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in kept:
                members.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, xs in members.items():
                books[p][k] = [sum(x[d] for x in xs) // len(xs) for d in range(size)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = [(i, y, *zip(*(near(cut(v, p), books[p]) for p in range(parts)))) for i, v, y in kept]
    total = {}
    for _, y, d, _ in out:
        total[y] = total.get(y, 0) + sum(d)
    return sorted((i, "".join(f"{k:02x}" for k in ks), sum(d), total[y], digest) for i, y, d, ks in out)


def test_nearest_is_exact_with_ties():
    rng = np.random.default_rng(3)
    for m in (1, 2, 4, 7, 32):
        for spread in (2, 5, 300):
            points, book = rng.integers(-spread, spread, (200, m)), rng.integers(-spread, spread, (20, m))
            book[11] = book[3]
            full = ((points[:, None] - book) ** 2).sum(2)
            index, distance = codes.nearest(points, book)
            assert (index == full.argmin(1)).all() and (distance == full.min(1)).all()


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i * 3, rng.normal(0, 0.2, 32).astype(np.float32).tolist(), int(rng.integers(3)) or None) for i in range(300)]
    rows += [(1000, rows[0][1], 1), (1001, None, 2), (1002, [math.nan] * 32, 1), (1003, [None, *rows[1][1][1:]], 1), (1004, [math.inf, *rows[1][1][1:]], 1), (1005, [-math.inf] * 32, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("clash")).repartition(5)
    assert sorted(map(tuple, codes.compress(df).collect())) == brute(rows)


def test_oracle(spark, oracle):
    oracle(spark, "op13_vector_codes")


def test_edges(spark):
    schema = "vec_id long, embedding array<double>, label string"
    clash = {c: F.lit("clash") for c in ("error", "label_error", "_id", "part", "a.b")}
    few = spark.createDataFrame([(2, [0.5] * 16, None), (1, [0.25] * 16, "x"), (2, [0.5] * 16, None), (None, [0.75] * 16, "x"), (3, [1e300] * 16, "x"), (4, [], "y"), (5, [0.5] * 3, None)], schema).withColumns(clash)
    got = codes.compress(few).collect()
    # 1, 2, 2, 4 (zeros), 5 (three halves and zeros) and the row without an id make codebooks of six entries
    assert sorted((r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in got) == [
        (0, "05" * 16, 0, 0), (1, "00" * 16, 0, 0), (2, "01" * 16, 0, 0), (2, "01" * 16, 0, 0), (4, "03" * 16, 0, 0), (5, "01" * 3 + "03" * 13, 0, 0)]
    assert codes.compress(few.where("false")).count() == 0
    assert codes.compress(few.where("vec_id = 3")).count() == 0
    assert codes.compress(spark.createDataFrame([(1, [], "y")], schema)).first()["code"] == "00" * 16
