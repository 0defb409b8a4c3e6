"""Seeded random graphs as edge lists, many at once: parameters travel as key columns."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def ring_lattice(spark: SparkSession, n: int, k: int) -> DataFrame:
    """(src, dst): each of n nodes joined to its k / 2 next ones on a ring."""
    return (
        spark.range(n).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("j"))
        .select(F.least("a", (F.col("a") + F.col("j")) % n).alias("src"), F.greatest("a", (F.col("a") + F.col("j")) % n).alias("dst")).distinct()
    )


def watts_strogatz(spark: SparkSession, n: int, k: int, settings: DataFrame) -> DataFrame:
    """(p, rep, src, dst) for settings (p, rep): lattice edges rewired with probability p to a random end.

    Rewiring that would make a loop or repeat an edge keeps the lattice edge's
    place in the count as the models do, by falling back to the original edge.
    """
    lattice = spark.range(n).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("j"))
    edges = lattice.withColumn("b", (F.col("a") + F.col("j")) % n).join(F.broadcast(settings))
    key = [F.col(c) for c in ("p", "rep", "a", "j")]
    target = F.floor(_unit(*key, F.lit("target")) * n).cast("long")
    rewired = (_unit(*key, F.lit("rewire")) < F.col("p")) & (target != F.col("a"))
    ends = edges.withColumn("e", F.when(rewired, target).otherwise(F.col("b")))
    drawn = ends.select("p", "rep", "j", F.least("a", "e").alias("src"), F.greatest("a", "e").alias("dst"), F.least("a", "b").alias("s0"), F.greatest("a", "b").alias("d0"), (F.col("e") != F.col("b")).alias("moved"))
    kept = drawn.where("NOT moved").select("p", "rep", F.col("s0").alias("src"), F.col("d0").alias("dst"))
    moved = drawn.where("moved")
    fresh = moved.join(kept, ["p", "rep", "src", "dst"], "left_anti").groupBy("p", "rep", "src", "dst").agg(F.min(F.struct("s0", "d0")).alias("o"))
    used = fresh.select("p", "rep", F.col("o.s0").alias("s0"), F.col("o.d0").alias("d0"))
    back = moved.join(used, ["p", "rep", "s0", "d0"], "left_anti").select("p", "rep", F.col("s0").alias("src"), F.col("d0").alias("dst"))
    return kept.unionByName(fresh.select("p", "rep", "src", "dst")).unionByName(back).distinct()


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 1) -> DataFrame:
    """(src, dst): each of the n * (n - 1) / 2 pairs with probability p; the work follows the pairs drawn.

    Each node goes over the later ones by geometric leaps, from a generator seeded by its number.
    """

    def leaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for src in batch.column(0).to_pylist():
                rng, at, ends = np.random.default_rng([seed, src]), src, []
                while p > 0 and at < n - 1:
                    places = at + np.cumsum(rng.geometric(p, max(16, min(100_000, int(p * (n - at) * 1.1)))))
                    ends.append(places[places < n])
                    at = int(places[-1])
                if ends:
                    dst = np.concatenate(ends)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(dst), src)), pa.array(dst)], ["src", "dst"])

    return spark.range(n).mapInArrow(leaps, "src long, dst long")


def barabasi_albert(spark: SparkSession, n: int, m: int, seed: int = 1, max_nodes: int = 100_000) -> DataFrame:
    """(src, dst): preferential attachment of m edges from each new node; sequential by nature, so made on the driver."""
    if n > max_nodes:
        raise ValueError(f"at most {max_nodes} nodes")
    rng = random.Random(seed)
    ends: list[int] = []
    targets = list(range(m))
    rows = []
    for v in range(m, n):
        rows += [(t, v) for t in sorted(set(targets))]
        ends += [x for t in set(targets) for x in (t, v)]
        picked: set[int] = set()
        while len(picked) < m:
            picked.add(rng.choice(ends))
        targets = list(picked)
    return spark.createDataFrame(rows, "src long, dst long")
