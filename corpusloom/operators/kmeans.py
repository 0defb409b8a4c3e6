"""Set-based K-means: documents as term sets, prototypes as weighted term sets, Jaccard assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.scratch import checkpoint

#: Rows of prototypes up to which their terms are broadcast.
MOST_BROADCAST = 1_000_000


def initial_prototypes(vectors: DataFrame, k: int, seed: int = 1, id_col: str = "doc_id", replace: bool = False) -> DataFrame:
    """(cluster, term, p): the terms of k documents drawn by a seeded hash, each with weight 1.

    With replace, each draw has its own hash order, so a document may come twice.
    """
    ids = vectors.select(id_col).distinct()
    if replace:
        draws = ids.select(id_col, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("cluster"))
        h = F.md5(F.concat_ws("-", F.col(id_col).cast("string"), F.lit(str(seed)), F.col("cluster").cast("string")))
        chosen = draws.groupBy("cluster").agg(F.min_by(id_col, F.struct(h, id_col)).alias(id_col))
    else:
        h = F.md5(F.concat_ws("-", F.col(id_col).cast("string"), F.lit(str(seed))))
        rank = F.row_number().over(Window.orderBy("_h", id_col)) - 1  # over k rows
        chosen = ids.withColumn("_h", h).orderBy("_h", id_col).limit(k).withColumn("cluster", rank).select("cluster", id_col)
    return vectors.join(F.broadcast(chosen), id_col).select("cluster", "term", F.lit(1.0).alias("p"))


def assign(vectors: DataFrame, prototypes: DataFrame, mode: str = "max_similarity", id_col: str = "doc_id") -> DataFrame:
    """(id_col, cluster, similarity): the prototype of largest Jaccard similarity, ties to the smaller cluster.

    mode "min_similarity" takes the smallest similarity instead; there prototypes
    without a common term matter, so every document is compared with the sizes
    of all prototypes.  The prototypes' terms are broadcast if their number,
    counted, allows it; documents are not shuffled but to gather their own terms.
    """
    if mode not in ("max_similarity", "min_similarity"):
        raise ValueError(f"unknown mode {mode}")
    sizes = prototypes.groupBy("cluster").agg(F.countDistinct("term").alias("np"))
    all_sizes = sizes.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("cluster", "np")))).alias("sizes"))
    owners = prototypes.groupBy("term").agg(F.sort_array(F.collect_set("cluster")).alias("clusters"))
    if prototypes.count() <= MOST_BROADCAST:
        owners = F.broadcast(owners)
    hits = vectors.join(owners, "term", "left").select(id_col, "term", F.explode_outer("clusters").alias("cluster"))
    per = hits.groupBy(id_col, "cluster").agg(F.count("*").alias("inter"))
    nd = vectors.groupBy(id_col).agg(F.count("*").alias("nd"))
    common = per.where("cluster IS NOT NULL").groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("cluster", "inter"))).alias("inter"))
    docs = nd.join(common, id_col, "left").join(F.broadcast(all_sizes))
    options = F.transform(
        F.map_entries("sizes"),
        lambda e: F.struct(
            (F.coalesce(F.try_element_at(F.col("inter"), e["key"]), F.lit(0)) / (F.col("nd") + e["value"] - F.coalesce(F.try_element_at(F.col("inter"), e["key"]), F.lit(0)))).alias("s"),
            e["key"].alias("c"),
        ),
    )
    key = F.array_min(F.transform(options, lambda o: F.struct((-o["s"] if mode == "max_similarity" else o["s"]).alias("v"), o["c"].alias("c"))))
    return docs.select(id_col, key.alias("_k")).select(id_col, F.col("_k.c").alias("cluster"), F.abs("_k.v").alias("similarity"))


def recompute(vectors: DataFrame, assigned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(cluster, term, p): the share of a cluster's documents that have the term; empty clusters vanish."""
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("n"))
    return (
        vectors.join(assigned.select(id_col, "cluster"), id_col).groupBy("cluster", "term").agg(F.count("*").alias("c"))
        .join(F.broadcast(sizes), "cluster").select("cluster", "term", (F.col("c") / F.col("n")).alias("p"))
    )


def partition_hash(assigned: DataFrame, id_col: str = "doc_id") -> tuple:
    """Equal for equal partitions into member sets, whatever the clusters are called."""
    members = assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(id_col)).alias("x"), F.sum(F.xxhash64(id_col, F.lit(1)).bitwiseAND(F.lit((1 << 40) - 1))).alias("s"))
    row = members.agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("n", "x", "s")).alias("x")).first()
    return tuple(row)


def kmeans(vectors: DataFrame, prototypes: DataFrame, iterations: int = 5, mode: str = "max_similarity", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame, int, bool]:
    """Repeats assignment and recomputation until the partition repeats: (assignment, prototypes, iterations, converged)."""
    vectors = checkpoint(vectors.select(id_col, "term").distinct())
    seen, assigned, n, converged = None, None, 0, False
    for n in range(1, iterations + 1):
        assigned = checkpoint(assign(vectors, prototypes, mode, id_col))
        prototypes = checkpoint(recompute(vectors, assigned, id_col))
        state = partition_hash(assigned, id_col)
        if state == seen:
            converged = True
            break
        seen = state
    return assigned, prototypes, n, converged


def top_attributes(prototypes: DataFrame, n: int = 5) -> DataFrame:
    """(cluster, rank, term, p): the n heaviest terms of each prototype, ties to the larger term."""
    w = Window.partitionBy("cluster").orderBy(F.desc("p"), F.desc("term"))
    return prototypes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def contingency(assigned: DataFrame, categories: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(cluster, category, n, share): counts of categories within clusters and their shares."""
    counts = assigned.join(categories, id_col).groupBy("cluster", "category").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("cluster")))
