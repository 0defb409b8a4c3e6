"""Weighted rendezvous sharding of stable record keys (native: DataFrame functions only).

Each record key is hashed together with every shard number; the shard with the
smallest ``-ln(u) / weight`` owns the record.  A shard's cost depends on nothing
but the key and the shard itself, so one more shard takes rows only into itself
and a removed shard gives up only its own rows; nothing else moves.

Slots number the rows of a shard from 0 without gaps.  A shard may hold a large
share of all rows, so rows are ranked inside sub-buckets of their shard (the
leading hex digits of the key hash) and the sub-bucket offsets are added; no task
ever sees a whole shard.  The driver reads the sizes of the sub-buckets (at most
4096 for each shard); where one is far larger than others, keys that many rows share
are the cause, and the rows of each are cut further by their texts' checksums, which
come next in the order of slots; equal rows of such a key are counted before they are shuffled.

Defined cases: a null key is the key "null"; a null text has no bytes (size 1,
checksum of the empty text); repeated keys share a shard and get neighbouring
slots; an empty table gives an empty result; columns of the input whose names
clash with the results are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the key hash that name a sub-bucket: 16**3 of them in each shard.
SUB_BUCKET_DIGITS = 3
#: A sub-bucket of more rows than this, and than eight times the mean, has a key that is cut further.
LARGE_ROWS = 500_000
#: Mean rows of a sub-bucket up to which two digits do.
FEW_ROWS = 20_000
#: Copies of one row that one task makes of their count.
COPIES = 100_000


def _bid(key: Column, shard: Column, weight: Column) -> Column:
    """(cost, shard) of a shard for a key: 52 hashed bits of both as a number inside (0, 1), by their logarithm."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string"))), 1, 13), 16, 10)
    unit = (bits.cast("double") + 0.5) / float(2**52)
    return F.struct((-F.ln(unit) / weight).alias("cost"), shard.alias("shard"))


def _best(key: Column, weights: Sequence[float]) -> Column:
    """The least bid; a loop over the shards, so that the compiled code does not grow with their number."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("every shard needs a positive weight")
    shards = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)))
    return F.array_min(F.transform(shards, lambda x: _bid(key, x["i"], x["w"])))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard that owns key; weights: a positive share for each shard."""
    return _best(F.coalesce(key.cast("string"), F.lit("null")), weights)["shard"]


def _summed(sizes: Sequence) -> Counter:
    out: Counter = Counter()
    for r in sizes:
        out[r["shard"], r["_sub"][:2]] += r["_n"]
    return out


def shard_documents(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * 8,
    grown_weight: float = 1.0,
    key_col: str = "doc_id",
    text_col: str = "text",
    large_rows: int = LARGE_ROWS,
) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for each row.

    weights: one for each shard; grown_weight: that of the shard added for
    ``grown_shard``.  size is the UTF-8 bytes of the text plus 1.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary"))
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("null"))
    shard = rendezvous(F.col(key_col), weights)
    # one shard more: it takes what it bids less for
    best, fresh = F.col("_best"), _bid(key, F.lit(len(weights)), F.lit(float(grown_weight)))
    grown = F.when(fresh["cost"] < best["cost"], fresh["shard"]).otherwise(best["shard"])
    order = F.md5(key)
    sub = F.substring(order, 1, SUB_BUCKET_DIGITS)
    hashed = docs.select(F.col(key_col), size.alias("size"), crc.alias("text_crc32"), order.alias("_hash"), _best(key, weights).alias("_best"))
    rows = hashed.select(key_col, "size", "text_crc32", "_hash", best["shard"].alias("shard"), grown.alias("grown_shard"), F.substring("_hash", 1, SUB_BUCKET_DIGITS).alias("_sub"))
    # at most len(weights) * 16**SUB_BUCKET_DIGITS small rows, whatever the input; this pass reads the keys alone
    sizes = docs.select(shard.alias("shard"), sub.alias("_sub")).groupBy("shard", "_sub").agg(F.count("*").alias("_n")).collect()
    total = sum(r["_n"] for r in sizes)
    if total <= len(weights) * 16**2 * FEW_ROWS:  # a digit less keeps the table of offsets small; the order of slots is the same
        sizes = [{"shard": k[0], "_sub": k[1], "_n": n} for k, n in _summed(sizes).items()]
        sub, rows = F.substring(order, 1, 2), rows.withColumn("_sub", F.substring("_hash", 1, 2))
    limit = max(large_rows, 8 * total // max(1, len(sizes)))
    large = [(r["shard"], r["_sub"]) for r in sizes if r["_n"] > limit]
    spark = docs.sparkSession
    equal = None
    if large:
        # keys with many rows: each is a stretch of its own, cut by checksums, between the stretches of the keys around it
        places = F.broadcast(spark.createDataFrame(large, "shard int, _sub string"))
        heavy = docs.select(shard.alias("shard"), sub.alias("_sub"), order.alias("_hash")).join(places, ["shard", "_sub"]).groupBy("shard", "_sub", "_hash").count()
        frequent = heavy.where(F.col("count") > limit).groupBy("shard", "_sub").agg(F.array_sort(F.collect_list("_hash")).alias("_frequent"))
        rows = rows.join(F.broadcast(frequent), ["shard", "_sub"], "left").withColumn("_frequent", F.coalesce("_frequent", F.array().cast("array<string>")))
        own = F.array_contains("_frequent", F.col("_hash"))
        stretch = 2 * F.size(F.filter("_frequent", lambda h: h < F.col("_hash"))) + own.cast("int")
        rows = rows.withColumns({"_own": own, "_part": stretch.cast("long") * 4096 + F.when(own, F.shiftright("text_crc32", 20)).otherwise(F.lit(0))}).drop("_frequent")
        counts = rows.groupBy("shard", "_sub", "_part").agg(F.count("*").alias("_n"))
        # their equal rows are interchangeable: they are counted, and the counts become slots again
        same = [F.col(key_col).alias("_key"), "size", "text_crc32", "_hash", "shard", "grown_shard", "_sub", "_part"]
        equal = rows.where("_own").groupBy(*same).agg(F.count("*").alias("_copies"))
        rows = rows.where("NOT _own")
    else:
        rows = rows.withColumn("_part", F.lit(0).cast("long"))
        counts = spark.createDataFrame([(r["shard"], r["_sub"], 0, r["_n"]) for r in sizes], "shard int, _sub string, _part long, _n long")
    before = Window.partitionBy("shard").orderBy("_sub", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_sub", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_sub", "_part").orderBy("_hash", key_col, "text_crc32", "size")
    ranked = rows.withColumn("_rank", F.row_number().over(within))
    columns = [key_col, "size", "text_crc32", "shard", "grown_shard", "_sub", "_part", "_rank"]
    if equal is not None:
        upto = Window.partitionBy("shard", "_sub", "_part").orderBy("_hash", "_key", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
        begun = equal.withColumn("_before", F.coalesce(F.sum("_copies").over(upto), F.lit(0)))
        # in two steps, so that the copies of one row are spread over tasks
        steps = begun.withColumn("_step", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / COPIES)))).repartition("shard", "_sub", "_part", "_key", "_step")
        copy = F.explode(F.sequence(F.col("_step") * COPIES + 1, F.least((F.col("_step") + 1) * COPIES, F.col("_copies"))))
        expanded = steps.withColumn("_rank", copy).withColumn("_rank", F.col("_rank") + F.col("_before"))
        ranked = ranked.select(columns).unionByName(expanded.withColumnRenamed("_key", key_col).select(columns))
    return (
        ranked.join(F.broadcast(offsets), ["shard", "_sub", "_part"])
        .select(
            key_col, "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("_before") + F.col("_rank") - 1).cast("long").alias("slot"), "grown_shard",
        )
    )
