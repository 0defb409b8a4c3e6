"""Tables behind the reports: quantiles, means, speed-ups, normalised columns, name parsing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.scratch import lookup, stored

STEMMER_NAMES = ("kstem", "porter_stem", "snowball", "stemmer")
QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
#: Bins of a histogram that is refined.
BINS = 1024


def grouped_mean(df: DataFrame, groups: Sequence[str], column: str) -> DataFrame:
    return df.groupBy(*groups).agg(F.avg(column).alias("mean"))


def quantiles(df: DataFrame, column: str, groups: Sequence[str] = (), at: Sequence[float] = QUANTILES) -> DataFrame:
    """(groups, q0, q1, ...): exact quantiles with linear interpolation; a group without values has null ones.

    No task gathers the values of a group.  For each rank that is needed, values are
    counted in BINS equal bins between the least and the largest one that are left, and only the bin
    that holds the rank is kept, until its least value is its largest.
    The least and the largest of what is left are never in one bin, so this ends.
    """
    keys = [f"_g{i}" for i in range(len(groups))]
    rows = stored(df.select(*(F.col(g).alias(k) for g, k in zip(groups, keys)), F.col(column).cast("double").alias("_x")), "values")
    known = rows.where("_x IS NOT NULL")
    sizes = known.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    place = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("place")) for i, p in enumerate(at)))
    targets = sizes.withColumn("_p", F.explode(place)).select(*keys, "_lo", "_hi", F.explode(F.array(F.floor("_p.place"), F.ceil("_p.place"))).alias("_rank")).distinct()
    wanted = stored(targets.withColumn("_left", F.col("_rank")), "ranks")  # _left: the rank among the values from _lo to _hi
    found = wanted.where("_lo = _hi")
    open_ = wanted.where("_lo < _hi")
    same = [known[k].eqNullSafe(F.col(f"_t{k}")) for k in keys]
    while not open_.isEmpty():
        sides = lookup(open_.select(*(F.col(k).alias(f"_t{k}") for k in keys), "_lo", "_hi", "_rank", "_left"), "ranks")
        inside = reduce(and_, same, known["_x"].between(F.col("_lo"), F.col("_hi")))
        # halves, so that the width of any two doubles is one
        share = F.try_divide(F.col("_x") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2)
        bin_ = F.when(F.col("_x") == F.col("_hi"), F.lit(BINS)).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1))).cast("int")
        counts = known.join(sides, inside).groupBy(*keys, "_rank", "_left", bin_.alias("_bin")).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        before = Window.partitionBy(*keys, "_rank").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        marked = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        held = marked.where("_before <= _left AND _left < _before + _n")
        step = stored(held.select(*keys, "_lo", "_hi", "_rank", (F.col("_left") - F.col("_before")).alias("_left")), "ranks")
        found, open_ = found.unionByName(step.where("_lo = _hi")), step.where("_lo < _hi")
    values = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_lo"))).alias("_v"))
    every = rows.select(*keys).distinct()
    joined = values.join(sizes.select(*(F.col(k).alias(f"_s{k}") for k in keys), "_n"), reduce(and_, [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in keys], F.lit(True)))
    out = []
    for i, p in enumerate(at):
        at_ = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = F.col("_v")[F.floor(at_)], F.col("_v")[F.ceil(at_)]
        out.append((low + (high - low) * (at_ - F.floor(at_))).alias(f"q{i}"))
    got = joined.select(*(F.col(k).alias(f"_v{k}") for k in keys), *out)
    if not groups:
        return got
    whole = every.join(got, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_v{k}")) for k in keys]), "left")
    return whole.select(*(F.col(k).alias(g) for g, k in zip(groups, keys)), *(f"q{i}" for i in range(len(at))))


def spread(df: DataFrame, groups: Sequence[str], column: str) -> DataFrame:
    """(groups, mean, std): mean and population standard deviation."""
    return df.groupBy(*groups).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))


def normalised(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """Adds relative: the column divided by its largest value, in its group."""
    top = df.groupBy(*groups).agg(F.max(column).alias("_top"))
    joined = df.join(top, list(groups)) if groups else df.join(F.broadcast(top))
    return joined.withColumn("relative", F.col(column) / F.col("_top")).drop("_top")


def speedup(timings: DataFrame, cores: str = "ncores", keys: Sequence[str] = ("n_words", "iteration", "repetition"), time: str = "time") -> DataFrame:
    """(keys, cores, speedup): time on one core over time, matched on the keys."""
    base = timings.where(F.col(cores) == 1).select(*keys, F.col(time).alias("_one"))
    return timings.join(base, list(keys)).select(*keys, cores, (F.col("_one") / F.col(time)).alias("speedup"))


def filter_names(df: DataFrame, column: str = "filters", counted: bool = False) -> DataFrame:
    """Adds stemmers (none, one's name or multiple, counted: multiple-N), others (names without stemmers) and n_others of "a-b-c" names."""
    parts = F.filter(F.split(F.coalesce(column, F.lit("")), "-"), lambda x: x != "")
    stems = F.array_sort(F.array_intersect(parts, F.array(*map(F.lit, STEMMER_NAMES))))
    others = F.array_except(parts, F.array(*map(F.lit, STEMMER_NAMES)))
    return df.withColumns({
        "stemmers": F.when(F.size(stems) == 0, "none").when(F.size(stems) == 1, stems[0]).otherwise(F.concat(F.lit("multiple-"), F.size(stems).cast("string")) if counted else F.lit("multiple")),
        "others": F.when(F.size(others) == 0, "none").otherwise(F.array_join(others, "-")),
        "n_others": F.size(others),
    })


def category_summary(docs: DataFrame, category: str, words: str) -> DataFrame:
    """(category, n_docs, n_words, mean_words)"""
    return docs.groupBy(category).agg(F.count("*").alias("n_docs"), F.sum(words).alias("n_words"), F.avg(words).alias("mean_words"))


def natural_order(df: DataFrame, column: str) -> DataFrame:
    """Rows in version order of names that end in a number."""
    return df.orderBy(F.regexp_replace(column, r"\d+$", ""), F.expr(f"try_cast(regexp_extract({column}, '([0-9]+)$', 1) AS BIGINT)"), column)


def merged(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union by keys in which rows of right replace those of left; of rows of one side that share a key the first in order of their values stays."""
    both = left.withColumn("_o", F.lit(0)).unionByName(right.withColumn("_o", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_o"), *(c for c in left.columns if c not in keys)))
    return both.withColumn("_r", rank).where("_r = 1").drop("_o", "_r")
