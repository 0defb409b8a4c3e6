"""Frequency-band vocabularies over a grid of settings, and documents restricted to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.scratch import lookup, stored


def grid(spark: SparkSession, minfreq: Sequence[float], maxfreq: Sequence[float], numwords: Sequence[int]) -> DataFrame:
    """(combo, minfreq, maxfreq, numwords) for every setting with minfreq < maxfreq."""
    rows = [(a, b, n) for a in minfreq for b in maxfreq for n in numwords if a < b]
    return spark.createDataFrame([(i, float(a), float(b), int(n)) for i, (a, b, n) in enumerate(rows)], "combo int, minfreq double, maxfreq double, numwords int")


def band(df: DataFrame, combos: DataFrame) -> DataFrame:
    """(combo, term, df): for each setting the most frequent terms within its band of document frequencies.

    Bounds are truncated shares of the largest frequency; ties go to the smaller
    term; numwords 0 keeps all.  The grid is a handful of rows and is broadcast.
    Settings with a number of words keep that many of each task's terms before any
    shuffle, and those without rank nothing, so no setting's whole band meets in one task.
    """
    terms = stored(df.select("term", "df"), "df")
    top = terms.agg(F.max("df").alias("fmax"))
    bounds = combos.join(F.broadcast(top)).select(
        "combo", "numwords", F.floor(F.col("minfreq") * F.col("fmax")).alias("lo"), F.floor(F.col("maxfreq") * F.col("fmax")).alias("hi")
    )
    inside = terms.join(F.broadcast(bounds), F.col("df").between(F.col("lo"), F.col("hi"))).select("combo", "numwords", "term", "df")
    most = combos.agg(F.max("numwords")).first()[0] or 0
    rank = F.row_number().over(Window.partitionBy("combo").orderBy(F.desc("df"), "term"))
    limited = inside.where("numwords > 0").withColumn("_r", rank).where(F.col("_r") <= most).where("_r <= numwords")
    return inside.where("numwords = 0").select("combo", "term", "df").unionByName(limited.select("combo", "term", "df"))


def band_stats(bands: DataFrame, combos: DataFrame) -> DataFrame:
    """Settings with the true least frequency, that of the alphabetically last word, and the number of words."""
    stats = bands.groupBy("combo").agg(
        F.min("df").alias("realminfreq"), F.max_by("df", "term").alias("lastwordfreq"), F.count("*").alias("realnumwords")
    )
    return combos.join(stats, "combo", "left").select("combo", "minfreq", "maxfreq", "numwords", "realminfreq", "lastwordfreq", F.coalesce("realnumwords", F.lit(0)).alias("realnumwords"))


def restricted(posts: DataFrame, bands: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(combo, id_col, term): documents' terms within each vocabulary; documents without any drop out."""
    # repeated rows go after the vocabulary has taken most of them away
    return posts.select(id_col, "term").join(bands.select("combo", "term"), "term").select("combo", id_col, "term").distinct()


def restricted_sizes(posts: DataFrame, bands: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(combo, id_col, n_terms): the sizes of restricted() documents; posts has a row for each id and term.

    A term has one row with all its settings, and a document one row for each such set
    that its terms have, so that postings are not copied for every setting.
    """
    owners = bands.groupBy("term").agg(F.sort_array(F.collect_set("combo")).alias("combos"))
    counts = posts.select(id_col, "term").join(lookup(owners, "owners"), "term").groupBy(id_col, "combos").agg(F.count("*").alias("n"))
    return counts.select(id_col, "n", F.explode("combos").alias("combo")).groupBy("combo", id_col).agg(F.sum("n").alias("n_terms"))
