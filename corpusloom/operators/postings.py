"""Inverted postings and the counts derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.scratch import lookup, stored


def gathered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents placed by id before they are analyzed: texts travel, not their many tokens, and counts of (id, term) need no further shuffle."""
    return docs.select(id_col, text_col).repartition(id_col)


def postings(terms: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, term, tf): term vectors in long form; partial counts precede the shuffle."""
    return terms.groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def document_frequency(posts: DataFrame) -> DataFrame:
    """(term, df)"""
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def term_vectors(posts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, term, tf, df)"""
    posts = stored(posts, "postings")  # read for the document frequencies and again
    return posts.join(lookup(document_frequency(posts), "df"), "term").select(id_col, "term", "tf", "df")


def term_frequency(terms: DataFrame) -> DataFrame:
    """(term, freq) over the corpus."""
    return terms.groupBy("term").agg(F.count("*").alias("freq"))


def totals(freq: DataFrame) -> DataFrame:
    """One row: distinct words and all words."""
    return freq.agg(F.count("*").alias("n_unique"), F.coalesce(F.sum("freq"), F.lit(0)).alias("n_total"))


def ranked(freq: DataFrame, by: str = "freq") -> DataFrame:
    """Adds rank (1 for the most frequent, ties by term) without gathering all rows in one task.

    Rows are numbered inside buckets of equal magnitude of the count, and the
    buckets' sizes give the offsets.  Words that occur once are about half of a
    vocabulary, so buckets of one small count are cut further by the first two
    bytes of the term, which its order follows: a few thousand rows of sizes.
    """
    exact = F.col(by) < 64
    bucket = F.when(exact, F.col(by)).otherwise(F.lit(64) + F.floor(F.log2(F.col(by)) * 16)).cast("int")
    start = F.when(exact, F.substring(F.col("term").cast("binary"), 1, 2)).otherwise(F.lit(b""))
    placed = freq.withColumns({"_b": bucket, "_p": start})
    sizes = placed.groupBy("_b", "_p").agg(F.count("*").alias("_n"))
    above = Window.orderBy(F.desc("_b"), "_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", "_p", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_b", "_p").orderBy(F.desc(by), "term")
    return placed.withColumn("_r", F.row_number().over(inside)).join(F.broadcast(offsets), ["_b", "_p"]).withColumn("rank", (F.col("_off") + F.col("_r")).cast("long")).drop("_b", "_p", "_r", "_off")


def top_terms(freq: DataFrame, n: int, by: str = "freq") -> DataFrame:
    """The n most frequent; a distributed top-k, ties by term."""
    return freq.orderBy(F.desc(by), "term").limit(n)


def word_sketches(terms: DataFrame, *groups: str, bits: int = 14) -> DataFrame:
    """(groups, sketch): a sketch of the distinct terms of each group, of some 2**bits bytes at most, whatever the terms."""
    return terms.groupBy(*groups).agg(F.hll_sketch_agg("term", F.lit(bits)).alias("sketch"))


def united(sketches: DataFrame, *groups: str) -> DataFrame:
    """(groups, n_unique): the estimated number of distinct terms of groups of sketches united; new sketches need no old terms."""
    return sketches.groupBy(*groups).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_unique"))
