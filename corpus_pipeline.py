"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor
kept; all but the last return the columns of documents.

* toxicity drops documents that the trained classifier scores 0.7 or more.
* near_dedup keeps the document with the smallest id of each SimHash component.
* decontamination drops documents with a passage within the edit budget of a
  benchmark item.
* mixing draws documents by the token budgets of the domain-language-source tree;
  a document drawn in two epochs comes twice.
* sharding gives each row its shard and slot.

Defined cases: a null text is empty (clean, fingerprint 0, no tokens, size 1); rows without an
id take part in near_dedup and represent a group only where no row has one; repeated rows
are one document of near_dedup; further columns pass through all stages, whatever their
names; empty tables give an empty result, an empty benchmark or labels of one class keep
everything.

ORACLE_SQL is None: the first three stages are a trained model, 64-bit XXH64
fingerprints and approximate matching, which SQL cannot state; tests hold each
stage, and the whole run, against brute force instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, mixing, sharding, simhash, toxicity
from corpusloom.llm.queries import WEIGHTS, domain_of, table
from corpusloom.scratch import stored

ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_uncontaminated(docs, decontaminate.benchmark_items(table(spark, sf_dir, "benchmark")))


def draw_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.draw(docs, domain_of(F.col("source")), WEIGHTS)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", draw_mixture),
    ("sharding", assign_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared scratch folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
