"""Mixing sources to target weights by hierarchical budgeting.

Sources form a tree: domain, language, source.  The token budget flows from the
root to the leaves.  At each node the children's weights split its budget; a
child gets no more than its capacity (its tokens times ``max_epochs``), and what it
leaves over goes to its siblings by their weights.  As a node's capacity is that of
its whole subtree, a shortage reaches an ancestor only when all siblings are full.
The split of a node solves ``sum(min(capacity, weight * level)) = budget`` for the
level, in closed form with window functions over the children, so any number of
leaves is handled without the driver.

A leaf draws its documents in seeded epochs: epoch e orders them by a hash of
(seed, e, document id).  Whole epochs are taken while the budget covers them, then
the prefix of the next epoch up to the document that reaches the budget.  The
prefix of a leaf is found by the token sums of hash ranges of its documents, 256 of
them and then 256 of the one with the boundary, so only one in 65 536 documents of
a leaf is sorted; a leaf with a large share of all rows is no hot spot.

Defined cases: a token is a run of other characters than ASCII white space; null
and empty texts have none; null languages and sources are named ``(none)``; rows
that repeat an id within a leaf are one document that is drawn together, and so are
rows of a leaf that lack an id and have equal texts; nodes
without weight get ``default_weight``; an empty table gives an empty result; a
budget beyond all capacity takes everything ``max_epochs`` times.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.scratch import lookup, stored

WORD = r"[^\x20\x09-\x0D]+"
NONE = "(none)"
LEVELS = ["domain", "lang", "source"]
#: Names of the columns that tell documents apart, and of the hash that does so where there is no id.
ID, TIE = "_mix_id", "_mix_tie"
#: Of the 60 bits of an order hash, those that name a range of a leaf's documents, and the bits below a range, step by step.
RANGE_BITS = 8
RANGE_SHIFTS = (52, 44)


def _weight(name: Column, weights: Mapping[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for k, v in weights.items():
        out = F.when(name == k, F.lit(float(v))).otherwise(out)
    return out


def split_budget(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds ``budget`` to children with columns parents, name, weight, capacity and parent_budget."""
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    up = Window.partitionBy(*parents).orderBy(ratio, name) if parents else Window.partitionBy(F.lit(0)).orderBy(ratio, name)
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(0, Window.unboundedFollowing)
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(after)
    level = F.when(open_weight > 0, rest / open_weight).otherwise(F.lit(0.0))
    full = F.col("_ratio") <= F.col("_level")
    return (
        children.withColumns({"_ratio": ratio, "_level": level})
        .withColumn("_common", F.first(F.when(~full, F.col("_level")), ignorenulls=True).over(whole))
        .withColumn("budget", F.when(full, F.col("capacity")).otherwise(F.col("weight") * F.greatest(F.col("_common"), F.lit(0.0))))
        .drop("_ratio", "_level", "_common")
    )


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, float]], total_share: float, max_epochs: int, default_weight: float = 1.0) -> DataFrame:
    """levels, tokens, budget (whole tokens) for each leaf; leaves has levels and tokens."""
    sized = leaves.withColumn("capacity", F.col("tokens") * float(max_epochs))
    total = leaves.agg(F.sum("tokens").cast("double").alias("all_tokens")).select((F.col("all_tokens") * float(total_share)).alias("parent_budget"))
    budgets = None
    for depth, name in enumerate(levels):
        above = levels[:depth]
        nodes = sized.groupBy(*above, name).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(F.col(name), weights.get(name, {}), default_weight))
        if budgets is None:
            nodes = nodes.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one").drop("_one")
        else:
            nodes = nodes.join(budgets.select(*above, F.col("budget").alias("parent_budget")), above)
        budgets = split_budget(nodes, above, name)
    return leaves.join(budgets.select(*levels, F.floor(F.col("budget") + 1e-6).cast("long").alias("budget")), levels)


def _order_hash(seed: int) -> Column:
    key = F.coalesce(F.col(ID).cast("string"), F.concat(F.lit("null"), F.col(TIE).cast("string")))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string"), F.lit(":"), key))


def _identity(docs: DataFrame, domain: Column, id_col: str, text_col: str) -> list[Column]:
    """What makes a row a drawable document: its id, for rows without one a hash of their text, and its leaf."""
    tie = F.when(F.col(id_col).isNull(), F.xxhash64(F.coalesce(text_col, F.lit("")))).otherwise(F.lit(0).cast("long"))
    leaf = (domain, F.col("lang"), F.col("source"))
    return [F.col(id_col).alias(ID), tie.alias(TIE), *(F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for c, n in zip(leaf, LEVELS))]


def _boundary(partial: DataFrame, bound: DataFrame, left: int) -> DataFrame:
    """Narrows each leaf's boundary (levels, _prefix, _before) to ranges of hashes that agree but for their last left bits."""
    inner = partial.join(bound, LEVELS).where(F.shiftright("_h", left + RANGE_BITS) == F.col("_prefix"))
    ranges = inner.groupBy(*LEVELS, F.shiftright("_h", left).alias("_range")).agg(F.sum("n_tokens").alias("_size"), F.max("rest").alias("rest"), F.max("_before").alias("_start"))
    before = Window.partitionBy(*LEVELS).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begun = ranges.withColumn("_sum", F.col("_start") + F.coalesce(F.sum("_size").over(before), F.lit(0))).where("_sum < rest")
    last = begun.groupBy(*LEVELS).agg(F.max(F.struct("_range", "_sum")).alias("_last"))
    return lookup(last.select(*LEVELS, F.col("_last._range").alias("_prefix"), F.col("_last._sum").alias("_before")), "bound")


def _drawings(docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, float]], total_share: float, max_epochs: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(ID, TIE, levels, n_tokens, epoch): a row for each drawing of a document."""
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens")
    counted = docs.select(*_identity(docs, domain, id_col, text_col), tokens)
    units = stored(counted.groupBy(ID, TIE, *LEVELS).agg(F.sum("n_tokens").alias("n_tokens")), "units")
    leaves = units.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = lookup(
        leaf_budgets(leaves, LEVELS, weights, total_share, max_epochs)
        .withColumn("whole", F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(max_epochs))).otherwise(F.lit(0)).cast("int"))
        .select(*LEVELS, "whole", (F.col("budget") - F.col("whole") * F.col("tokens")).alias("rest")),
        "plan",
    )
    planned = units.join(plan, LEVELS)
    repeats = planned.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    # the next epoch of the leaves that have one: each document with the first 60 bits of its order hash
    first_bits = F.conv(F.substring(_order_hash(seed), 1, 15), 16, 10).cast("long")
    columns = [ID, TIE, *LEVELS, "n_tokens", "epoch"]
    partial = stored(planned.where("rest > 0").withColumn("epoch", F.col("whole")).select(*columns, "rest", first_bits.alias("_h")), "partial")
    bound = plan.where("rest > 0").select(*LEVELS, F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_before"))
    for left in RANGE_SHIFTS:
        bound = _boundary(partial, bound, left)
    placed = partial.withColumn("_range", F.shiftright("_h", RANGE_SHIFTS[-1])).join(bound, LEVELS)
    inside = placed.where("_range < _prefix")
    within = Window.partitionBy(*LEVELS).orderBy("_h", _order_hash(seed), ID, TIE).rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        placed.where("_range = _prefix")
        .withColumn("_start", F.col("_before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .where("_start < rest")
    )
    return repeats.select(columns).unionByName(inside.select(columns)).unionByName(edge.select(columns))


def mix(docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, float]], total_share: float = 0.6, max_epochs: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, domain, lang, source, n_tokens, epoch): a row for each drawing of a document."""
    drawn = _drawings(docs, domain, weights, total_share, max_epochs, seed, id_col, text_col)
    return drawn.select(F.col(ID).alias(id_col), *LEVELS, "n_tokens", "epoch")


def draw(docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, float]], total_share: float = 0.6, max_epochs: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that mix() draws, with all their columns; a row drawn in two epochs comes twice."""
    keys = [ID, TIE, *LEVELS]
    chosen = _drawings(docs, domain, weights, total_share, max_epochs, seed, id_col, text_col).select(*(F.col(c).alias(f"_mix_{c}") for c in keys))
    # named by position: names with dots or those of the levels cannot be misread
    own = _identity(docs, domain, id_col, text_col)
    marked = docs.select("*", *own).toDF(*(f"_row_{i}" for i in range(len(docs.columns))), *(f"_own_{n}" for n in keys))
    same = marked[f"_own_{ID}"].eqNullSafe(chosen[f"_mix_{ID}"])
    for c in keys[1:]:
        same = same & (marked[f"_own_{c}"] == chosen[f"_mix_{c}"])
    return marked.join(chosen, same).select(*(f"_row_{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)
