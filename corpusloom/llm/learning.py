"""What the trained operators share: the held-out fold and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column) -> Column:
    """True for the third of all keys that nothing is learned from; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def one_label(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, label as 0 or 1): labels of rows that may be learned from, one for each id.

    Null ids and labels are left out; where rows of an id disagree, 1 holds.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col)))
    return known.groupBy(id_col).agg(F.max((F.col(label) > 0).cast("int")).alias(label))


def balanced_sample(labels: DataFrame, label: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most rows ids of each class, drawn by a hash of the id."""
    order = [F.xxhash64(F.col(id_col).cast("string"), F.lit(17)), F.col(id_col)]
    parts = [labels.where(F.col(label) == y).orderBy(*order).limit(rows) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def texts_of(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs' rows with the sample's labels; sample has a bounded number of rows, so it is broadcast."""
    return docs.join(F.broadcast(sample), id_col)
