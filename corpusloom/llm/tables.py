"""Whole rows passed through a stage, whatever the names of their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def by_position(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1, ...: names with dots or that clash with a stage's own cannot be misread."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def place(docs: DataFrame, name: str) -> str:
    """The name that by_position() gives a column."""
    return f"c{docs.columns.index(name)}"
