"""corpusloom: text mining and network analytics on Spark DataFrames."""

from corpusloom.api import Analyzed, Corpus

__all__ = ["Analyzed", "Corpus"]
