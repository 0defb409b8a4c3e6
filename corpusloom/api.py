"""Fluent entry points over a table of documents."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.analysis import Analyzer
from corpusloom.operators import postings as po
from corpusloom.operators import search, tfidf, vocab


class Corpus:
    """A table with an id and a text column."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.df, self.id_col, self.text_col = df, id_col, text_col

    def analyze(self, analyzer: Analyzer = Analyzer()) -> Analyzed:
        return Analyzed(self, analyzer)


class Analyzed:
    """A corpus seen through an analyzer; every result is a DataFrame."""

    def __init__(self, corpus: Corpus, analyzer: Analyzer):
        self.corpus, self.analyzer = corpus, analyzer

    @cached_property
    def terms(self) -> DataFrame:
        c = self.corpus
        return self.analyzer.analyze(c.df, c.id_col, c.text_col)

    def postings(self) -> DataFrame:
        return po.postings(self.terms, self.corpus.id_col)

    def term_vectors(self) -> DataFrame:
        return po.term_vectors(self.postings(), self.corpus.id_col)

    def frequencies(self) -> DataFrame:
        return po.term_frequency(self.terms)

    def document_frequencies(self) -> DataFrame:
        return po.document_frequency(self.postings())

    def totals(self) -> DataFrame:
        return po.totals(self.frequencies())

    def top(self, n: int = 10) -> DataFrame:
        return po.top_terms(self.frequencies(), n)

    def ranks(self) -> DataFrame:
        return po.ranked(self.frequencies())

    def tfidf(self, flavor: str = "max") -> DataFrame:
        return tfidf.tfidf(self.postings(), self.corpus.df.count(), flavor, self.corpus.id_col)

    def related(self, doc_id: object, n: int = 10, candidates: DataFrame | None = None) -> DataFrame:
        return tfidf.related(self.tfidf(), doc_id, self.corpus.df if candidates is None else candidates, n, self.corpus.id_col)

    def network(self, max_distance: float = 0.7, flavor: str = "smooth") -> DataFrame:
        return tfidf.similarity_join(self.tfidf(flavor), 1 - max_distance, self.corpus.id_col)

    def search(self, query: str) -> DataFrame:
        """The documents that match a query; other columns of the table are its fields."""
        c = self.corpus
        fields = {name: F.col(name) for name in c.df.columns if name != c.text_col}
        toks = self.analyzer.expression(F.col(c.text_col))
        return c.df.where(search.parse(query, toks, search.simple_analyze(self.analyzer), fields))

    def vocabulary(self, minfreq: float = 0.0, maxfreq: float = 1.0, numwords: int = 100) -> DataFrame:
        return vocab.band(self.document_frequencies(), vocab.grid(self.corpus.df.sparkSession, [minfreq], [maxfreq], [numwords]))
