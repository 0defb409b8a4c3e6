"""Analyzer chains: one tokenizer and an ordered list of token filters, as Column expressions.

Tokenizers and filters are built-in expressions, so a chain stays inside one
projection of the plan.  Stemmers have no built-in form; they (and what follows
them in the chain) are applied to the distinct vocabulary, not to each token, and
joined back.

``unicode`` follows the Unicode word-boundary rules, which ``standard`` approximates for scripts with
spaces; ``classic`` approximates the English grammar tokenizer.  ``kstem`` is a rule subset without a
lexicon; ``lexicon.stems`` is the stemmer that looks words up.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import stem
from corpusloom.functions.boundaries import UNICODE
from corpusloom.scratch import lookup

# Token patterns, in the syntax that Java and RE2 share.
WHITESPACE = r"[^\s]+"
LETTER = r"\p{L}+"
STANDARD = r"[\p{L}\p{N}_]+(?:['’.:][\p{L}]+|[.,'][\p{N}]+)*"
CLASSIC = r"[\p{L}\p{N}._-]+@[\p{L}\p{N}.-]+|[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)+|(?:\p{L}\.)+|\p{L}+(?:'\p{L}+)+|[\p{L}\p{N}]+"
WORD2 = r"[\p{L}\p{N}_]{2,}"
ASCII_LOWER = r"[a-z]+"

TOKENIZERS = {"whitespace": WHITESPACE, "letter": LETTER, "unicode": UNICODE, "standard": STANDARD, "classic": CLASSIC, "word2": WORD2, "ascii_lower": ASCII_LOWER}

# The English stop list.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()

# Letters that fold to more than one letter, or that have no decomposition.
EXPANDED = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D", "ı": "i"}

PLAIN_FILTERS = ("lowercase", "asciifolding", "stop")
STEMMERS = {"porter_stem": stem.porter, "stemmer": stem.porter, "snowball": stem.porter2, "kstem": stem.kstem}


def _accent_table() -> tuple[str, str]:
    """Letters with accents and their base letters, by canonical decomposition."""
    pairs = []
    for code in range(0xC0, 0x1EFA):
        ch = chr(code)
        base = unicodedata.normalize("NFD", ch)
        if len(base) > 1 and base[0].isascii() and base[0].isalpha():
            pairs.append((ch, base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BASE = _accent_table()


def fold_ascii(text: Column) -> Column:
    """Accents removed, ligatures and special letters expanded."""
    out = F.translate(text, ACCENTED, BASE)
    for a, b in EXPANDED.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def tokens(text: Column, tokenizer: str = "standard") -> Column:
    """array<string> of the tokens of a text; null text has none."""
    if tokenizer not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {tokenizer}")
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKENIZERS[tokenizer]), F.lit(0)), F.array().cast("array<string>"))


def _apply(name: str, toks: Column) -> Column:
    if name == "lowercase":
        return F.transform(toks, F.lower)
    if name == "asciifolding":
        return F.transform(toks, fold_ascii)
    if name == "stop":
        return F.filter(toks, lambda t: ~t.isin(STOP_WORDS))
    if name.startswith("length:"):
        low, high = map(int, name.removeprefix("length:").split("-"))
        return F.filter(toks, lambda t: F.length(t).between(low, high))
    raise ValueError(f"unknown filter {name}")


def filter_terms(rows: DataFrame, name: str, column: str = "term") -> DataFrame:
    """One filter over rows with a term each; scalar expressions stay in generated code."""
    if name == "lowercase":
        return rows.withColumn(column, F.lower(column))
    if name == "asciifolding":
        # most tokens are ASCII and pass untouched
        plain = F.length(column) == F.octet_length(column)
        return rows.withColumn(column, F.when(plain, F.col(column)).otherwise(fold_ascii(F.col(column))))
    if name == "stop":
        return rows.where(~F.col(column).isin(STOP_WORDS))
    low, high = map(int, name.removeprefix("length:").split("-"))
    return rows.where(F.length(column).between(low, high))


@dataclass(frozen=True)
class Analyzer:
    """Tokenizer and filters in order; order matters (stop before lowercase keeps "The")."""

    tokenizer: str = "standard"
    filters: Sequence[str] = field(default=("lowercase",))

    def __post_init__(self) -> None:
        if self.tokenizer not in TOKENIZERS:
            raise ValueError(f"unknown tokenizer {self.tokenizer}")
        for f in self.filters:
            if f not in STEMMERS and f not in PLAIN_FILTERS and not f.startswith("length:"):
                raise ValueError(f"unknown filter {f}")

    def expression(self, text: Column) -> Column:
        """The whole chain as one expression; only without stemmers."""
        out = tokens(text, self.tokenizer)
        for f in self.filters:
            out = _apply(f, out)
        return out

    def analyze(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id_col, term): a row for each token."""
        rows = df.select(id_col, F.explode(tokens(F.col(text_col), self.tokenizer)).alias("term"))
        for f in self.unstemmed().filters:
            rows = filter_terms(rows, f)
        return self.stemmed(rows)

    def frequencies(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(term, freq) over all tokens; words are counted first and each is stemmed once, so that no token meets a table of stems."""
        plain = self.unstemmed()
        rows = plain.analyze(df, id_col, text_col).groupBy("term").agg(F.count("*").alias("freq"))
        rest = self.filters[len(plain.filters):]
        for name in rest:
            rows = rows.withColumn("term", _stem_udf(name)(F.col("term"))) if name in STEMMERS else filter_terms(rows, name)
        return rows.groupBy("term").agg(F.sum("freq").alias("freq")) if rest else rows

    def unstemmed(self) -> Analyzer:
        """The chain up to its first stemmer, which is one expression."""
        first = next((i for i, f in enumerate(self.filters) if f in STEMMERS), len(self.filters))
        return Analyzer(self.tokenizer, tuple(self.filters[:first]))

    def stemmed(self, rows: DataFrame) -> DataFrame:
        """rows with their terms (column term) sent through the chain from its first stemmer on, by way of the distinct terms."""
        rest = list(self.filters[len(self.unstemmed().filters):])
        if not rest:
            return rows
        mapped = rows.select("term").distinct().withColumn("_out", F.col("term"))
        for name in rest:
            if name in STEMMERS:
                mapped = mapped.withColumn("_out", _stem_udf(name)(F.col("_out")))
            else:
                mapped = filter_terms(mapped, name, "_out")
        # stored: broadcast if small, else two plain shuffles, so that a frequent term is split
        return rows.join(lookup(mapped, "stems"), "term").withColumn("term", F.col("_out")).select(rows.columns)


def _stem_udf(name: str):
    rule = STEMMERS[name]

    @F.pandas_udf("string")
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(rule)

    return apply


# The analyzer of the clustering study.
CLUSTER_ANALYZER = Analyzer("letter", ("lowercase", "stop", "asciifolding", "snowball", "length:2-10"))


def posix_words(text: Column) -> Column:
    """Runs between punctuation and spaces, lower case, other characters than a-z deleted, empty ones dropped."""
    parts = F.split(text, r"[\p{Punct} \n]+")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(F.lower(p), "[^a-z]", "")), lambda p: p != "")


def is_alpha(token: Column) -> Column:
    return token.rlike(r"^\p{L}+$")


def to_ascii(text: Column) -> Column:
    """Every character outside ASCII becomes a question mark."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def last_components(path: Column, n: int = 2) -> Column:
    return F.substring_index(path, "/", -n)


def strip_update_suffix(path: Column) -> Column:
    """The category of a path: the part before the last slash, without a .updates suffix."""
    return F.regexp_replace(F.regexp_replace(path, r"/[^/]*$", ""), r"\.updates.*$", "")


def filter_grid(filters: Sequence[str] = ("lowercase", "asciifolding", "stop", "porter_stem", "kstem", "snowball")) -> list[tuple[str, ...]]:
    """All ordered subsets of filters, in the order of their bit masks."""
    return [tuple(f for j, f in enumerate(filters) if mask >> j & 1) for mask in range(1 << len(filters))]


def python_filter(name: str, term: str) -> str | None:
    if name == "lowercase":
        return term.lower()
    if name == "asciifolding":
        return term if term.isascii() else term.translate(_FOLD)
    if name == "stop":
        return None if term in STOP_WORDS else term
    if name.startswith("length:"):
        low, high = map(int, name.removeprefix("length:").split("-"))
        return term if low <= len(term) <= high else None
    return STEMMERS[name](term)


_FOLD = str.maketrans(dict(zip(ACCENTED, BASE)) | EXPANDED)


def grid_terms(vocabulary: DataFrame, combos: Sequence[Sequence[str]]) -> DataFrame:
    """(filters, term, freq) of a vocabulary (term, freq) under many chains, in one pass over the distinct terms."""
    chains = [tuple(c) for c in combos]
    # each prefix of a chain once, after its own prefix
    prefixes = sorted({c[:i] for c in chains for i in range(len(c) + 1)}, key=len)
    place = {c: i for i, c in enumerate(prefixes)}
    steps, ends = [(place[c[:-1]], c[-1]) for c in prefixes[1:]], [place[c] for c in chains]

    @F.pandas_udf("array<string>")
    def apply(terms: pd.Series) -> pd.Series:
        def all_of(term: str) -> list[str | None]:
            made: list[str | None] = [term]
            known: dict[tuple[str, str], str | None] = {}
            for before, f in steps:
                x = made[before]
                if x is not None:
                    if (f, x) not in known:
                        known[f, x] = python_filter(f, x)
                    x = known[f, x]
                made.append(x)
            return [made[i] for i in ends]

        return terms.map(all_of)

    # a chain is a number until its terms are counted
    got = vocabulary.select("freq", F.posexplode(apply("term")).alias("_chain", "term")).where("term IS NOT NULL AND term <> ''")
    names = F.array(*(F.lit("-".join(c)) for c in chains))
    return got.groupBy("_chain", "term").agg(F.sum("freq").alias("freq")).select(names[F.col("_chain")].alias("filters"), "term", "freq")
