"""A dictionary stemmer: endings come off only where what remains is a known word.

A word's stem is found by rules in order: the first whose ending it has and whose
result is in the lexicon.  The result is stemmed in turn, until no rule applies.  Listed headwords, which
only look inflected, are never cut.  The lexicon is the corpus's own vocabulary, as far as
its words occur often enough, together with the headwords.

Rules are expressions over the distinct vocabulary, a lookup is a join, and chains of lookups are
closed by joining the mapping with itself; nothing runs for each token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.scratch import stored

# Endings, what takes their place, and the least length of what remains; the first that gives a known word holds.
RULES = (
    ("ies", "y", 2), ("ies", "ie", 2), ("es", "e", 2), ("es", "", 3), ("s", "", 3),
    ("ied", "y", 2), ("ied", "ie", 2), ("ed", "e", 2), ("ed", "", 3),
    ("ying", "ie", 1), ("ing", "e", 2), ("ing", "", 3),
    ("iness", "y", 2), ("ness", "", 3), ("ily", "y", 2), ("bly", "ble", 2), ("ally", "al", 2), ("ally", "", 4), ("ly", "", 3),
    ("ization", "ize", 2), ("isation", "ise", 2), ("ation", "ate", 2), ("ation", "e", 3), ("ation", "", 4), ("ion", "e", 3), ("ion", "", 4),
    ("ability", "able", 2), ("ibility", "ible", 2), ("ity", "e", 3), ("ity", "", 4), ("iment", "y", 3), ("ment", "", 4),
    ("ier", "y", 2), ("er", "e", 2), ("er", "", 3), ("or", "e", 3), ("or", "", 4), ("ism", "", 4), ("ize", "", 4), ("ise", "", 4),
)
#: Endings after which a doubled consonant loses one letter (stopped, stop).
DOUBLED = ("ed", "ing", "er")
#: Words that look inflected and are not.
HEADWORDS = (
    "access across address always anything as bed being bless bring business bus ceiling class cross does during evening everything express "
    "feed gas glass has his hundred is its king lens less loss mass meeting morning need news nothing number other over paper pass perhaps plus "
    "press process red ring river seed series shed sing something species speed spring string success thing this thus unless us was water wing witness yes"
).split()


def _ends(term: Column, ending: str, least: int) -> Column:
    return F.endswith(term, F.lit(ending)) & (F.length(term) - len(ending) >= least)


def _results(term: Column) -> list[Column]:
    """The results of the rules that apply, null for the others, in order."""
    def cut(n: int) -> Column:
        return F.substring(term, F.lit(1), F.length(term) - n)

    out = []
    for ending in DOUBLED:
        rest = cut(len(ending))
        twice = (F.length(rest) > 3) & (F.right(rest, F.lit(1)) == F.substring(rest, F.length(rest) - 1, F.lit(1))) & ~F.right(rest, F.lit(1)).isin(*"aeiou")
        out.append(F.when(F.endswith(term, F.lit(ending)) & twice, cut(len(ending) + 1)))
    return out + [F.when(_ends(term, ending, least), F.concat(cut(len(ending)), F.lit(put))) for ending, put, least in RULES]


def stems(vocabulary: DataFrame, least_count: int = 2) -> DataFrame:
    """(term, stem) of each distinct term of a vocabulary (term, freq); terms of fewer occurrences than least_count are no lexicon entries."""
    spark = vocabulary.sparkSession
    words = vocabulary.groupBy("term").agg(F.sum("freq").alias("freq"))
    words = stored(words, "words")
    head = spark.createDataFrame([(w,) for w in HEADWORDS], "term string")
    known = words.where(F.col("freq") >= least_count).select(F.col("term").alias("result")).union(head).distinct()
    results = F.array(*(F.struct(F.lit(i).alias("rule"), r.alias("result")) for i, r in enumerate(_results(F.col("term")))))
    tried = words.select("term", F.explode(F.filter(results, lambda x: x["result"].isNotNull() & (F.length(x["result"]) > 1))).alias("r"))
    free = tried.where(~F.col("term").isin(HEADWORDS)).select("term", "r.rule", "r.result")
    mapping = stored(free.join(known, "result").groupBy("term").agg(F.min(F.struct("rule", "result")).alias("first")).select("term", F.col("first.result").alias("stem")), "stems")
    while True:  # results are shorter, so chains end; each round doubles how far they reach
        further = mapping.select(F.col("term").alias("stem"), F.col("stem").alias("_next"))
        longer = stored(mapping.join(further, "stem", "left").select("term", F.coalesce("_next", "stem").alias("stem"), F.col("_next").isNotNull().alias("_moved")), "stems")
        done = longer.where("_moved").isEmpty()
        mapping = longer.drop("_moved")
        if done:
            return words.select("term").join(mapping, "term", "left").select("term", F.coalesce("stem", "term").alias("stem"))


def stemmed(terms: DataFrame, mapping: DataFrame) -> DataFrame:
    """(stem, freq) of a vocabulary's terms (term, freq)."""
    return terms.join(mapping, "term").groupBy("stem").agg(F.sum("freq").alias("freq"))


def sql(vocabulary: str, least_count: int = 2) -> str:
    """The same for DuckDB: (term, stem) of a table of (term, freq)."""
    def quoted(words) -> str:
        return ", ".join(f"'{w}'" for w in words)

    tries = []
    for i, ending in enumerate(DOUBLED):
        n = len(ending)
        tries.append(f"SELECT term, {i} AS rule, left(term, length(term) - {n + 1}) AS result FROM lv WHERE term LIKE '%{ending}' AND length(term) - {n} > 3 AND substr(term, length(term) - {n}, 1) = substr(term, length(term) - {n + 1}, 1) AND substr(term, length(term) - {n}, 1) NOT IN ('a', 'e', 'i', 'o', 'u')")
    for i, (ending, put, least) in enumerate(RULES, len(DOUBLED)):
        tries.append(f"SELECT term, {i} AS rule, left(term, length(term) - {len(ending)}) || '{put}' AS result FROM lv WHERE term LIKE '%{ending}' AND length(term) - {len(ending)} >= {least}")
    return f"""lv AS (SELECT term, sum(freq) AS freq FROM ({vocabulary}) GROUP BY term),
known AS (SELECT term FROM lv WHERE freq >= {least_count} UNION SELECT unnest([{quoted(HEADWORDS)}])),
tried AS ({" UNION ALL ".join(tries)}),
one AS (SELECT term, arg_min(result, rule) AS stem FROM tried WHERE length(result) > 1 AND result IN (SELECT term FROM known) AND term NOT IN ({quoted(HEADWORDS)}) GROUP BY term),
chain AS (SELECT term, stem FROM one UNION ALL SELECT c.term, o.stem FROM chain c JOIN one o ON o.term = c.stem),
lexicon AS (SELECT lv.term, coalesce(arg_min(chain.stem, length(chain.stem)), lv.term) AS stem FROM lv LEFT JOIN chain ON chain.term = lv.term GROUP BY lv.term)"""
