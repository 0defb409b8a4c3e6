"""Document fingerprints by a homomorphic multiset hash (native: DataFrame functions only).

A paragraph (a line) is hashed to a wide vector, and a document's fingerprint is
the sum of its paragraphs' vectors, each lane modulo a power of two.  Addition
commutes, so the order of paragraphs does not matter, and paragraphs are inserted
or deleted by adding or subtracting vectors, without the rest of the document
(:func:`add`, :func:`subtract`).

The vector has two parts:

* 8 lanes modulo 2**60, each 60 bits of its own of the paragraph's SHA-512.  Equal
  multisets of paragraphs have equal lanes, others differ but for a chance of about
  2**-480.
* 63 lanes modulo 2**31 with their number of summands: the bits
  of a hash of each two-word piece of the paragraph.  A lane minus its expectation
  is a sum of random signs, so the cosine of two documents' lanes estimates the
  likeness of their contents (a tug-of-war sketch).  No string has 2**31 pieces, so
  the lanes of a document never wrap; likeness of sums is meant for under 2**31 in all.

Documents are paired with the next in descending id order without a global sort:
ids are cut into ranges at approximate quantiles, each range is one window
partition, and the first row of each range is copied into the range before it.  Rows
without an id, or with one that many share, are cut further by their texts' hashes.

Defined cases: null text is empty; an empty text has one empty paragraph and no
pieces; likeness of equal fingerprints is 1, of others that lack pieces 0; with one
document the next is itself; null ids come last; repeated ids follow in order of a
hash of their texts; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY_LANES = 8
#: Hex digits of an identity lane.
DIGITS = 15
_IDENTITY = (1 << 60) - 1
PACKED_LANES = 21
_LANE = (1 << 20) - 1
_SHIFTS = (0, 21, 42)
_ONES = sum(1 << s for s in _SHIFTS)
_WIDE = (1 << 31) - 1
#: Up to two words of one line.
PIECE = r"[^\x20\x09-\x0D]+(?:[\x20\x09\x0B-\x0D]+[^\x20\x09-\x0D]+)?"
MOST_RANGES = 65_536
#: Rows without an id beyond which equal ones are counted before they are shuffled, and copies that one task makes of a count.
MANY_ROWS = 10_000
COPIES = 1_000


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _hashes(text: Column) -> Column:
    return F.struct(
        F.transform(F.split(text, "\n"), lambda p: F.sha2(p, 512)).alias("paragraphs"),
        F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p)).alias("pieces"),
    )


def _sum_identity(digests: Column) -> Column:
    def lane(k: int) -> Column:
        # 15 of each 16 hex digits
        part = lambda d: F.conv(F.substring(d, 16 * k + 1, DIGITS), 16, 10).cast("long")
        return F.aggregate(digests, _long(0), lambda a, d: (a + part(d)).bitwiseAND(_long(_IDENTITY)))

    return F.array(*(lane(k) for k in range(IDENTITY_LANES)))


def _sum_bits(hashes: Column) -> Column:
    """Numbers of hashes that have each of the bits 0 to 62, counted three to a long in runs that can't overflow."""
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(hashes) - 1, F.lit(0)) / _LANE).cast("int")), lambda i: F.slice(hashes, i * _LANE + 1, _LANE))

    def packed(run: Column) -> Column:
        def lane(k: Column) -> Column:
            return F.aggregate(run, _long(0), lambda a, h: a + F.call_function("shiftrightunsigned", h, k).bitwiseAND(_long(_ONES)))

        return F.transform(F.sequence(F.lit(0), F.lit(PACKED_LANES - 1)), lane)

    def unpacked(lanes: Column) -> Column:
        return F.flatten(F.transform(lanes, lambda x: F.array(*(F.shiftright(x, s).bitwiseAND(_long(_LANE)).cast("int") for s in _SHIFTS))))

    zero = F.array_repeat(F.lit(0), 3 * PACKED_LANES)
    return F.aggregate(F.transform(runs, packed), zero, lambda a, lanes: F.zip_with(a, unpacked(lanes), lambda x, y: x + y))


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds struct column name: identity, lanes and n, and name_paragraphs.

    The hashes are a column of their own that two others read, so the planner
    evaluates them once and not inside the loops over lanes.
    """
    raw = f"_{name}_hashes"
    h = F.col(raw)
    return df.withColumn(raw, _hashes(text)).withColumns({
        name: F.struct(
            _sum_identity(h["paragraphs"]).alias("identity"),
            _sum_bits(h["pieces"]).alias("lanes"),
            F.size(h["pieces"]).cast("long").alias("n"),
        ),
        f"{name}_paragraphs": F.size(h["paragraphs"]),
    }).drop(raw)


def _combine(a: Column, b: Column, sign: int) -> Column:
    def modulo(mask: int) -> Callable[[Column, Column], Column]:
        return lambda x, y: (x.cast("long") + y * sign).bitwiseAND(_long(mask))

    return F.struct(
        F.zip_with(a["identity"], b["identity"], modulo(_IDENTITY)).alias("identity"),
        F.zip_with(a["lanes"], b["lanes"], lambda x, y: modulo(_WIDE)(x, y).cast("int")).alias("lanes"),
        (a["n"] + b["n"] * sign).alias("n"),
    )


def add(a: Column, b: Column) -> Column:
    """Fingerprint of the union of two multisets of paragraphs."""
    return _combine(a, b, 1)


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint after the deletion of b's paragraphs from a's."""
    return _combine(a, b, -1)


def to_hex(fp: Column) -> Column:
    wide = F.transform(F.concat(fp["identity"], F.array(fp["n"])), lambda x: F.lpad(F.hex(x), 16, "0"))
    return F.lower(F.array_join(F.concat(wide, F.transform(fp["lanes"], lambda x: F.lpad(F.hex(x.cast("long")), 8, "0"))), ""))


def _signed(fp: Column) -> Column:
    return F.transform(fp["lanes"], lambda c: (c.cast("long") * 2 - fp["n"]).cast("double"))


def with_likeness(df: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """Adds the likeness, from 0 to 1, of fingerprint columns a and b."""
    left, right = F.col(f"_{name}_a"), F.col(f"_{name}_b")
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(left, left) * dot(right, right))
    cosine = F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(left, right) / norm))).otherwise(F.lit(0.0))
    return (
        df.withColumns({f"_{name}_a": _signed(F.col(a)), f"_{name}_b": _signed(F.col(b))})
        .withColumn(name, F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(cosine))
        .drop(f"_{name}_a", f"_{name}_b")
    )


def _range_of(value: Column, bounds: list) -> Column:
    """The number of bounds that are at most value, by two short scans."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse = F.size(F.filter(F.lit([r[0] for r in rows]), lambda b: b <= value))
    inner = F.array(*(F.lit(r) for r in rows))
    fine = F.size(F.filter(F.element_at(inner, F.greatest(coarse, F.lit(1))), lambda b: b <= value))
    return F.when(coarse > 0, (coarse - 1) * step + fine).otherwise(F.lit(0))


def with_next(df: DataFrame, id_col: str, tie: str, columns: list[str]) -> DataFrame:
    """Adds next_* for columns: those of the row with the next smaller id; the last is followed by the first.

    The driver takes one id for each range, at most MOST_RANGES.
    """
    spark = df.sparkSession
    n = min(MOST_RANGES, max(64, 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))))  # many for each task, so that tasks are even
    read = df.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], 4 * n).alias("q"), F.count(F.when(F.col(id_col).isNull(), 1)).alias("nulls")).first()
    cuts = read["q"] or []
    bounds = sorted(set(cuts))
    # an id that is two quantiles, and null, may have a large share of the rows: their ranges are cut by tie
    hot = [c for c, n_cuts in Counter(cuts).items() if n_cuts > 1]
    shared = F.col(id_col).isNull() | (F.col(id_col).isin(hot) if hot else F.lit(False))
    counted = bool(hot) or read["nulls"] > MANY_ROWS
    if counted:
        # equal rows of such an id become one row with their number: all but the last are followed by an equal one
        once = df.where(shared).groupBy(id_col, tie).agg(*(F.first(c).alias(c) for c in df.columns if c not in (id_col, tie)), F.count("*").alias("_copies"))
        df = df.where(~shared).withColumn("_copies", F.lit(1).cast("long")).unionByName(once)
    by_tie = F.when(shared, F.shiftright(tie, 56) + 129).otherwise(F.lit(0))  # from 1 to 256; the range's larger ids come before
    number = F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(_range_of(F.col(id_col), bounds))
    place = (number.cast("long") * 512 - by_tie).cast("long")
    placed = df.withColumn("_range", place)
    heads = [r for r in placed.groupBy("_range").agg(F.max(id_col).alias("id"), F.max(F.struct(F.col(id_col), F.negate(F.shiftright(tie, 1)))).alias("top")).orderBy(F.desc("_range")).collect()]
    if not heads:
        return placed.withColumns({f"next_{c}": F.col(c) for c in columns}).drop("_range", "_copies")
    ranges = [r["_range"] for r in heads]
    kind = dict(df.dtypes)[id_col]
    # the head of each range also closes the range before it; the first head closes the last range
    ends = spark.createDataFrame(
        [(r["id"], -r["top"][1], ranges[i - 1]) for i, r in enumerate(heads)], f"_head_id {kind}, _head_tie long, _closes long"
    )
    same = placed[id_col].eqNullSafe(F.col("_head_id")) & (F.shiftright(placed[tie], 1) == F.col("_head_tie"))
    spread = placed.join(F.broadcast(ends), same, "left").withColumn(
        "_at", F.explode(F.filter(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("end")), F.struct(F.col("_closes").alias("r"), F.lit(1).alias("end"))), lambda x: x["r"].isNotNull()))
    ).drop("_range", "_head_id", "_head_tie", "_closes").withColumns({"_range": F.col("_at.r"), "_end": F.col("_at.end")}).drop("_at")
    w = Window.partitionBy("_range").orderBy("_end", F.desc_nulls_last(id_col), tie)
    followed = spread.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where("_end = 0").drop("_range", "_end")
    return _copied(followed, columns) if counted else followed


def _copied(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as often as _copies says; only its last copy keeps what follows, the others are followed by themselves."""
    names = [c for c in rows.columns if c != "_copies"]
    # in two steps, so that the copies of one row are spread over tasks
    steps = rows.withColumn("_step", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / COPIES))))
    dealt = steps.where("_copies = 1").unionByName(steps.where("_copies > 1").repartition("_step", "_tie"))
    copy = F.explode(F.sequence(F.col("_step") * COPIES + 1, F.least((F.col("_step") + 1) * COPIES, F.col("_copies"))))
    last = F.col("_copy") == F.col("_copies")
    return dealt.withColumn("_copy", copy).withColumns({f"next_{c}": F.when(last, F.col(f"next_{c}")).otherwise(F.col(c)) for c in columns}).select(names)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness; see the query's contract."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col), text.alias("_text")).withColumns({"_tie": F.xxhash64("_text"), "n_chars": F.length("_text").cast("long")})
    own = with_next(with_fingerprint(base, F.col("_text"), "fp"), id_col, "_tie", ["_text", "fp"])
    k = F.floor(F.col("n_chars") / 3).cast("int")
    edited = own.withColumn("_edited", F.concat(F.substring(F.col("_text"), F.lit(1), F.col("n_chars").cast("int") - k), F.substring(F.col("next__text"), F.lit(1), k)))
    both = with_fingerprint(edited.drop("_text", "next__text", "_tie"), F.col("_edited"), "edited_fp")
    liked = with_likeness(with_likeness(both, "near_edited", "fp", "edited_fp"), "near_next", "fp", "next_fp")
    return liked.select(
        id_col, "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), to_hex(F.col("fp")).alias("fingerprint"),
        to_hex(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next",
        F.col("fp_paragraphs").alias("n_paragraphs"), F.col("edited_fp_paragraphs").alias("n_edited_paragraphs"),
    )
