"""Sources and sinks: text trees, delimited tables, line formats of vectors, prototypes and run logs."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Inputs under this size may sit in a single row group; dealing them out costs next to nothing.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame, key: str, most: int = SPREAD_BYTES) -> DataFrame:
    """df dealt out over all cores if it is small; larger inputs have row groups enough and stay where they are."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > most:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def read_tree(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """(path, text) of all files below a folder, decoded; a trailing slash does not matter."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path.rstrip("/"))
    return files.select("path", F.decode("content", encoding).alias("text"))


def list_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files below a folder, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path.rstrip("/")).select("path", "length")


def read_headerless(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",") -> DataFrame:
    r"""A headerless table in which \N and empty fields are null."""
    df = spark.read.schema(schema).csv(path, sep=sep, header=False, nullValue="\\N", emptyValue="")
    return df.select(*(F.nullif(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields))


def read_table(spark: SparkSession, paths: str | Sequence[str], schema: str, sep: str = ",") -> DataFrame:
    """One or more result tables with headers."""
    return spark.read.schema(schema).csv(paths if isinstance(paths, str) else list(paths), header=True, sep=sep)


def read_sliced(df: DataFrame, slices: int, id_col: str = "doc_id") -> DataFrame:
    """Adds slice (0 .. slices - 1) and deals rows out by it."""
    return df.withColumn("slice", F.pmod(F.col(id_col), F.lit(slices))).repartition(slices, "slice")


def find_by_path(docs: DataFrame, path: str) -> DataFrame:
    """The first document of a path; raises if there is none."""
    found = docs.where(F.col("path") == path).limit(1)
    if found.isEmpty():
        raise LookupError(f"no document has the path {path}")
    return found


def parse_count_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(freq, word) of "count, word" lines; other lines are skipped."""
    parts = F.split(F.col(column), ", ")
    number = F.expr(f"try_cast(trim(split({column}, ', ')[0]) AS BIGINT)")
    return lines.where(F.size(parts) == 2).select(number.alias("freq"), parts[1].alias("word")).where("freq IS NOT NULL")


def parse_vectors(lines: DataFrame, column: str = "value") -> DataFrame:
    """(doc, term) of "doc:w1 w2 ..." lines; the document's name may hold colons of its own."""
    parts = F.split(F.col(column), ":")
    split_ = lines.where(F.contains(F.col(column), F.lit(":"))).select(parts.alias("_p"))
    name = F.array_join(F.slice("_p", F.lit(1), F.size("_p") - 1), ":")
    return split_.select(name.alias("doc"), F.explode(F.split(F.element_at("_p", -1), " ")).alias("term")).where("term <> ''")


def parse_prototypes(lines: DataFrame, column: str = "value") -> DataFrame:
    """(cluster, term, p) of "CLASS:w+p w+p ..." lines."""
    halves = lines.where(F.contains(F.col(column), F.lit(":"))).select(F.split(F.col(column), ":").alias("_p"))
    parts = halves.select(F.col("_p")[0].alias("cluster"), F.explode(F.split(F.col("_p")[1], " ")).alias("w")).where("w <> ''")
    pair = F.split("w", r"\+")
    return parts.select("cluster", pair[0].alias("term"), pair[1].cast("double").alias("p"))


def parse_run_logs(lines: DataFrame, file: str = "file", order: str = "line", value: str = "value") -> DataFrame:
    """(file, repetition, iteration, seconds, converged): states of a run log carried to its time lines.

    ``REP n`` and ``Iteration n`` lines set the state, ``Time=`` lines close an
    iteration, a line that contains "converged" marks the run.
    """
    w = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def last_of(pattern: str) -> Column:
        got = F.regexp_extract(value, pattern, 1)
        return F.last(F.when(got != "", got.cast("int")), ignorenulls=True).over(w)

    seconds = F.regexp_extract(value, r"Time=\s*([0-9.]+)", 1)
    run = lines.withColumns({
        "repetition": last_of(r"^REP\s+(\d+)"), "iteration": last_of(r"^Iteration\s+(\d+)"),
        "seconds": F.when(seconds != "", seconds.cast("double")),
        "_c": F.contains(F.lower(value), F.lit("converged")).cast("int"),
    })
    run = run.withColumn("converged", F.max("_c").over(Window.partitionBy(file, "repetition")) == 1)
    return run.where("seconds IS NOT NULL").select(file, "repetition", "iteration", "seconds", "converged")


def run_parameters(folder: Column) -> Column:
    """(min_freq, max_freq, n_words) of a folder named "min_max_words", or "words_min_max": a number over 1 can't be a share."""
    part = F.split(F.substring_index(folder, "/", -1), "_")
    number = [F.try_element_at(part, F.lit(i)).cast("double") for i in (1, 2, 3)]
    first = number[0] > 1
    order = [F.when(first, number[(i + 1) % 3]).otherwise(number[i]) for i in range(3)]
    return F.struct(order[0].alias("min_freq"), order[1].alias("max_freq"), order[2].cast("long").alias("n_words"))


def run_table(runs: DataFrame, vocabulary_lines: DataFrame, prototype_lines: DataFrame, file: str = "file") -> DataFrame:
    """(min_freq, max_freq, n_words, actual_words, clusters_init, iteration, it_converged, it_clusters, it_time) of parsed logs.

    The lines of vocabulary.txt, prototype.txt and prototypesN.txt in a log's folder (column file)
    count its words, its first clusters and those of iteration N; a file that is not there counts 0.
    A run that converged did so in its last iteration.
    """
    folder = F.regexp_replace(F.col(file), "/[^/]*$", "")
    words = vocabulary_lines.groupBy(folder.alias("_folder")).agg(F.count("*").alias("actual_words"))
    n = F.regexp_extract(F.col(file), r"prototypes?(\d*)\.txt$", 1)
    clusters = prototype_lines.groupBy(folder.alias("_folder"), n.alias("_n")).agg(F.count("*").alias("c"))
    first = clusters.where("_n = ''").select("_folder", F.col("c").alias("clusters_init"))
    own = clusters.where("_n <> ''").select("_folder", F.col("_n").cast("int").alias("iteration"), F.col("c").alias("it_clusters"))
    placed = runs.withColumn("_folder", folder).join(words, "_folder", "left").join(first, "_folder", "left").join(own, ["_folder", "iteration"], "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("actual_words", "clusters_init", "it_clusters")]
    ended = F.col("iteration") == F.max("iteration").over(Window.partitionBy(file))
    marked = placed.withColumns({"_p": run_parameters(F.col("_folder")), "it_converged": F.col("converged") & ended})
    return marked.select("_p.min_freq", "_p.max_freq", "_p.n_words", *zero[:2], "iteration", "it_converged", zero[2], F.col("seconds").alias("it_time"))


def write_index(docs: DataFrame, path: str, tokenizer: str, filters: Sequence[str], text_col: str = "text") -> tuple[int, int]:
    """Replaces a dataset of documents and keeps the analyzer's settings beside it: (documents written, documents that failed).

    A document without a text can't be indexed; both numbers are observed while writing.
    """
    seen = Observation()
    failed = F.col(text_col).isNull()
    watched = docs.observe(seen, F.count("*").alias("all"), F.count(F.when(failed, 1)).alias("failed"))
    watched.where(~failed).write.mode("overwrite").parquet(f"{path}/documents")
    settings = json.dumps({"tokenizer": tokenizer, "filters": list(filters)})
    docs.sparkSession.createDataFrame([(settings,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/analyzer")
    return seen.get["all"] - seen.get["failed"], seen.get["failed"]


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/documents"), json.loads(spark.read.text(f"{path}/analyzer").first()[0])


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=sep)


def vector_lines(vectors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(value): "doc:w1 w2 ..." lines with sorted words."""
    return vectors.groupBy(id_col).agg(F.array_join(F.sort_array(F.collect_set("term")), " ").alias("_w")).select(F.concat_ws(":", F.col(id_col).cast("string"), "_w").alias("value"))


def prototype_lines(prototypes: DataFrame) -> DataFrame:
    """(value): "CLASSi:w+p ..." lines with sorted words."""
    word = F.struct("term", F.concat_ws("+", "term", F.col("p").cast("string")).alias("w"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(word)), lambda x: x["w"]), " ")
    return prototypes.groupBy("cluster").agg(joined.alias("_w")).select(F.concat(F.lit("CLASS"), F.col("cluster").cast("string"), F.lit(":"), F.col("_w")).alias("value"))


def assignment_lines(assigned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    docs = F.array_join(F.sort_array(F.collect_list(F.col(id_col).cast("string"))), " ")
    return assigned.groupBy("cluster").agg(docs.alias("_d")).select(F.concat(F.lit("CLASS"), F.col("cluster").cast("string"), F.lit(":"), F.col("_d")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): GEXF elements of nodes (node) and edges (src, dst), in order of a leading rank column."""
    head = {0: '<?xml version="1.0" encoding="UTF-8"?><gexf version="1.2"><graph defaultedgetype="undirected"><nodes>', 2: "</nodes><edges>", 4: "</edges></graph></gexf>"}
    # sorted by ids, which are shorter than their elements
    n = nodes.select(F.lit(1).alias("part"), F.col("node").alias("a"), F.lit(None).alias("b"))
    e = edges.select(F.lit(3).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"))
    fixed = nodes.sparkSession.createDataFrame([(k,) for k in head], "part int").select("part", F.lit(None).alias("a"), F.lit(None).alias("b"))
    node = F.format_string('<node id="%s"/>', F.col("a").cast("string"))
    edge = F.format_string('<edge source="%s" target="%s"/>', F.col("a").cast("string"), F.col("b").cast("string"))
    value = F.when(F.col("part") == 1, node).when(F.col("part") == 3, edge)
    for k, text in head.items():
        value = value.when(F.col("part") == k, F.lit(text))
    return fixed.unionByName(n).unionByName(e).orderBy("part", "a", "b").select("part", value.alias("value"))


def read_gexf(lines: DataFrame, column: str = "value") -> DataFrame:
    """(src, dst) of the edge elements of a GEXF text."""
    hit = F.explode(F.regexp_extract_all(F.col(column), F.lit(r'<edge [^>]*source="([^"]*)"[^>]*>'), F.lit(0))).alias("e")
    return lines.select(hit).select(F.regexp_extract("e", 'source="([^"]*)"', 1).alias("src"), F.regexp_extract("e", 'target="([^"]*)"', 1).alias("dst"))
