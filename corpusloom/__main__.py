"""Commands over the operators: python -m corpusloom COMMAND --help."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import Corpus
from corpusloom.functions import analysis as an
from corpusloom.operators import community, components, kmeans, laws, pagerank, tfidf, triangles, vocab
from corpusloom.operators import index as inverted
from corpusloom.operators import postings as po
from corpusloom.scratch import stored
from corpusloom.sources import corpus as src


def session() -> SparkSession:
    return SparkSession.builder.appName("corpusloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _open(spark: SparkSession, index: str) -> tuple[Corpus, an.Analyzer]:
    docs, settings = src.read_index(spark, index)
    return Corpus(docs), an.Analyzer(settings["tokenizer"], tuple(settings["filters"]))


def _show(df: DataFrame, most: int = 50) -> None:
    df.show(most, truncate=80)


def index(spark, a):
    tree = src.read_tree(spark, a.path, a.encoding).select(F.xxhash64("path").alias("doc_id"), "path", "text")
    written, failed = src.write_index(tree, a.index, a.token, a.filter)
    inverted.create(src.read_index(spark, a.index)[0], f"{a.index}/inverted", an.Analyzer(a.token, tuple(a.filter)))
    print(written, "documents" + f", {failed} failed" * bool(failed))


def find(spark, a):
    made = inverted.Index(spark, f"{a.index}/inverted")
    query = a.query if a.query else " OR ".join(a.text.split())
    hits = stored(made.match({"": query}, scores=True).select("path", F.substring("text", 1, 10).alias("head"), "score"), "hits")
    print(hits.count(), "documents")
    _show(hits.orderBy(F.desc("score"), "path"))


def count(spark, a):
    corpus, analyzer = _open(spark, a.index)
    freq = stored(corpus.analyze(analyzer).frequencies(), "freq")
    order = ["term"] if a.alpha else [F.desc("freq"), "term"] if a.top else ["freq", "term"]
    ordered = freq.orderBy(*order)
    if a.all:  # the whole vocabulary, a partition at a time
        for r in ordered.toLocalIterator():
            print(f"{r['freq']}, {r['term']}")
    else:
        _show(ordered.limit(a.top) if a.top else ordered, a.top or 1_000)
    _show(po.totals(freq))


def similarity(spark, a):
    corpus, analyzer = _open(spark, a.index)
    ids = [src.find_by_path(corpus.df, p).first()["doc_id"] for p in a.files]
    weights = corpus.analyze(analyzer).tfidf()
    if a.print:
        _show(weights.where(F.col("doc_id").isin(ids)).orderBy("doc_id", "term"))
    row = tfidf.cosine_of_pairs(weights, spark.createDataFrame([tuple(ids)], "a long, b long")).first()
    print(f"Similarity = {row['similarity']:3.5f}")


def related(spark, a):
    corpus, analyzer = _open(spark, a.index)
    doc = src.find_by_path(corpus.df, a.path).first()["doc_id"]
    candidates = corpus.df
    for p in a.ignore_paths:
        candidates = candidates.where(~F.col("path").startswith(p))
    seen = corpus.analyze(analyzer)
    _show(tfidf.keywords(seen.tfidf().where(F.col("doc_id") == doc), 10))
    _show(seen.related(doc, a.n, candidates).join(corpus.df.select("doc_id", "path"), "doc_id").orderBy(F.desc("similarity"), "doc_id").select("path", "similarity"))


def zipf(spark, a):
    lines = src.parse_count_lines(spark.read.text(a.input)).where(an.is_alpha(F.col("word")))
    ranks = stored(po.ranked(lines.withColumnRenamed("word", "term")), "ranks")
    for name, skip, bounded in (("naive", 0, False), ("bounded", 0, True), (f"bounded, {a.skip} skipped", a.skip, True)):
        (x, b, c), cost = laws.fit_zipf(ranks, skip, bounded)
        print(f"{name}: a={x:.6g} b={b:.6g} c={c:.6g} sum of squares={cost:.6g}")


def heaps(spark, a):
    lines = src.read_tree(spark, a.path, a.encoding).select(F.element_at(F.split("path", "/"), -1).alias("book"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    words = laws.line_pieces(lines, a.chunks).select("book", "piece", F.explode(an.posix_words(F.col("text"))).alias("word"))
    points = stored(laws.growth(words, a.chunks), "growth")
    if a.output:
        src.write_table(points, a.output, a.sep)
    for r in laws.fit_heaps_of_each(laws.without_tail(points, a.tail), "book").orderBy("book").toLocalIterator():
        print(f"{r['book']}: k={r['k']:.6g} beta={r['beta']:.6g} sum of squares={r['cost']:.6g}")


def filters(spark, a):
    docs = src.read_tree(spark, a.path, a.encoding).select("path", "text")
    for t in a.token or [*an.TOKENIZERS][:4]:
        freq = stored(po.term_frequency(an.Analyzer(t, ()).analyze(docs, "path")), "freq")
        terms = an.grid_terms(freq, an.filter_grid(a.filter))
        print(t)
        _show(terms.groupBy("filters").agg(F.count("*").alias("n_unique"), F.sum("freq").alias("n_total")).orderBy("filters"), 100)


def _routes(spark, a):
    airports = src.read_headerless(spark, a.airports, "c1 string, name string, c3 string, country string, code string")
    routes = src.read_headerless(spark, a.routes, "c1 string, c2 string, origin string, c4 string, destination string")
    vertices = airports.where(F.length("code") == 3).select(F.col("code").alias("id"), F.concat("name", F.lit(", "), "country").alias("name"))
    edges, _, lost = pagerank.build_graph(vertices, routes, "id")
    return vertices, stored(edges, "edges"), lost


def ranks(spark, a):
    vertices, edges, lost = _routes(spark, a)
    _show(lost)
    began = time.time()
    got = stored(pagerank.pagerank(vertices, edges, (a.l,), a.max_iterations, a.tolerance), "ranks")
    first = got.first()
    print(f"{first['iterations']} iterations, converged: {first['converged']}, {time.time() - began:.3f} s")
    named = got.join(vertices, "id").select("rank", "id", "name").orderBy(F.desc("rank"), "id")
    _show(named if a.all else named.limit(a.top), 10_000)


def sweep(spark, a):
    vertices, edges, _ = _routes(spark, a)
    runs = pagerank.benchmark(vertices, edges, a.l, a.t, a.repetitions, a.max_iterations)
    if a.output:
        src.write_table(runs, f"{a.output}/results_all")
        src.write_table(pagerank.benchmark_means(runs), f"{a.output}/results")
    _show(pagerank.benchmark_means(runs).orderBy("damping", "tolerance"), 10_000)


def extract(spark, a):
    corpus, analyzer = _open(spark, a.index)
    posts = stored(corpus.analyze(analyzer).postings(), "postings")
    combos = vocab.grid(spark, a.minfreq, a.maxfreq, a.numwords)
    bands = stored(vocab.band(po.document_frequency(posts), combos), "bands")
    src.write_table(vocab.band_stats(bands, combos), f"{a.output}/stats")
    src.write_table(bands, f"{a.output}/vocabulary")
    for (combo,) in combos.select("combo").collect():
        src.write_lines(src.vector_lines(vocab.restricted(posts, bands.where(F.col("combo") == combo))), f"{a.output}/documents/{combo}")


def cluster(spark, a):
    vectors = src.parse_vectors(spark.read.text(a.docs)).withColumnRenamed("doc", "doc_id")
    protos = kmeans.initial_prototypes(vectors, a.nclust, a.seed)
    began = time.time()
    assigned, protos, n, done = kmeans.kmeans(vectors, protos, a.iter, a.mode)
    print(f"{n} iterations, converged: {done}, {time.time() - began:.3f} s")
    if a.output:
        src.write_lines(src.prototype_lines(protos), f"{a.output}/prototypes")
        src.write_lines(src.assignment_lines(assigned), f"{a.output}/assignments")
    _show(kmeans.top_attributes(protos, a.natt).orderBy("cluster", "rank"), 1_000)


def network(spark, a):
    docs = src.read_tree(spark, a.path, a.encoding).select(F.xxhash64("path").alias("doc_id"), "text", F.lower("text").alias("low"))
    edges = stored(Corpus(docs, text_col="low").analyze(an.Analyzer("word2", ())).network(a.threshold), "network")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    _show(triangles.graph_info(edges, nodes))
    _show(triangles.transitivity(triangles.local_clustering(edges)))
    parts = components.connected_components(edges)
    _show(parts.groupBy("component").count().orderBy(F.desc("count"), "component"), 10)
    labels = stored(community.communities(edges), "labels")
    _show(community.size_summary(labels))
    if a.output:
        src.write_lines(src.gexf_lines(nodes, edges).select("value"), a.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom")
    sub = p.add_subparsers(required=True)

    def command(f, *options, name=None):
        c = sub.add_parser(name or f.__name__)
        for flag, kw in options:
            c.add_argument(*flag.split(), **kw)
        c.set_defaults(run=f)

    need, tree = {"required": True}, ("--encoding", {"default": "ISO-8859-1"})
    ix = ("--index", need)
    command(index, ("--path", need), ix, tree, ("--token", {"default": "standard", "choices": ["standard", "whitespace", "classic", "letter"]}), ("--filter", {"nargs": "*", "default": ["lowercase"]}))
    command(find, ix, ("--text", {"default": ""}), ("--query", {}), name="search")
    command(count, ix, ("--alpha", {"action": "store_true"}), ("--top", {"type": int, "default": 0}), ("--all", {"action": "store_true"}))
    command(similarity, ix, ("--files", {"nargs": 2, **need}), ("--print", {"action": "store_true"}))
    command(related, ("path", {}), ix, ("--ignore-paths", {"nargs": "*", "default": []}), ("-n", {"type": int, "default": 10}))
    command(zipf, ("-i --input", need), ("--skip", {"type": int, "default": 10}))
    command(heaps, ("path", {}), ("--chunks", {"type": int, "default": 50}), ("--tail", {"type": int, "default": 3150}), ("--output", {}), ("--sep", {"default": ","}), tree)
    command(filters, ("path", {}), ("--token", {"nargs": "*"}), ("--filter", {"nargs": "*", "default": ["lowercase", "asciifolding", "stop", "porter_stem", "kstem", "snowball"]}), tree)
    graph = (("--airports", {"default": "airports.txt"}), ("--routes", {"default": "routes.txt"}), ("--max-iterations", {"type": int, "default": 1000}))
    command(ranks, *graph, ("-l", {"type": float, "default": 0.9}), ("--tolerance", {"type": float, "default": 1e-10}), ("--top", {"type": int, "default": 10}), ("--all", {"action": "store_true"}), name="pagerank")
    command(sweep, *graph, ("-l", {"type": float, "nargs": "*", "default": [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.99]}), ("-t", {"type": float, "nargs": "*", "default": [1e-6, 1e-7, 1e-8, 1e-9, 1e-10]}), ("-r --repetitions", {"type": int, "default": 5}), ("--output", {}), name="benchmark")
    command(extract, ix, ("--output", need), ("--minfreq", {"type": float, "nargs": "*", "default": [0.0]}), ("--maxfreq", {"type": float, "nargs": "*", "default": [1.0]}), ("--numwords", {"type": int, "nargs": "*", "default": [100]}))
    command(cluster, ("--docs", need), ("--nclust", {"type": int, "default": 2}), ("--iter", {"type": int, "default": 5}), ("--natt", {"type": int, "default": 5}), ("--seed", {"type": int, "default": 1}), ("--mode", {"default": "max_similarity", "choices": ["max_similarity", "min_similarity"]}), ("--output", {}), name="kmeans")
    command(network, ("path", {}), ("--threshold", {"type": float, "default": 0.7}), ("--output", {}), tree)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    if a.run is find and not (a.text or a.query):
        raise SystemExit("give --text or --query")
    a.run(spark or session(), a)


if __name__ == "__main__":
    main()
