import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import community, components, generators, kmeans, pagerank, paths, triangles

AIRPORTS = [("AAA", "Alpha", "X"), ("BBB", "Beta", None), ("CCC", "Gamma", "Y"), ("DDD", "Delta", "Y"), (None, "No code", "Z")]
ROUTES = [("AAA", "BBB"), ("AAA", "BBB"), ("BBB", "CCC"), ("CCC", "AAA"), ("QQQ", "AAA"), ("AAA", "ZZZ"), ("CCC", "ZZZ")]


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def cycle(n):
    return [(i, (i + 1) % n) for i in range(n)]


def test_build_counts_unknown_endpoints(spark):
    v, r = spark.createDataFrame(AIRPORTS, "code string, name string, country string"), spark.createDataFrame(ROUTES, "origin string, destination string")
    edges, outs, lost = pagerank.build_graph(v, r)
    assert {tuple(e) for e in edges.collect()} == {("AAA", "BBB", 2), ("BBB", "CCC", 1), ("CCC", "AAA", 1)}
    assert tuple(lost.first()) == (1, 1) and {tuple(o) for o in outs.collect()} == {("AAA", 2), ("BBB", 1), ("CCC", 1)}


def by_loop(n, edges, lam, steps):
    out = np.zeros(n)
    for a, _, w in edges:
        out[a] += w
    p = np.full(n, 1 / n)
    for _ in range(steps):
        q = np.full(n, (1 - lam) / n)
        for a, b, w in edges:
            q[b] += lam * p[a] * w / out[a]
        p = q / q.sum()
    return p


@pytest.mark.parametrize("local", [0, 10_000])
def test_pagerank_both_ways(spark, local):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, 8, 20), rng.integers(0, 10, 20), rng.integers(1, 4, 20))]
    merged = {}
    for a, b, w in edges:
        merged[a, b] = merged.get((a, b), 0) + w
    edges = [(a, b, w) for (a, b), w in merged.items()]
    e = spark.createDataFrame(edges, "src long, dst long, weight long")
    v = spark.range(10)
    got = {(r["damping"], r["id"]): r["rank"] for r in pagerank.pagerank(v, e, (0.5, 0.9), 3, None, local_edges=local).collect()}
    for lam in (0.5, 0.9):
        want = by_loop(10, edges, lam, 3)
        assert all(abs(got[lam, i] - want[i]) < 1e-12 for i in range(10))


def test_pagerank_converges_and_sums_to_one(spark):
    e = graph(spark, cycle(6)).withColumn("weight", F.lit(1))
    rows = pagerank.pagerank(spark.range(6), e).collect()
    assert all(abs(r["rank"] - 1 / 6) < 1e-12 and r["converged"] and r["iterations"] == 0 for r in rows)
    star = graph(spark, [(i, 0) for i in range(1, 6)] + [(0, 1)]).withColumn("weight", F.lit(1))
    for mode in ("renormalise", "redistribute"):
        for local in (0, 100):
            rows = pagerank.pagerank(spark.range(7), star, (0.5,), 60, 1e-8, mode, local_edges=local).collect()
            assert abs(sum(r["rank"] for r in rows) - 1) < 1e-6 and len(rows) == 7 and all(r["converged"] for r in rows)
            assert [r["id"] for r in pagerank.top_ranks(spark.createDataFrame(rows), 1).collect()] == [0]


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in zip(rng.integers(0, 300, 200), rng.integers(0, 300, 200))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.connected_components(graph(spark, pairs)).collect()}
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(graph(spark, pairs).where("false")).count() == 0


def test_triangles_and_clustering(spark):
    k5 = graph(spark, [(i, j) for i in range(5) for j in range(i + 1, 5)])
    local = triangles.local_clustering(k5)
    assert all((r["degree"], r["triangles"], r["clustering"]) == (4, 6, 1.0) for r in local.collect())
    assert triangles.transitivity(local).first()["transitivity"] == 1.0
    ring = generators.ring_lattice(spark, 20, 4)
    assert abs(triangles.transitivity(triangles.local_clustering(ring)).first()["average_clustering"] - 0.5) < 1e-12
    path = triangles.local_clustering(graph(spark, [(0, 1), (1, 2)]))
    assert tuple(triangles.transitivity(path).first()) == (0.0, 0.0)
    hist = {r["degree"]: r["n"] for r in triangles.degree_histogram(triangles.degrees(graph(spark, [(0, 1), (0, 2), (0, 3)]))).collect()}
    assert hist == {0: 0, 1: 3, 2: 0, 3: 1}
    assert {tuple(r) for r in triangles.canonical(graph(spark, [(2, 1), (1, 2), (3, 3)])).collect()} == {(1, 2)}
    assert {tuple(r) for r in triangles.induced(k5, spark.createDataFrame([(0,), (1,), (9,)], "node long")).collect()} == {(0, 1)}


def test_triangles_of_dense_graphs_by_bit_rows(spark, monkeypatch):
    """The same counts without a join of wedges, in blocks of any size."""
    rng = np.random.default_rng(5)
    a = np.triu(rng.random((150, 150)) < np.linspace(0.02, 0.6, 150)[:, None], 1)
    a[140:, :] = a[:, 140:] = False
    e = graph(spark, [(int(i) * 3 + 10**10, int(j) * 3 + 10**10) for i, j in np.argwhere(a)])
    whole = (a | a.T).astype(int)
    want = {i * 3 + 10**10: t for i, t in enumerate((whole @ whole * whole).sum(1) // 2) if t}
    for ways in ({}, {"few": 0}, {"few": 0, "rows": 37, "bits": 64}):
        assert {r["node"]: r["triangles"] for r in triangles.triangles(e, **ways).collect()} == want
    asked = []
    monkeypatch.setattr(triangles, "_by_bits", lambda *args: asked.append(args))
    triangles.triangles(e, few=1000)
    assert asked


def test_paths(spark):
    nodes = lambda n: spark.range(n).withColumnRenamed("id", "node")
    row = paths.average_path_length(graph(spark, [(0, 1), (1, 2), (2, 3)]), nodes(4)).first()
    assert row["connected"] and abs(row["average_length"] - 20 / 12) < 1e-12
    row = paths.average_path_length(graph(spark, [(0, 1), (2, 3)]), nodes(4)).first()
    assert row["average_length"] is None and not row["connected"]
    assert paths.approximate_diameter(graph(spark, cycle(9)), nodes(1)).first()[0] == 4


@pytest.mark.parametrize("local", [0, 1_000_000])
def test_communities_find_cliques(spark, local):
    pairs = [(10 * c + i, 10 * c + j) for c in range(4) for i in range(6) for j in range(i + 1, 6)] + [(10 * c, 10 * ((c + 1) % 4) + 1) for c in range(4)]
    e = graph(spark, pairs)
    labels = community.communities(e, local_edges=local)
    got = {r["node"]: r["community"] for r in labels.collect()}
    assert community.modularity(e, labels) > 0.6
    assert {got[10 * c + i] for c in range(4) for i in range(6)} == {0, 10, 20, 30} or local == 0
    row = community.size_summary(labels).first()
    assert row["n_communities"] == len(set(got.values())) and row["min_size"] >= 1
    cats = labels.select("node", (F.col("node") % 2).alias("category"))
    assert community.category_mix(labels, cats).agg(F.sum("n")).first()[0] == 24


def test_generators(spark):
    n = generators.erdos_renyi(spark, 200, 0.1).count()
    assert 1700 < n < 2300
    ba = generators.barabasi_albert(spark, 300, 3)
    assert ba.count() >= 3 * 290 and ba.where("src = dst").count() == 0
    settings = spark.createDataFrame([(0.0, 0), (0.2, 0), (1.0, 0)], "p double, rep int")
    ws = generators.watts_strogatz(spark, 100, 4, settings)
    counts = {r["p"]: r["n"] for r in ws.groupBy("p").agg(F.count("*").alias("n")).collect()}
    assert counts[0.0] == 200 and all(195 <= c <= 200 for c in counts.values()) and ws.where("src = dst").count() == 0
    lattice = generators.ring_lattice(spark, 100, 4)
    assert ws.where("p = 0").select("src", "dst").exceptAll(lattice).count() == 0


VECTORS = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "x"), (3, "y"), (4, "q")]
PROTOS = [(0, "a", 1.0), (0, "b", 1.0), (1, "x", 1.0), (1, "y", 1.0), (1, "z", 1.0)]


def test_kmeans_step_in_both_modes(spark):
    v, p = spark.createDataFrame(VECTORS, "doc_id long, term string"), spark.createDataFrame(PROTOS, "cluster int, term string, p double")
    near = {r["doc_id"]: (r["cluster"], round(r["similarity"], 6)) for r in kmeans.assign(v, p).collect()}
    assert near == {1: (0, 1.0), 2: (0, round(2 / 3, 6)), 3: (1, round(2 / 3, 6)), 4: (0, 0.0)}  # no overlap: a tie, the smaller cluster
    far = {r["doc_id"]: r["cluster"] for r in kmeans.assign(v, p, "min_similarity").collect()}
    assert far == {1: 1, 2: 1, 3: 0, 4: 0}
    new = {(r["cluster"], r["term"]): r["p"] for r in kmeans.recompute(v, kmeans.assign(v, p)).collect()}
    assert new[0, "a"] == 2 / 3 and new[0, "q"] == 1 / 3 and new[1, "x"] == 1.0 and (1, "z") not in new


def test_kmeans_converges_on_a_partition(spark):
    v = spark.createDataFrame([(i, f"{'ab'[i % 2]}{j}") for i in range(20) for j in range(i % 5 + 1)], "doc_id long, term string")
    assigned, _, n, done = kmeans.kmeans(v, kmeans.initial_prototypes(v, 3), 15)
    assert done and n < 15 and assigned.count() == 20
    relabelled = assigned.withColumn("cluster", 100 - F.col("cluster"))
    assert kmeans.partition_hash(assigned) == kmeans.partition_hash(relabelled)
    assert kmeans.initial_prototypes(v, 4, replace=True).select("cluster").distinct().count() == 4


@pytest.mark.parametrize("name", ["g01_unknown_endpoints", "g02_pagerank_as_dataframes", "g04_pagerank_sweep", "g06_connected_components", "g09_transitivity", "m03_kmeans_three_iterations", "r12_top_attributes", "g11_average_path_length"])
def test_queries_equal_sql(spark, oracle, name):
    oracle(spark, name)


@pytest.mark.parametrize("name", ["v09_j05_similarity_network_reference", "g08_degree_histogram_reference"])
def test_network_at_the_reference_threshold_equals_sql(spark, oracle, name):
    oracle(spark, name)


def test_reference_network_keeps_pairs_of_distance_under_seven_tenths(spark):
    import __spark_entry__ as entry

    got = entry.queries()["v09_j05_similarity_network_reference"](spark, "/root/testdata/sf0.001").agg(F.min("similarity"), F.count("*")).first()
    assert 0.3 < got[0] <= 0.6
    assert {f"{n}_reference" for n in ("k06_adjacency", "s14_k06_gexf", "g05_undirected_pagerank", "g06_connected_components", "g13_communities", "a16_j08_category_mix", "m09_degree_bins")} <= set(entry.queries())


def test_communities_are_the_same_at_every_size(spark):
    rng = np.random.default_rng(5)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 14, (24, 2)).tolist() if a != b} | {(20 + i, 20 + j) for i in range(5) for j in range(i + 1, 5)} | {(3, 20)})
    one, other = ({r["node"]: r["community"] for r in community.communities(graph(spark, pairs), local_edges=n).collect()} for n in (10_000, 0))
    assert one == other and set(one) == {x for p in pairs for x in p}
    assert _all_connected(one, pairs)


def _shuffled_rows(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_communities_by_sent_labels_are_those_of_joins_and_shuffle_edges_once_a_level(spark):
    rng = np.random.default_rng(8)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in (rng.integers(0, 12, (500, 2)) + 12 * rng.integers(0, 6, (500, 1))).tolist()} | {(min(a, b), max(a, b)) for a, b in rng.integers(0, 80, (60, 2)).tolist()})
    weighted = spark.createDataFrame([(a, b, float(1 + (a * b) % 3)) for a, b in pairs], "src long, dst long, weight double")  # loops too
    ways = [dict(local_edges=10_000), dict(local_edges=0), dict(local_edges=0, most_sent=0)]
    one, sent, joined = ({r["node"]: r["community"] for r in community.communities(weighted, **w).collect()} for w in ways)
    assert one == sent == joined and len(set(one.values())) < 12
    dense = [(i, j) for i in range(90) for j in range(i + 1, 90) if i % 3 == j % 3 or (i + j) % 7 == 0]
    before = _shuffled_rows(spark)
    assert community.communities(graph(spark, dense), local_edges=0).select("community").distinct().count() == 3
    assert _shuffled_rows(spark) - before < 4 * len(dense)


def test_lists_are_handled_some_at_once(monkeypatch):
    lists = [[1, 2, 3], [0], [0, 3], [0, 2]]
    batch = pa.RecordBatch.from_pydict({"node": pa.array(range(4), pa.int32()), "near": pa.array(lists, pa.list_(pa.int32())), "weights": pa.array([[float(y) for y in x] for x in lists])})
    for most in (1, 2, 3, 100):
        monkeypatch.setattr(community, "_AT_ONCE", most)
        got = [(int(nodes[i]), int(j), float(k)) for nodes, x, y, w in community._lists([batch]) for i, j, k in zip(x, y, w, strict=True)]
        assert got == [(i, y, float(y)) for i, x in enumerate(lists) for y in x]


def _all_connected(labels, pairs):
    for c in set(labels.values()):
        own = {x for x in labels if labels[x] == c}
        seen, todo = set(), [min(own)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [b if a == x else a for a, b in pairs if x in (a, b) and {a, b} <= own]
        if seen != own:
            return False
    return True


def test_communities_are_refined_into_connected_parts(spark):
    """A star whose hub went elsewhere leaves leaves apart; both ways split it, and modularity does not fall."""
    pairs = [(0, 1), (1, 2), (5, 6), (6, 7), (2, 9), (7, 9), (9, 10), (9, 11)]
    edges = graph(spark, pairs)
    before = {0: 0, 1: 0, 2: 0, 5: 0, 6: 0, 7: 0, 9: 9, 10: 9, 11: 9}
    labels = spark.createDataFrame(list(before.items()), "node long, community long")
    split = community._connected(labels, edges)
    got = {r["node"]: r["community"] for r in split.collect()}
    assert got == {0: 0, 1: 0, 2: 0, 5: 5, 6: 5, 7: 5, 9: 9, 10: 9, 11: 9}
    names = sorted(before)
    place = {x: i for i, x in enumerate(names)}
    at = community._connected_places(np.array([place[before[x]] for x in names]), np.array([place[a] for a, _ in pairs]), np.array([place[b] for _, b in pairs]))
    assert {x: names[p] for x, p in zip(names, at)} == got
    assert community.modularity(edges, split) >= community.modularity(edges, labels)


def test_communities_end_where_no_merger_raises_modularity(spark):
    rng = np.random.default_rng(6)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 400, (900, 2)).tolist() if a != b} | {(i, i + 1) for i in range(1000, 1400)})
    got = {r["node"]: r["community"] for r in community.communities(graph(spark, pairs)).collect()}
    assert _all_connected(got, pairs)
    size, between = {}, {}
    for a, b in pairs:
        for c in (got[a], got[b]):
            size[c] = size.get(c, 0) + 1
        key = tuple(sorted((got[a], got[b])))
        between[key] = between.get(key, 0) + 1
    assert all(c == min(v for v, x in got.items() if x == c) for c in size)
    assert all(w - size[a] * size[b] / (2 * len(pairs)) <= 1e-6 for (a, b), w in between.items() if a != b)


@pytest.mark.parametrize("suffix", ["", "_reference"])
def test_sizes_and_mix_are_those_of_communities(spark, suffix):
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.001"
    run = lambda name: entry.queries()[name + suffix](spark, sf_dir).collect()
    labels = {r["node"]: r["community"] for r in run("g13_communities")}
    sizes, mix = {}, {}
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for node, c in labels.items():
        sizes[c] = sizes.get(c, 0) + 1
        mix[c, source[node]] = mix.get((c, source[node]), 0) + 1
    largest = min(sizes, key=lambda c: (-sizes[c], c))
    assert [tuple(r) for r in run("g14_louvain_community_sizes")] == [(len(sizes), min(sizes.values()), max(sizes.values()), largest)]
    assert {(r["community"], r["category"]): r["n"] for r in run("a16_louvain_category_mix")} == mix


def test_path_lengths_of_many_graphs(spark):
    rows = [(0.5, 0, i, (i + 1) % 6) for i in range(6)] + [(0.5, 1, 0, 1), (0.5, 1, 2, 3)]
    got = paths.average_path_length_of_each(spark.createDataFrame(rows, "p double, rep int, src long, dst long"), ["p", "rep"], 6)
    assert {r["rep"]: r["average_length"] for r in got.collect()} == {0: 1.8, 1: None}


def test_sweep_has_path_lengths_and_normalised_means(spark):
    import __spark_entry__ as entry

    rows = sorted(entry.queries()["g19_watts_strogatz_sweep"](spark, "/root/testdata/sf0.001").collect())
    assert len(rows) == 50 and rows[0]["p"] == 0 and rows[0]["mean"] == 0.5 and rows[0]["std"] == 0
    assert abs(rows[0]["length_mean"] - (2 * sum(range(1, 125)) * 2 + 125 * 3) / 499) < 2 and rows[0]["length_normalised"] == rows[0]["mean_normalised"] == 1
    assert rows[-1]["length_mean"] < 10


def test_heaps_is_fitted_for_each_book(spark):
    import __spark_entry__ as entry

    got = {r["book"]: r for r in entry.queries()["m04_m06_heaps_fit"](spark, "/root/testdata/sf0.001").collect()}
    books = {r["book"] for r in entry.queries()["m06_heaps_log_log"](spark, "/root/testdata/sf0.001").collect()}
    assert books and books <= set(got) and all(r["k"] >= 0 and 0 <= r["beta"] <= 1 for r in got.values())


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_reach_is_that_of_a_search_from_each_source(spark, sent):
    rng = __import__("random").Random(5)
    pairs = {(rng.randrange(150), 200 + rng.randrange(12)) for _ in range(170)} | {(500, 501), (7, 7)}
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    sources, want = [a for a in near if a != 500] + [900], {}
    for s in sources:
        seen, front, step = {s}, {s}, 0
        while front:
            front, step = {y for x in front for y in near.get(x, ())} - seen, step + 1
            seen |= front
            if front:
                want[step] = want.get(step, 0) + len(front)
    nodes = spark.createDataFrame([(n,) for n in sources], "node long")
    got = paths.reach(graph(spark, sorted(pairs)), nodes, sent)
    assert {r["distance"]: r["pairs"] for r in got.collect()} == want


def test_path_lengths_store_no_pairs(spark, monkeypatch):
    """A graph that fits every task leaves only its arcs and numbers in storage, whatever the sources."""
    names = []
    keep = paths.stored
    monkeypatch.setattr(paths, "stored", lambda df, name="part": names.append(name) or keep(df, name))
    nodes = spark.range(400).withColumnRenamed("id", "node")
    assert paths.average_path_length(graph(spark, [(i, i + 1) for i in range(399)]), nodes).first()["connected"]
    assert set(names) == {"arcs", "numbers"}


@pytest.mark.parametrize("mode", ["renormalise", "redistribute"])
def test_pagerank_of_larger_graphs_moves_ranks_not_edges(spark, mode, monkeypatch):
    pairs = [(i, (i * 7 + k) % 40) for i in range(40) for k in range(3) if i % 9]  # every ninth has no out-edge
    edges = graph(spark, pairs).withColumn("weight", F.lit(1))
    nodes = spark.range(40)
    want = {r["id"]: r["rank"] for r in pagerank.pagerank(nodes, edges, (0.85,), 12, None, mode).collect()}
    plans = []
    keep = pagerank.checkpoint
    monkeypatch.setattr(pagerank, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    for sent in (0, 1_000_000):
        monkeypatch.setattr(pagerank, "MOST_SENT", sent)
        plans.clear()
        got = {r["id"]: r["rank"] for r in pagerank.pagerank(nodes, edges, (0.85,), 12, None, mode, local_edges=0).collect()}
        assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-12 for v in want)
        assert len(plans) == 13  # the start and one for each step
    assert all("BroadcastHashJoin [v" in x or "BroadcastHashJoin [src" in x for x in plans[1:])


@pytest.mark.parametrize("mode", ["renormalise", "redistribute"])
def test_pagerank_over_lists_of_edges(spark, mode):
    """Steps over stored lists give what one task gives: weights, dangling vertices, edges of unknown ends, several damping factors, convergence."""
    rng = np.random.default_rng(4)
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 60, 300), rng.integers(0, 60, 300)) if a % 9})
    nodes = spark.range(62).select(F.concat(F.lit("v"), "id").alias("id"))
    for top in (1, 4):
        edges = spark.createDataFrame([(f"v{a}", f"v{b}", 1 + (a * b) % top) for a, b in pairs], "src string, dst string, weight long")
        for steps, atol in ((7, None), (200, 1e-9)):
            args = ((0.5, 0.95), steps, atol, mode)
            want, got = ({(r["damping"], r["id"]): r for r in pagerank.pagerank(nodes, edges, *args, **how).collect()} for how in ({}, {"local_edges": 0, "joined_edges": 0}))
            assert got.keys() == want.keys() and len(got) == 124
            assert all(abs(got[k]["rank"] - r["rank"]) < 1e-12 and got[k]["iterations"] == r["iterations"] and got[k]["converged"] == r["converged"] for k, r in want.items())


def test_steps_keep_the_planners_estimates_small(spark, monkeypatch):
    """Estimates of checkpointed joins double their digits with each step of PageRank, and have four times as many after each round of components."""
    bits = []
    for module, names in ((pagerank, ["checkpoint"]), (components, ["checkpoint", "stored"])):
        for name in names:
            def noted(df, *rest, keep=getattr(module, name)):
                out = keep(df, *rest)
                bits.append(len(out._jdf.queryExecution().optimizedPlan().stats().simpleString()))
                return out

            monkeypatch.setattr(module, name, noted)
    edges = graph(spark, cycle(30)).withColumn("weight", F.lit(1))
    pagerank.pagerank(spark.range(30), edges, (0.85,), 10, None, local_edges=0).count()
    assert len(bits) == 11 and max(bits) < 60
    bits.clear()
    monkeypatch.setattr(components, "CHECKPOINTED", 0)
    assert {r["component"] for r in components.connected_components(graph(spark, [(i, i + 1) for i in range(200)])).collect()} == {0}
    assert len(bits) > 8 and max(bits) < 200
