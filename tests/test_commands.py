import pytest

from corpusloom import Corpus
from corpusloom.__main__ import main
from corpusloom.functions.analysis import Analyzer


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    texts = {"a/1.txt": "the quick brown fox\njumps over the dog", "a/2.txt": "the quick brown fox\njumps over a cat", "b/3.txt": "nothing in common here\nat all", "b/4.txt": "fox and dog and cat"}
    for name, text in texts.items():
        (top / name).parent.mkdir(exist_ok=True)
        (top / name).write_text(text)
    return top


def test_corpus_commands(spark, tree, tmp_path, capsys):
    ix = str(tmp_path / "index")
    main(["index", "--path", f"{tree}/", "--index", ix, "--token", "letter"], spark)
    main(["search", "--index", ix, "--query", "fox NOT quick"], spark)
    main(["count", "--index", ix, "--top", "3"], spark)
    paths = [r["path"] for r in spark.read.parquet(f"{ix}/documents").orderBy("path").collect()]
    main(["similarity", "--index", ix, "--files", paths[0], paths[0]], spark)
    main(["related", paths[0], "--index", ix, "-n", "2"], spark)
    main(["extract", "--index", ix, "--output", str(tmp_path / "out"), "--numwords", "5"], spark)
    main(["kmeans", "--docs", str(tmp_path / "out/documents/0"), "--output", str(tmp_path / "k")], spark)
    main(["filters", str(tree), "--token", "letter", "--filter", "lowercase", "stop"], spark)
    main(["heaps", str(tree), "--chunks", "2", "--tail", "0"], spark)
    main(["network", str(tree), "--threshold", "0.9", "--output", str(tmp_path / "g")], spark)
    said = capsys.readouterr().out
    assert "4 documents" in said and "1 documents" in said and "Similarity = 1.00000" in said and "converged" in said
    with pytest.raises(SystemExit):
        main(["search", "--index", ix], spark)


def test_graph_commands(spark, tmp_path, capsys):
    (tmp_path / "airports.txt").write_text("".join(f'{i},"Name {c}","City","Land","{c}"\n' for i, c in enumerate(["AAA", "BBB", "CCC"])) + '9,"No code","City","Land",\\N\n')
    (tmp_path / "routes.txt").write_text("X,1,AAA,1,BBB\nX,1,BBB,1,CCC\nX,1,CCC,1,AAA\nX,1,QQQ,1,AAA\n")
    files = ["--airports", str(tmp_path / "airports.txt"), "--routes", str(tmp_path / "routes.txt")]
    main(["pagerank", *files], spark)
    main(["benchmark", *files, "-l", "0.5", "0.9", "-t", "1e-6", "-r", "2", "--output", str(tmp_path / "b")], spark)
    assert spark.read.csv(str(tmp_path / "b/results_all"), header=True).count() == 4 and spark.read.csv(str(tmp_path / "b/results"), header=True).columns[:3] == ["damping", "tolerance", "iterations"]
    said = capsys.readouterr().out
    assert "Name AAA, Land" in said and "0 iterations" in said


def test_zipf_command(spark, tmp_path, capsys):
    words = ["".join(chr(97 + (i // 26**k) % 26) for k in range(3)) for i in range(200)]
    (tmp_path / "words.txt").write_text("".join(f"{int(10000 / (i + 1))}, {w}\n" for i, w in enumerate(words)) + "----\n200 Words\n")
    main(["zipf", "-i", str(tmp_path / "words.txt")], spark)
    assert capsys.readouterr().out.count("a=") == 3


def test_fluent_corpus(spark):
    docs = spark.createDataFrame([(1, "x y y", "l"), (2, "y z", "m")], "doc_id long, text string, lang string")
    seen = Corpus(docs).analyze(Analyzer("letter", ("lowercase",)))
    assert [tuple(r) for r in seen.top(1).collect()] == [("y", 3)] and seen.postings().count() == 4
    assert tuple(seen.totals().first()) == (3, 5) and [r["doc_id"] for r in seen.search("y AND lang:m").collect()] == [2]
    assert seen.term_vectors().where("term = 'y' AND doc_id = 1").first()["df"] == 2
    assert seen.vocabulary(numwords=1).first()["term"] == "y" and seen.related(1, 2).count() == 2 and seen.network(0.99).count() == 1
