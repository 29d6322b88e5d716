"""Names found by automata against a search for each name."""

from factloom.operators import alias, graph

TEXTS = [("one", 1, "the cat sat, theatre"), ("one", 2, "ca"), ("one", 3, None), ("one", 4, ""), ("one", 4, ""), ("one", 5, "straße 東京都 cats"), ("two", 6, "the cat"), (None, 7, "the cat"), ("one", None, "hat"), ("one", 8, "ab" * 40_000 + "theatre")]
NAMES = [("one", "the"), ("one", "he"), ("one", "theatre"), ("one", "cat"), ("one", "cats"), ("one", "The"), ("one", "東京"), ("one", "ße"), ("one", None), ("one", "the"), ("two", ""), ("two", "dog"), (None, "cat"), ("three", "cat")]


def found(spark, texts=TEXTS, names=NAMES):
    t = spark.createDataFrame(texts, "namespace string, id long, text string")
    n = spark.createDataFrame(names, "namespace string, name string")
    return sorted({tuple(r) for r in alias.occurrences(t, n).collect()}, key=str)


def brute(texts=TEXTS, names=NAMES):
    return sorted({(s, n, i) for s, i, x in texts for o, n in names if s is not None and s == o and n is not None and x is not None and n in x}, key=str)


def test_every_name_in_every_text(spark):
    assert found(spark) == brute() and len(brute()) > 8


def test_many_shards_and_parts(spark, monkeypatch):
    monkeypatch.setattr(alias, "NAMES", 2)
    monkeypatch.setattr(alias, "BYTES", 30_000)
    assert found(spark) == brute()


def test_nothing_to_find(spark):
    assert found(spark, texts=[]) == [] and found(spark, names=[]) == []


def test_edges_and_hubs(spark):
    schema = "id long, namespace string, content string, superseded_by long"
    memory = spark.createDataFrame([(1, "one", "K8S and more", None), (2, "one", "kubernetes", None), (3, "one", "kubernetes k8s", None), (4, "one", "k8s", 1), (5, "two", "k8s kubernetes", None), (6, "one", None, None)], schema)
    names = spark.createDataFrame([("one", "k8s", "Kubernetes", None), ("two", "k8s", "Kubernetes", None)], "namespace string, alias string, canonical string, until timestamp")
    edges = lambda hub: {(r.src_id, r.dst_id) for r in graph.alias_edges(memory, names, hub).collect()}
    assert edges(None) == edges(2) == {(1, 2), (1, 3), (2, 3)}
    assert edges(1) == set()


def test_edges_once_and_without_a_shuffle_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART", 4)
    said = ["k8s", "kubernetes", "k8s kubernetes", "k8s kube", "kube", "none"]
    rows = [(i, "one" if i % 3 else "two", said[i % 6 if i % 4 else 2], None) for i in range(90)] + [(None, "one", "k8s kubernetes", None)]
    memory = spark.createDataFrame(rows, "id long, namespace string, content string, superseded_by long")
    known = [("one", "k8s", "kubernetes"), ("one", "kubernetes", "k8s"), ("one", "k8s", "kube"), ("two", "kube", "k8s"), ("two", "k8s", "k8s")]
    names = spark.createDataFrame([(*k, None) for k in known], "namespace string, alias string, canonical string, until timestamp")
    want = {(min(i, j), max(i, j)) for i, n, x, _ in rows for j, m, y, _ in rows for o, a, c in known if None not in (i, j) and i != j and n == m == o and a in x and c in y}
    found = graph.alias_edges(memory, names)
    got = [(r.src_id, r.dst_id) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) > 500
    assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
