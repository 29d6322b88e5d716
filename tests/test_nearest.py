"""Exact nearest rows, in blocks of probes and rows."""

import numpy as np
import pytest

from factloom.functions import vector
from factloom.plans import catalog

RNG = np.random.default_rng(5)


@pytest.mark.parametrize("sizes", [(8_192, 32_768, 2_048), (9, 40, 16)])
def test_agrees_with_brute_force_in_any_blocks(spark, monkeypatch, sizes):
    for name, size in zip(("PROBES", "ROWS", "TILE"), sizes, strict=True):
        monkeypatch.setattr(vector, name, size)
    x = RNG.normal(size=(300, 8)).astype(np.float32)
    x[100:160], x[160:170], x[7] = x[3], 2 * x[4], 0  # copies, another length, none
    rows = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)] + [(999, None)], "id long, embedding array<float>")
    probes = rows.filter("id % 5 = 0 and embedding is not null").selectExpr("id as probe_id", "embedding as vector")
    found = {}
    for r in vector.nearest(rows, probes, 12).orderBy("probe_id", "rank").collect():
        found.setdefault(r.probe_id, []).append((r.id, r.similarity))
    y = x.astype(float)
    near = [i for i in range(300) if i != 7]
    for p in range(0, 300, 5):
        s = {i: float((y[p] * y[i]).sum() / np.sqrt((y[p] ** 2).sum() * (y[i] ** 2).sum())) for i in near}
        want = sorted(near, key=lambda i: (-round(s[i], 12), i))[:12]
        assert [i for i, _ in found[p]] == want
        assert np.allclose([v for _, v in found[p]], [s[i] for i in want])


def test_no_side_is_taken_to_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(*_):
        raise AssertionError("rows at the driver")

    rows = spark.range(200).selectExpr("id", "array(float(id + 1), float(id % 7), 1f) as embedding")
    probes = rows.selectExpr("id as probe_id", "embedding as vector")
    for name in ("toArrow", "toPandas", "collect"):
        monkeypatch.setattr(DataFrame, name, refuse)
    out = vector.nearest(rows, probes, 3)
    monkeypatch.undo()
    assert out.count() == 600


def test_what_is_relevant_is_counted_not_listed(spark):
    r = catalog.relevance(spark, "/root/testdata/sf0.001")
    assert "gold" not in r.columns and dict(r.dtypes)["relevant"] == "bigint"
    assert all(len(x.ids) == len(x.hits) == 20 for x in r.collect())


@pytest.mark.parametrize("spread", [0.2, 5.0])
def test_cells_that_cannot_hold_nearer_rows_are_left_out(spark, monkeypatch, spread):
    for name, size in (("PROBES", 40), ("ROWS", 30)):
        monkeypatch.setattr(vector, name, size)
    monkeypatch.setattr(vector.cells, "PER_CELL", 20)
    met = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(vector, "_best", lambda q, x, k, least, f=vector._best: met.add(len(q) * len(x)) or f(q, x, k, least))
    centres = RNG.normal(size=(20, 8))
    x = (centres[np.arange(800) % 20] + RNG.normal(scale=spread, size=(800, 8))).astype(np.float32)
    x[5::20] = x[5]  # one cluster is copies
    rows = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "id long, embedding array<float>")
    probes = rows.filter("id % 5 = 0").selectExpr("id as probe_id", "embedding as vector")
    found = {}
    for r in vector.nearest(rows, probes, 7).orderBy("probe_id", "rank").collect():
        found.setdefault(r.probe_id, []).append(r.id)
    y = x.astype(float)
    y /= np.sqrt((y * y).sum(axis=1, keepdims=True))
    for p in range(0, 800, 5):
        s = np.round((y[p] * y).sum(axis=1), 12)
        assert found[p] == sorted(range(800), key=lambda i: (-s[i], i))[:7]
    assert spread > 1 or 0 < met.value < 160 * 800 / 4
