"""The small-world graph against comparison with every row."""

import uuid

import numpy as np
import pytest

from factloom.functions import small_world
from factloom.operators import neighbours

RNG = np.random.default_rng(4)


def recall(x, probes, ids, allowed=None):
    u = small_world.unit(x)
    s = small_world.unit(probes) @ u.T
    if allowed is not None:
        s[:, ~allowed] = -9
    cut = np.sort(s, axis=1)[:, -ids.shape[1]]
    return np.mean([(s[i, ids[i][ids[i] >= 0]] >= cut[i] - 1e-6).sum() / ids.shape[1] for i in range(len(ids))])


def clusters(n, many, d=16):
    centres = RNG.normal(size=(many, d))
    return (centres[np.arange(n) % many] + RNG.normal(scale=0.3, size=(n, d))).astype(np.float32)


@pytest.mark.parametrize("n", [1, 2, 9, 40, 700])
def test_small_graphs_find_all(n):
    x = RNG.normal(size=(n, 12))
    ids, sims, compared = small_world.search(small_world.build(x), x[:30], min(n, 10))
    assert recall(x, x[:30], ids) > 0.99 and (ids >= 0).all() and (np.diff(sims, axis=1) <= 1e-6).all()


def test_few_are_compared_and_filtered_pages_are_full():
    x = clusters(6000, 60)
    g, probes = small_world.build(x), x[::20]
    ids, _, compared = small_world.search(g, probes, 10)
    assert recall(x, probes, ids) >= 0.95 and compared.mean() < 0.2 * len(x)
    assert (small_world.search(g, probes, 10, beam=10, allowed=np.ones(len(x), bool))[0] == small_world.search(g, probes, 10, beam=10)[0]).all()
    for share, beam in ((0.095, 100), (0.005, 100), (0.095, 12), (0.3, 40)):
        allowed = RNG.random(len(x)) < share
        ids, _, _ = small_world.search(g, probes, 10, beam, allowed)
        assert (ids >= 0).all() and allowed[ids].all() and recall(x, probes, ids, allowed) >= 0.9
    far = np.zeros(len(x), bool)
    far[np.arange(len(x)) % 60 == 7] = True  # one cluster, far from most probes
    ids, _, _ = small_world.search(g, probes, 10, beam=2, allowed=far)  # 100 count, a walk of 2 sees fewer
    assert (ids >= 0).all() and far[ids].all()
    few = np.zeros(len(x), bool)
    few[[5, 77]] = True
    ids, _, _ = small_world.search(g, probes[:9], 10, allowed=few)
    assert all(sorted(r[r >= 0]) == [5, 77] for r in ids)


def test_shards_copies_and_filters(spark):
    x = np.concatenate([clusters(1500, 12), np.tile(np.ones((1, 16), np.float32), (1200, 1))])  # nearly half are alike
    rows = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)] + [(9999, None)], "id long, embedding array<float>")
    index = neighbours.create(rows, f"file:///tmp/spark-neighbours-{uuid.uuid4().hex}", shard_nodes=400)
    assert index.nodes == 1501 and index.shards == 4 and index.members.count() == len(x)
    probes = rows.filter("id % 60 = 0 and embedding is not null").selectExpr("id as probe_id", "embedding as vector")
    got = {}
    for r in neighbours.nearest(index, probes, 10).collect():
        got.setdefault(r.probe_id, []).append((r["rank"], r.id))
    asked = sorted(got)
    ids = np.array([[i for _, i in sorted(got[p])] for p in asked])
    assert len(asked) == 45 and ids.shape == (45, 10) and recall(x, x[asked], ids) >= 0.95
    assert [i for _, i in sorted(got[1560])] == list(range(1500, 1510))  # of equal rows the smaller ids
    allowed = rows.filter("id % 10 = 3").select("id")
    mask = np.arange(len(x)) % 10 == 3
    pages = {}
    for r in neighbours.nearest(index, probes, 10, allowed).collect():
        assert r.id % 10 == 3 and r.compared > 0
        pages.setdefault(r.probe_id, []).append((r["rank"], r.id))
    ids = np.array([[i for _, i in sorted(pages[p])] for p in asked])
    assert ids.shape == (45, 10) and recall(x, x[asked], ids, mask) >= 0.9


def test_nothing_indexed(spark):
    rows = spark.createDataFrame([("a", None)], "id string, embedding array<float>")
    index = neighbours.build(rows)
    assert neighbours.nearest(index, spark.createDataFrame([(1, [1.0])], "probe_id long, vector array<float>"), 3).count() == 0


def test_only_shards_that_can_hold_nearer_ones_are_walked(spark):
    x = clusters(2400, 24)
    rows = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "id long, embedding array<float>")
    index = neighbours.create(rows, f"file:///tmp/spark-neighbours-{uuid.uuid4().hex}", shard_nodes=200)
    assert index.shards == 12 and index.graphs.count() == 12
    probes = rows.filter("id % 40 = 0").selectExpr("id as probe_id", "embedding as vector")
    found = neighbours.nearest(index, probes, 10).collect()
    ids = np.array([[r.id for r in sorted(found, key=lambda r: r["rank"]) if r.probe_id == p] for p in range(0, 2400, 40)])
    assert ids.shape == (60, 10) and recall(x, x[::40], ids) >= 0.95
    assert np.mean([r.compared for r in found]) < 0.35 * len(x)  # a walk compares most of a shard of 200, and there are 12
