"""The pruned similarity join against comparison of all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.operators import similarity

RNG = np.random.default_rng(11)


def table(spark, rows):
    return spark.createDataFrame(rows, "namespace string, id long, embedding array<float>, extra string")


def clusters(n, many, d, spread):
    centres = RNG.normal(size=(many, d))
    return (centres[np.arange(n) % many] + RNG.normal(scale=spread, size=(n, d))).astype(np.float32)


def brute(rows, threshold, asked=None):
    found = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        x = np.array([r[2] for r in own], float)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        s = x @ x.T
        for i, j in zip(*np.nonzero(s >= threshold - 1e-12), strict=True):
            a, b = own[i][1], own[j][1]
            if a < b and (asked is None or a in asked or b in asked):
                found[g, a, b] = s[i, j]
    return found


@pytest.fixture
def small(monkeypatch):
    for name, value in {"BLOCK": 16, "PER_PIVOT": 24, "PLACED": 100, "SAMPLE": 60}.items():
        monkeypatch.setattr(similarity, name, value)


@pytest.mark.parametrize(("d", "spread", "threshold"), [(8, 0.05, 0.97), (8, 0.4, 0.9), (3, 0.3, 0.6), (24, 3.0, 0.35), (5, 0.5, -0.2), (2, 0.5, 0.999)])
def test_all_pairs_and_no_other(spark, small, d, spread, threshold):
    x = clusters(220, 9, d, spread)
    x[40:60] = x[3]  # copies
    x[60:70] = -x[3]
    rows = [("one" if i % 4 else "two", i, [float(v) for v in x[i]], "x") for i in range(len(x))]
    df, want = table(spark, rows), brute(rows, threshold)
    got = {(r.namespace, r.a, r.b): r.similarity for r in similarity.pairs(df, threshold).collect()}
    assert got.keys() == want.keys() and want
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9
    found = similarity.links(df, threshold)
    count = {}
    for _, a, b in want:
        count[a], count[b] = count.get(a, 0) + 1, count.get(b, 0) + 1
    by_id = {r.id: r for r in similarity.classes(found).collect()}
    assert {i: r.links for i, r in by_id.items()} == {i: count.get(i, 0) for i in range(len(x))}
    assert by_id[44].class_id == min(i for i in (3, *range(40, 60)) if (i % 4 == 0) == (44 % 4 == 0))


def test_blocks_that_cannot_match_are_not_multiplied(spark, small):
    x = clusters(600, 12, 8, 0.05)
    df = table(spark, [("one", i, [float(v) for v in x[i]], "x") for i in range(len(x))])
    r = similarity.figures(similarity.links(df, 0.97)).first()
    assert (r.vectors, r.possible) == (600, 600 * 599 // 2)
    assert r.share < 0.25 and r.products < r.blocks * (r.blocks + 1) / 4
    whole = similarity.figures(similarity.links(df, -1.0)).first()
    assert whole.share == 1.0  # nothing can be left out, and no pair is met twice


def test_only_pairs_with_an_asked_side(spark, small):
    x = clusters(200, 5, 6, 0.2)
    rows = [("one", i, [float(v) for v in x[i]], "x") for i in range(len(x))]
    rows += [("one", 200 + i, rows[i][2], "x") for i in range(20)]  # copies, asked or not
    asked = {i for i in range(220) if i % 10 == 5}
    got = similarity.pairs(table(spark, rows), 0.9, asked=F.col("id") % 10 == 5)
    assert {(r.namespace, r.a, r.b) for r in got.collect()} == brute(rows, 0.9, asked).keys()


def test_rows_that_cannot_be_compared(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("one", 1, [1.0, 0.0], None), ("one", 2, [2.0, 0.0], None), ("one", 3, None, None), ("one", 4, [], None), ("one", 5, [0.0, 0.0], None), ("one", 6, [nan, 1.0], None)]
    rows += [("one", 7, [inf, 1.0], None), ("one", 8, [1.0, None], None), ("one", 9, [1.0, 0.0, 0.0], None), (None, 10, [1.0, 0.0], None), (None, 11, [1.0, 0.0], None), ("one", None, [1.0, 0.0], None)]
    rows += [("one", 12, [1e-30, 0.0], None), ("one", 13, [3e38, 1e30], None), ("two", 14, [1.0, 0.0], None), ("one", 15, [1.0, 0.0, 0.0], None)]
    df = table(spark, rows)
    got = {(r.a, r.b) for r in similarity.pairs(df, 0.9).collect()}
    assert got == {(1, 2), (1, 12), (1, 13), (2, 12), (2, 13), (12, 13), (9, 15)}
    renamed = df.selectExpr("namespace as g", "id as key", "embedding as e", "extra as width")
    assert similarity.pairs(renamed, 0.9, "g", "key", "e").count() == len(got)
    assert similarity.pairs(df.limit(0), 0.9).collect() == [] and similarity.figures(similarity.links(df.limit(0), 0.9)).collect() == []
    assert {(r.id, r.class_id, r.links) for r in similarity.classes(similarity.links(df, 0.9)).collect()} >= {(14, 14, 0), (9, 9, 1), (15, 9, 1)}


def test_few_blocks_where_nothing_is_pruned(spark, small, monkeypatch):
    monkeypatch.setattr(similarity, "SHARE", 4)
    monkeypatch.setattr(similarity, "PRODUCTS", 64)
    monkeypatch.setattr(similarity, "ROWS", 2)
    x = RNG.normal(size=(160, 16)).astype(np.float32)
    x[:9] = x[9]
    rows = [("one", i, [float(v) for v in x[i]], f"e{i}") for i in range(len(x))]
    df, want = table(spark, rows), brute(rows, 0.35)
    r = similarity.figures(similarity.links(df, 0.35)).first()
    assert r.blocks <= 6 and r.share > 0.9
    ledger = spark.createDataFrame([k[1:] for k in want][::3] + [(150, 3), (2, 900)], "lo long, hi long")
    got = similarity.pairs(df, 0.35, carry=["extra"], without=ledger)
    assert {(p.a, p.b, p.a_extra, p.b_extra) for p in got.collect()} == {(a, b, f"e{a}", f"e{b}") for n, (_, a, b) in enumerate(want) if n % 3}


@pytest.mark.parametrize(("d", "threshold"), [(64, 0.4), (3, 0.999), (16, -0.3), (8, 2.0)])
def test_single_precision_leaves_out_no_pair(monkeypatch, d, threshold):
    monkeypatch.setattr(similarity, "TILE", 700)
    x, y = (similarity._matrix(pa.chunked_array([pa.array(RNG.normal(size=(n, d)).tolist())]), d) for n in (150, 90))
    y[:20] = x[:20]
    s = np.einsum("pd,qd->pq", x, y)
    if abs(threshold) < 1:
        threshold = np.sort(s.ravel())[np.searchsorted(np.sort(s.ravel()), threshold)] - 1e-12  # a pair lies just above
    p, q, sims = similarity._near(x, y, threshold)
    assert set(zip(p, q, strict=True)) == set(zip(*np.nonzero(s >= threshold), strict=True))
    assert np.allclose(sims, s[p, q], atol=1e-13, rtol=0)


def test_products_fit_the_cache(monkeypatch):
    sizes = []

    class Watched(np.ndarray):
        def __matmul__(self, other):
            out = np.asarray(self) @ np.asarray(other)
            sizes.append((out.size, out.dtype))
            return out

    x = similarity._matrix(pa.chunked_array([pa.array(RNG.normal(size=(600, 32)).tolist())]), 32).view(Watched)
    similarity._near(x, x, 0.9)
    assert sizes and all(n <= similarity.TILE and kind == np.float32 for n, kind in sizes)


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_vectors_as_bytes_are_the_same_vectors(kind):
    column = pa.chunked_array([pa.array(RNG.normal(size=(n, 5)).astype(kind).tolist(), pa.list_(pa.from_numpy_dtype(kind))) for n in (3, 4)])
    packed = similarity._packed(column, 5, kind)
    assert len(packed) == 7 and {len(b) for b in packed.to_pylist()} == {5 * np.dtype(kind).itemsize}
    assert (similarity._unpacked(packed, 5, kind) == similarity._matrix(column, 5)).all()
    assert (similarity._unpacked(packed.slice(2, 3), 5, kind) == similarity._matrix(column, 5)[2:5]).all()
