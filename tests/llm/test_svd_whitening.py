import numpy as np
import pytest

from factloom.llm import svd_whitening as sw

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component string"
RNG = np.random.default_rng(12)


def frame(spark, given):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "n", "c") for i, v in given], SCHEMA)


def brute(given, components=16):
    """By the eigenvectors of the covariance, in extended precision."""
    rows = [(i, np.floor(64 * np.float32(v).astype(float)).astype(int) + 1_000_000) for i, v in given]
    x = np.unique([v for _, v in rows], axis=0)
    n, sums = len(x), x.sum(axis=0)
    centred = (x - 1_000_000) - (sums - n * 1_000_000) / np.longdouble(n)
    cov = (centred.T @ centred / n).astype(float)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, int((e > 1e-9 * e[0]).sum()))
    out = {}
    for i, r in rows:
        z = ((r * n - sums) / n) @ v[:, :k] / np.sqrt(e[:k])
        out.setdefault(i, []).append((sum((int(n) * int(a) - int(b)) ** 2 for a, b in zip(r, sums, strict=True)), z))
    return n, out, e[:k] / np.trace(cov)


def vectors(n, d):
    return RNG.normal(size=(n, d)) @ np.diag(np.geomspace(1, 0.05, d)) + RNG.normal(size=d)


def test_like_eigenvectors_of_the_covariance(spark):
    given = [(i, v) for i, v in enumerate(vectors(900, 24))]
    given += [(1000 + i, given[3][1]) for i in range(300)]
    bad = [(5000, None), (5001, []), (5002, [1.0] * 23 + [None]), (5003, [1.0] * 23 + [float("nan")]), (5004, [float("inf")] * 24), (5005, [1.0] * 7)]
    got = sw.whiten(frame(spark, given + bad).repartition(40)).collect()
    n, want, explained = brute(given)
    assert len(got) == len(given) * 16 and {r.n for r in got} == {n} and {r.vec_id for r in got} == {i for i, _ in given}
    table = np.zeros((1300, 16))
    for r in got:
        assert r.deviation == want[r.vec_id][0][0]
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        table[r.vec_id, r.component - 1] = r.whitened
    ids = [i for i, _ in given]
    right = np.array([want[i][0][1] for i in ids])
    sign = np.sign((table[ids] * right).sum(axis=0))
    assert np.abs(table[ids] * sign - right).max() < 1e-7


def test_merging_loses_nothing():
    x = np.floor(64 * vectors(700, 20)).astype(int) + sw.OFFSET
    cuts = [0, 1, 3, 10, 11, 300, 700]
    tree = sw.merged(sw.summary_of(x[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
    whole = np.linalg.svd((x - sw.OFFSET) - (x - sw.OFFSET).mean(axis=0))[1]
    assert tree.n == 700 and (tree.sums == x.sum(axis=0)).all()
    assert np.abs(np.linalg.norm(tree.factor, axis=1)[:20] / whole - 1).max() < 1e-12


@pytest.mark.parametrize("given,rows", [([], 0), ([(1, None)], 0), ([(1, [0.5, 2.0])], 0), ([(1, [0.5, 2.0]), (1, [0.5, 2.0])], 0), ([(1, [0.0, 2.0]), (None, [1.0, 2.0]), (None, [1.0, 2.0])], 3)])
def test_few_rows(spark, given, rows):
    got = sw.whiten(frame(spark, given)).collect()
    assert len(got) == rows and all(abs(abs(r.whitened) - 1) < 1e-12 and r.explained == pytest.approx(1) for r in got)


def test_too_large_a_deviation_is_an_error():
    s = sw.Summary(10**9, np.array([10**9 * sw.OFFSET]), np.ones((1, 1)))
    with pytest.raises(OverflowError):
        sw.deviations(np.array([[sw.OFFSET + 10**4]]), s)
