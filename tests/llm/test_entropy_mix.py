import math
import random

import numpy as np

from factloom.llm import entropy_mix as em

SCHEMA = "doc_id long, text string, source string, lang string, size string, target string, rate string, cell long, key string"


def brute_targets(sizes):
    """Share out in small steps: each source that has room gets by its weight."""
    weight = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    want, left = [0.0] * len(sizes), 1.5 * sum(sizes)
    while left > 1e-9:
        room = [k for k in range(len(sizes)) if want[k] < 2 * sizes[k] - 1e-9]
        total = sum(weight[k] for k in room)
        step = min([left / total] + [(2 * sizes[k] - want[k]) / weight[k] for k in room])
        for k in room:
            want[k] += step * weight[k]
        left -= step * total
    return want


def test_targets(spark):
    rng = random.Random(1)
    for n in (1, 2, 7, 40):
        sizes = [rng.choice([0, 1, 10, 1000, rng.randint(1, 10**6)]) for _ in range(n)]
        rows = [(f"+{k:03}", size) for k, size in enumerate(sizes)]
        rng.shuffle(rows)
        got = em.targets(spark.createDataFrame(rows, "key string, size long")).orderBy("key").collect()
        assert [r.place for r in got] == list(range(n)) and np.allclose([r.goal for r in got], brute_targets(sizes), rtol=1e-6)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "l", "z", "t", "r", 1, "k") for i, t, s in rows], SCHEMA)


def test_mix_against_brute_force(spark):
    rng = random.Random(6)
    names = ["b", "a", "Z", None, "é", "", "-"]
    rows = [(i, "w\x0b" * min(int(rng.paretovariate(0.8)), 3000), rng.choice(names + ["a"] * 6)) for i in range(4000)]
    rows += [(5000, None, "a"), (5001, "", "b"), (5002, "  x", "Z"), (None, "one two", "a"), (5003, "q " * 5, "only"), (5003, "q " * 5, "only")]
    frame = docs(spark, rows)
    got = em.op9(frame).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "size", "source_size", "target", "taken"}
    size = lambda t: len([w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w])
    by = {}
    for i, t, s in rows:
        by.setdefault(s, []).append(size(t))
    order = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = dict(zip(order, brute_targets([sum(by[s]) for s in order]), strict=True))
    source = {i: s for i, _, s in rows}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sum(by[s]) and math.isclose(r.target, want[s], rel_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] = taken.get(s, 0) + r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= max(5, 0.01 * want[s]), s
    assert sorted(map(str, got)) == sorted(map(str, em.op9(frame.repartition(7)).collect()))


def test_rates_solve_the_dual(spark):
    """KKT conditions: tokens meet the targets, and below the limit the rate's
    logarithm over the base is one multiple of the size in each source."""
    rng = random.Random(3)
    rows = [(i, "w " * min(int(rng.paretovariate(0.7)) + 1, 5000), rng.choice("aaabcdefgh")) for i in range(3000)]
    got = em.mix(docs(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.source_size, []).append(r)
    many = 0
    for group in by.values():
        assert abs(sum(r.rate * r.size for r in group) - group[0].target) <= 1e-8 * group[0].target
        free = [(math.log(r.rate / em.SHARE) / r.size, r) for r in group if r.rate < em.LIMIT - 1e-9 and r.rate > 1e-200]
        assert all(math.isclose(m, free[0][0], rel_tol=1e-6) for m, _ in free)
        assert not free or all(em.SHARE * math.exp(min(700, free[0][0] * r.size)) >= em.LIMIT - 1e-6 for r in group if r.rate >= em.LIMIT - 1e-9)
        many += len({r.rate for r in group}) > 1
    assert many >= 3


def test_equal_rows_fill_the_cells_and_reruns_agree(spark):
    rows = [(7, "one two three", "a")] * 60_000 + [(None, "one", "b")] * 3000 + [(i, "x y", "c") for i in range(500)] * 4
    frame = docs(spark, rows)
    dealt = em.dealt(em.narrow(frame)).groupBy("key", "cell").count().collect()
    assert len([r for r in dealt if r.key == "+a"]) == 30 and max(r["count"] for r in dealt) < 3 * em.CELL and sum(r["count"] for r in dealt) == len(rows)
    count = lambda f: sorted(map(str, em.mix(f).groupBy("doc_id", "size", "copies").count().collect()))
    assert count(frame) == count(frame.repartition(9)) == count(docs(spark, rows[::-1]))


def test_ids_stay_exact_beside_nulls(spark):
    big = (1 << 62) + 1
    got = em.op9(docs(spark, [(big, "a b", "s"), (None, "c", "s"), (big + 1, "d", "s")])).collect()
    assert {r.doc_id for r in got} == {big, big + 1, None}


def test_rows_that_the_mix_takes(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice("abc")) for i in range(300)] + [(1, "other text", "a"), (5, None, "a"), (None, "no id", "b")] + [(400, "same row", "c")] * 9
    frame = docs(spark, rows)
    got, names = em.taken(frame)
    assert got.columns == [*frame.columns, *names] and names == ["size_", "target_", "copies", "taken"]
    plain, names = em.taken(frame.select("doc_id", "text", "source"))
    assert plain.columns == ["doc_id", "text", "source", "size", "target", "copies", "taken"] and plain.count() == got.count()
    out = sorted((str(r.doc_id), r.text, r.copies) for r in got.collect())
    mixed = em.rounded(em.dealt(em.narrow(frame))).filter("copies > 0").collect()
    text = lambda t: len(t.split())
    assert sorted((i, text(t), n) for i, t, n in out) == sorted((str(r.doc_id), r["size"], r.copies) for r in mixed)
    assert out == sorted((str(r.doc_id), r.text, r.copies) for r in em.taken(docs(spark, rows[::-1]))[0].collect())


def test_empty_and_wordless(spark):
    assert em.op9(docs(spark, [])).count() == 0
    assert [tuple(r) for r in em.op9(docs(spark, [(1, None, None)])).collect()] == [(1, 0, 0, 0.0, 0)]
