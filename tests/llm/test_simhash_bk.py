import random
import re

import numpy as np
import xxhash

from factloom.llm import components, simhash_bk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, fingerprint string"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints):
                if (a ^ b).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    ids = {g: min((prints[k][0] for k in range(len(rows)) if group[k] == g and prints[k][0] is not None), default=None) for g in group}
    return sorted(((i, f"{p:016x}", ids[g]) for (i, p), g in zip(prints, group, strict=True)), key=str)


def test_whole_query_against_brute_force(spark):
    rng = random.Random(5)
    base = " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(400))
    rows = [(i, " ".join(w if rng.random() > 0.004 else "new" for w in base.split())) for i in range(20)]
    rows += [(40, base.upper()), (30, None), (31, ""), (32, " \n\t"), (33, "One two"), (34, "one\x0btwo"), (35, "ÄB c d"), (35, "ÄB c d"), (None, "ÄB c d"), (36, "äB c d"), (37, "a\u00a0b")]
    rows += [(50 + i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(rng.randint(1, 9)))) for i in range(20)]
    docs = spark.createDataFrame([(i, t, None, None, None, "x", "y") for i, t in rows], SCHEMA)
    got = sorted(map(tuple, simhash_bk.op8(docs).collect()), key=str)
    assert got == brute_groups(rows)


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(n))
    a, b = text(60), text(60)
    near = next(x for k in range(60) if 0 < (brute_fingerprint(x := " ".join([*b.split()[:k], "new", *b.split()[k + 1 :]])) ^ brute_fingerprint(b)).bit_count() <= 2)
    rows = [(1, a), (5, a), (5, b), (5, near), (None, a), (None, text(50)), (7, a.upper()), (8, None), (9, ""), (None, " ")]
    rows += [(10, c := text(40))] * 5 + [(11, c)] * 3 + [(20 + k, text(45)) for k in range(9)] * 2
    full = [(i, t, "l" if k % 2 else None, None, k % 3, "x", "y") for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(full, SCHEMA)
    got = simhash_bk.deduplicated(docs)
    assert got.columns == docs.columns
    out = got.collect()
    # Brute force: one row of each class of linked fingerprints, with its smallest id.
    prints = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(prints):
            for j, y in enumerate(prints):
                if (x ^ y).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    ids = {}
    for k, g in enumerate(group):
        ids.setdefault(g, []).append(rows[k][0])
    want = sorted(str(min((i for i in x if i is not None), default=None)) for x in ids.values())
    assert sorted(str(r.doc_id) for r in out) == want
    assert len({group[full.index(tuple(r))] for r in out}) == len(out) == len(ids)
    assert {r.text for r in out if r.doc_id == 5} <= {b, near} and (1, a) in {(r.doc_id, r.text) for r in out}
    assert sorted(map(str, out)) == sorted(map(str, simhash_bk.deduplicated(spark.createDataFrame(full[::-1], SCHEMA).repartition(7)).collect()))
    assert simhash_bk.deduplicated(docs.limit(0)).count() == 0


def test_very_long_text_is_read_in_runs():
    text = "Some WORDS of\na text " * 120_000
    assert simhash_bk.fingerprint(text.encode()) == brute_fingerprint(text)


def test_empty_table(spark):
    assert simhash_bk.op8(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(3)
    shards = [np.unique(rng.integers(0, 1 << w, n, dtype=np.uint64)) for w, n in ((8, 200), (16, 3000), (16, 2), (63, 50), (3, 8), (1, 1))]
    for s in shards:
        rng.shuffle(s)
    starts = np.cumsum([0] + [len(s) for s in shards[:-1]])
    values = np.concatenate(shards)
    forest = simhash_bk.Forest(values, starts)
    got = {tuple(sorted(p)) for q, n in forest.pairs(2) for p in zip(q.tolist(), n.tolist(), strict=True)}
    want = set()
    for at, s in zip(starts, shards, strict=True):
        near = np.argwhere(np.bitwise_count(s[:, None] ^ s[None, :]) <= 2)
        want |= {(at + i, at + j) for i, j in near.tolist() if i < j}
    assert got == want


def test_every_pair_within_the_radius_shares_a_shard():
    rng = random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        assert any(a & m == b & m for m in simhash_bk._masks(2))


def test_components_of_chains_stars_and_repeats(spark):
    rng = random.Random(2)
    chain = list(range(100, 160))
    edges = list(zip(chain, chain[1:], strict=False)) + [(7, i) for i in range(300, 340)] + [(5, 5), (9, 8), (8, 9), (None, 1)]
    rng.shuffle(edges)
    got = {(r.node, r.root) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {(i, 100) for i in chain} | {(i, 7) for i in [7, *range(300, 340)]} | {(8, 8), (9, 8)}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
