import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import brown_lm as lm

RNG = random.Random(13)
SCHEMA = "doc_id long, text string, n_tokens string, row int, key string, score string"
NOUNS, VERBS = [f"noun{i}" for i in range(40)], [f"verb{i}" for i in range(40)]


def frame(spark, given):
    return spark.createDataFrame([(i, t, "n", 1, "k", "s") for i, t in given], SCHEMA)


def sentences(n):
    """Nouns and verbs by turns, and now and then a word never seen again."""
    out = []
    for _ in range(n):
        words = [RNG.choice((NOUNS, VERBS)[k % 2]) for k in range(RNG.randint(1, 60))]
        if RNG.random() < 0.3:
            words[RNG.randrange(len(words))] = "".join(RNG.choice("abcdefg") for _ in range(9))
        out.append(RNG.choice([" ", "\n", "\t "]).join(words))
    return out


def split(text):
    return [lm.key_of(w) for w in (text or "").encode().lower().split()] + [lm.END]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute_base(given):
    c = Counter(w for i, t in given if i is not None and not held(i) for w in split(t))
    total, distinct = sum(c.values()), len(c)
    return c, [(i, held(i), len(split(t)), sum(c[w] > 0 for w in split(t)), total, sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in split(t))) for i, t in given]


def brute_score(mod, c, text):
    units = dict(zip(mod.words.head, mod.words.units.tolist(), strict=True))
    last, out = 0, 0.0
    for w in split(text):
        cls = mod.classes[units.get(w, lm.UNITS + lm.tail_of(w))]
        out += mod.transition[last, cls] + mod.emission(np.array([c[w]]), np.array([cls]))[0]
        last = cls
    return out


LONG = "x" * 100_000


@pytest.mark.parametrize("head", [lm.HEAD, 30])
def test_like_brute_force(spark, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "PIECE_BYTES", 1000)
    monkeypatch.setattr(lm, "UNITS", 50)
    given = [*enumerate(sentences(400))]
    given += [(7, None), (7, ""), (7, " \x0b \n"), (None, "noun1 verb1"), (None, None), (9000, LONG + " noun1 " + LONG), (9001, LONG + "y"), (9002, "É é ÄÖ noun1 NOUN2"), (9003, "noun1 verb2 " * 5000), (3, given[3][1]), (3, given[3][1])]
    got = lm.op13(frame(spark, given)).collect()
    c, want = brute_base(given)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[2:4], round(r[5], 6))
    assert len(got) == len(given)
    for r, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert r[:5] == w[:5] and r[5] == pytest.approx(w[5], rel=1e-9)
    learnt = frame(spark, [(i, t) for i, t in given if i is not None and not held(i)])
    mod, _ = lm.fit(learnt.select("text"))
    scores = sorted((brute_score(mod, c, t) for _, t in given))
    assert sorted(r.score for r in got) == pytest.approx(scores, rel=1e-9)
    assert all(r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in got)
    out = [r for r in got if r.held_out]
    assert len(out) > 30 and sum(r.score for r in out) > sum(r.base_score for r in out) * 0.95  # log 40 of log 80 at best


def test_probabilities_sum_to_one(spark):
    given = [(i, t) for i, t in enumerate(sentences(200)) if not held(i)]
    mod, words = lm.fit(frame(spark, given).select("text"))
    n = {bytes(r.key): r.n for r in words.collect()}
    units = dict(zip(mod.words.head, mod.words.units.tolist(), strict=True))
    mass = np.zeros(lm.CLASSES)
    for w, k in n.items():
        cls = mod.classes[units.get(w, lm.UNITS + lm.tail_of(w))]
        mass[cls] += 10 ** mod.emission(np.array([k]), np.array([cls]))[0]
    mass[1:] += 10 ** mod.emission(np.zeros(lm.CLASSES - 1), np.arange(1, lm.CLASSES))
    assert mass == pytest.approx(np.ones(lm.CLASSES))
    assert (10**mod.transition).sum(axis=1) == pytest.approx(np.ones(lm.CLASSES))


def test_exchange_parts_nouns_from_verbs(spark):
    given = frame(spark, [*enumerate(sentences(300))]).select("text")
    words = lm.word_counts(given)
    v = lm.vocabulary(words)
    classes, _ = lm.cluster(lm.unit_bigrams(given, v), v, 3)
    of = {w.decode(): classes[u] for w, u in zip(v.head, v.units, strict=True) if u < lm.UNITS}
    assert len({of[w] for w in NOUNS}) == len({of[w] for w in VERBS}) == 1 and of["noun1"] != of["verb1"] and of[""] == 0


def test_sweeps_raise_the_likelihood(spark):
    given = frame(spark, [*enumerate(sentences(200))]).select("text")
    v = lm.vocabulary(lm.word_counts(given))
    bigrams = lm.unit_bigrams(given, v)
    order = np.unique(v.units)[1:]
    classes = np.zeros(lm.UNITS + lm.TAILS, np.int64)
    classes[order] = 1 + np.arange(len(order)) % 9
    before = lm.around(bigrams, classes, 10)
    one = lm.exchange(before, classes, order[:1])
    after = lm.around(bigrams, one, 10)
    assert lm.likelihood(after.matrix(one)) >= lm.likelihood(before.matrix(classes))


def test_tokens_in_pieces(monkeypatch):
    monkeypatch.setattr(lm, "PIECE_BYTES", 7)
    texts = ["ab cd\x0cEF  ghijklmnopq r", None, "", "É " * 20]
    runs = list(lm.tokens(pa.array(texts)))
    assert [w for words, _ in runs for w in words] == [w for t in texts for w in split(t)]
    assert [d for _, of in runs for d in of] == [i for i, t in enumerate(texts) for _ in split(t)]


def test_nothing_to_learn_from(spark):
    assert lm.op13(frame(spark, [])).count() == 0
    once = lm.op13(frame(spark, [(0, "a b c"), (1, "d e"), (None, "a z")])).collect()
    assert all(-30 < r.score < 0 for r in once)
    got = lm.op13(frame(spark, [(None, "a b"), (None, None)])).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in got] == [(0, 0, 0.0)] * 2 and all(r.score < 0 and not r.held_out for r in got)
