import random

import numpy as np
import pyarrow as pa

from factloom.llm import langid, subword, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, rejected string, toxicity string"
RNG = random.Random(8)
SYLLABLES = {"xx": ["ba", "lo", "mi", "tur"], "yy": ["schra", "ung", "eck", "pfo"], "zz": ["éa", "ouè", "eau", "li"]}


def words(lang, n):
    return " ".join("".join(RNG.choice(SYLLABLES[lang]) for _ in range(RNG.randint(1, 4))) for _ in range(n))


def rows():
    out = [(i, words(lang, RNG.randint(1, 60)), lang) for i in range(600) for lang in [("xx", "yy", "zz")[i % 3]]]
    return out + [(9001, None, "xx"), (9002, "", None), (9003, "123 !! 45", "yy"), (None, words("yy", 9), "xx"), (9004, words("zz", 30_000), None), (9004, words("zz", 5), None)]


def frame(spark, given):
    return spark.createDataFrame([(i, t, lang, "s", None, "p", "r", "t") for i, t, lang in given], SCHEMA)


def test_language_held_out_accuracy_and_edges(spark):
    given = rows()
    got = langid.op6(frame(spark, given)).collect()
    assert len(got) == len(given)
    known = {i: lang for i, t, lang in given if i is not None and i < 9000}
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert len(held) > 100 and np.mean([r.lang_pred == known[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(by[i][0].lang_pred == "und" and by[i][0].score == 0 and by[i][0].rejected for i in (9001, 9002, 9003))
    assert by[None][0].lang_pred == "yy" and not by[None][0].held_out
    assert {r.lang_pred for r in by[9004]} == {"zz"}
    assert np.mean([r.rejected for r in held]) < 0.02


def test_language_without_labels_or_rows(spark):
    assert {r.lang_pred for r in langid.op6(frame(spark, [(1, "abc", None)])).collect()} == {"und"}
    assert langid.op6(frame(spark, [])).count() == 0


def test_held_out_rows_teach_nothing(spark):
    import zlib

    out = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    kept = [i for i in range(300) if i not in out]
    given = [(i, words("xx", 20), "xx") for i in kept] + [(i, words("yy", 20), "yy") for i in out]
    assert {r.lang_pred for r in langid.op6(frame(spark, given)).collect()} == {"xx"}


INSULTS = ["grobulous", "snarvik", "plonker"]


def toxic_rows():
    given, labels = [], []
    for i in range(900):
        text, bad = words(("xx", "yy", "zz")[i % 3], RNG.randint(3, 400)).split(), i % 6 == 0
        if bad:
            text[RNG.randrange(len(text))] = RNG.choice(INSULTS)
        given.append((i, " ".join(text), "xx"))
        labels.append((i, 1, int(bad)))
    return given, labels


def test_toxicity_held_out_and_misspellings(spark):
    given, labels = toxic_rows()
    unseen = [(5000, words("xx", 50) + " grobulus " + words("xx", 50)), (5001, words("xx", 20) + " SNARVVIK!! " + words("xx", 9)), (5002, None), (5003, ""), (None, words("zz", 20))]
    docs = frame(spark, given + [(i, t, None) for i, t in unseen])
    frame_labels = spark.createDataFrame(labels + [(0, 1, 1), (7777, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.op7(docs, frame_labels).collect()}
    held = [(r, labels[i][2]) for i, r in got.items() if r.held_out and i is not None and i < 900]
    hits = sum(r.predicted == y == 1 for r, y in held)
    assert hits >= 0.9 * sum(y for _, y in held) and sum(r.predicted for r, _ in held) <= hits + 2
    assert got[5000].predicted == got[5001].predicted == 1
    assert got[5002].predicted == got[5003].predicted == got[None].predicted == 0
    assert all(0 <= r.score <= 1 for r in got.values())


def test_equal_texts_score_alike_in_any_company():
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(size=(subword.BUCKETS, 1)).astype(np.float32), 0.3, np.array([1.0, 0.1, -0.2]), 0.2)
    texts = ["a few words of a text", "one", "two words", words("xx", 300), ""]
    alone = [model.scores(pa.array([t], pa.string()))[0] for t in texts]
    among = model.scores(pa.array([words("yy", 997), *texts, words("zz", 50), *texts[::-1]], pa.string()))
    assert among[1:6].tolist() == alone and among[7:].tolist() == alone[::-1]


def test_samples_are_bounded_and_repeats_count_once(spark, monkeypatch):
    given = [(1, "the same text", "xx")] * 500 + [(2, f"text {k} of one id", "xx") for k in range(400)] + [(k, f"text {k}", "yy") for k in range(300)] + [(9, None, "xx"), (9, "no label", None)]
    rows = frame(spark, given).select("doc_id", "text", "lang")
    got = langid.bounded(rows, "lang", 50, 6).to_pylist()
    assert sorted(r["lang"] for r in got) == ["xx"] * 50 + ["yy"] * 50 and len({(r["doc_id"], r["text"]) for r in got}) == 100
    assert got == langid.bounded(rows.repartition(5), "lang", 50, 6).to_pylist()
    assert len(langid.bounded(rows, "lang", 5000, 6)) == 701
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 400)
    assert 0 < sum(len(r["text"]) for r in langid.bounded(rows, "lang", 5000, 6).to_pylist()) <= 400


def test_language_scores_are_calibrated(spark):
    """Of held-out texts of few words the mean score is near the share named rightly."""
    rng = random.Random(4)
    mixed = lambda lang: " ".join(words(lang if rng.random() < 0.55 else rng.choice(["xx", "yy", "zz"]), 1) for _ in range(rng.randint(1, 4)))
    given = [(i, mixed(lang), lang) for i in range(2400) for lang in [("xx", "yy", "zz")[i % 3]]]
    lang = {i: x for i, _, x in given}
    held = [r for r in langid.op6(frame(spark, given)).collect() if r.held_out]
    right = np.array([r.lang_pred == lang[r.doc_id] for r in held])
    score = np.array([r.score for r in held])
    bins = np.minimum((score * 5).astype(int), 4)
    error = sum(abs(right[bins == k].mean() - score[bins == k].mean()) * (bins == k).mean() for k in range(5) if (bins == k).any())
    assert 0.5 < right.mean() < 0.98 and error < 0.08, (right.mean(), error)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.op7(frame(spark, [(1, "abc", None)]), none).collect()
    assert [(r.doc_id, r.predicted) for r in got] == [(1, 0)] and toxicity.op7(frame(spark, []), none).count() == 0


def test_words_and_features_do_not_depend_on_company():
    texts = pa.array(["Ab, c-d  ab", None, "", " x1 ", "ÄÖ"], pa.string())
    w = subword.read_words(texts, r"\p{L}")
    assert [[w.vocabulary[k] for k in w.ids[a:b]] for a, b in zip(w.starts, w.starts[1:], strict=False)] == [["ab", "cd", "ab"], [], [], ["x"], ["äö"]]
    one = {}
    for vocabulary in (["alpha", "beta"], ["beta"], ["gamma", "beta", "alpha"]):
        word, bucket = subword.features(vocabulary)
        for k, name in enumerate(vocabulary):
            assert one.setdefault(name, sorted(bucket[word == k].tolist())) == sorted(bucket[word == k].tolist())


def test_a_sample_keeps_its_labels_with_repeats_and_long_texts(spark, monkeypatch):
    given = [(i, words(("xx", "yy")[i % 2], 20), ("xx", "yy")[i % 2]) for i in range(200)]
    plain = langid.bounded(frame(spark, given), "lang", 1000, 6)
    repeated = frame(spark, given).union(frame(spark, given[:1]).crossJoin(spark.range(50_000)).drop("id"))
    assert langid.bounded(repeated, "lang", 1000, 6).equals(plain) and plain.num_rows == 200
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 100_000)
    long = [(1000 + i, words("xx", 9000), "xx") for i in range(30)]
    got = langid.bounded(frame(spark, given + long), "lang", 1000, 6)
    assert got.equals(langid.bounded(frame(spark, given), "lang", 1000, 6)) and got.num_rows == 200
    only = langid.bounded(frame(spark, given[1::2] + long), "lang", 1000, 6)
    assert only["lang"].to_pylist().count("xx") == 1 and only["lang"].to_pylist().count("yy") == 100
    assert max(map(len, only["text"].to_pylist())) <= 12_500


def test_repeats_and_one_long_text_change_no_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 400_000)
    given = [(i, words(("xx", "yy")[i % 2], 20), ("xx", "yy")[i % 2]) for i in range(300)]
    more = [(given[0][0], given[0][1], "xx")] * 3000 + [(4000 + i, words("xx", 30_000), "xx") for i in range(4)]
    known = {i: lang for i, _, lang in given}
    got = [r for r in langid.op6(frame(spark, given + more)).collect() if r.held_out and r.doc_id in known]
    assert got and all(r.lang_pred == known[r.doc_id] for r in got)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.predicted for r in toxicity.op7(frame(spark, given + more), labels).collect() if r.held_out and r.doc_id in known}
    assert scores and np.mean([p == i % 2 for i, p in scores.items()]) > 0.95
