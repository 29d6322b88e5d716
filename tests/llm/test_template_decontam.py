import random
import re

import pyarrow as pa

from factloom.llm import template_decontam as td

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash long, item_ids string"
ITEMS = "item_id long, text string"
QUESTION = "A train from Ulm to Bonn covers 480 km in 5 hours. How fast does the train from Ulm go if 3 of the stops are left out by Anna?"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, 1, "x") for i, t in rows], SCHEMA)


def found(spark, rows, items):
    return {r.doc_id: (r.item_ids, r.reparameterised) for r in td.op10(docs(spark, rows), spark.createDataFrame(items, ITEMS)).collect()}


def test_copies_and_other_parameters_and_inconsistent_slots(spark):
    noise = "some words stand here before and others after it without any meaning at all"
    other = QUESTION.replace("480", "120").replace("5 hours", "2 hours").replace("Ulm", "Paris").replace("Bonn", "Rome").replace("Anna", "Bob")
    mixed = QUESTION.replace("from Ulm to", "from Oslo to").replace("480", "7")  # Ulm is two places now
    rows = [(1, f"{noise}. {QUESTION} {noise}"), (2, f"{noise}. {other}"), (3, f"{noise}. {mixed} {noise}"), (4, noise), (5, None), (6, ""), (7, " ".join(QUESTION.split()[:9])), (1, f"{noise}. {QUESTION}"), (None, QUESTION)]
    got = found(spark, rows, [(9, QUESTION), (10, "another item that no document has in it anywhere at all"), (11, None), (12, "")])
    assert got == {1: ([9], False), 2: ([9], True), None: ([9], False)}


def test_short_items_and_repeats(spark):
    items = [(1, "the quick brown fox"), (2, "too short"), (3, "the quick brown fox")]
    got = found(spark, [(1, "see the quick brown fox run"), (2, "the quick red fox"), (3, "Too short!"), (4, "this is too short")], items)
    assert got == {1: ([1, 3], False), 3: ([2], False)}


def test_rows_go_by_their_own_text(spark):
    rows = [(1, QUESTION), (1, "a clean text under the same number"), (None, QUESTION), (None, "a clean text without a number"), (None, None), (2, None), (3, ""), (4, QUESTION), (4, QUESTION), (5, "clean")]
    frame = docs(spark, rows)
    items = spark.createDataFrame([(9, QUESTION)], ITEMS)
    got = td.decontaminated(frame, items)
    assert got.columns == frame.columns
    assert sorted(map(str, [(r.doc_id, r.text) for r in got.collect()])) == sorted(map(str, [r for r in rows if r[1] != QUESTION]))
    assert td.decontaminated(frame.limit(0), items).count() == 0 and td.decontaminated(frame, items.limit(0)).count() == len(rows)


def test_very_long_text(spark):
    filler = "some words that stand for nothing " * 150_000
    assert found(spark, [(1, filler + QUESTION + " " + filler), (2, filler)], [(9, QUESTION)]) == {1: ([9], False)}


def test_empty_tables(spark):
    assert found(spark, [(1, QUESTION)], []) == {} and found(spark, [], [(1, QUESTION)]) == {}


def test_plain_passages_against_brute_force(spark):
    """Lower-case texts have no slots: then the match is one of word windows."""
    rng = random.Random(4)
    vocabulary = ["w" + chr(97 + k % 26) + chr(97 + k // 26) for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40)))) for k in range(12)]
    rows = []
    for k in range(80):
        words = [rng.choice(vocabulary) for _ in range(60)]
        if k % 2:
            item = rng.choice(items)[1].split()
            cut = rng.randint(0, len(item) // 2) if k % 3 == 0 else 0
            words[20:20] = [w + rng.choice(["", ",", "***"]) for w in item[cut:]]
        rows.append((k, " ".join(words)))

    def grams(text, n):
        w = re.findall(r"\w+", text)
        return {tuple(w[i : i + n]): i for i in range(len(w) - n + 1)}

    want = {}
    for d, text in rows:
        words = re.findall(r"\w+", text)
        for i, item in items:
            n = min(td.WINDOW, len(item.split()))
            own = grams(item, n)
            lines = {}
            for p in range(len(words) - n + 1):
                if (q := own.get(tuple(words[p : p + n]))) is not None:
                    lines[p - q] = lines.get(p - q, 0) + 1
            if lines and (max(lines.values()) >= td.COVERAGE * len(own) or max(lines.values()) >= td.RUN):
                want.setdefault(d, []).append(i)
    assert len(want) > 20
    assert {k: v for k, (v, _) in found(spark, rows, items).items()} == want


def test_columns_say_what_the_single_token_function_says():
    raw = ["Paris", "Paris,", "(the", "word***", "5", "5kg", "$5", "1,000.", "km", "NASA", "it's", "***", "end.", "...", "été", "ÉTÉ", "Été", "x", "50%", "%", "-3", "3rd", "§", "a_b", "Hello!!", "12:30"]
    seen = td._classified(pa.array(raw, pa.large_string()))
    for k, word in enumerate(raw):
        t = td.classify(word)
        assert bool(seen["empty"][k]) == (not t.codes), word
        assert bool(seen["capital"][k]) == t.capital, word
        assert bool(seen["after"][k]) == t.after, word
        assert bool(seen["unit"][k]) == t.unit, word
        if t.codes and t.codes[0][0] == int(td.NUM):
            assert int(seen["first"][k]) == int(td.NUM) and int(seen["second"][k]) == (t.codes[1][0] if len(t.codes) > 1 else 0)


def test_an_inserted_a_dropped_word_and_an_added_unit_keep_the_item_whole(spark):
    words = "when the baker fills 12 trays with fresh rolls every morning she needs 7 more than on the day before that so how much flour must be bought for the week".split()
    middle = len(words) // 2
    inserted, dropped, unit = words[:middle] + ["really"] + words[middle:], words[:middle] + words[middle + 1 :], [w + " kg" if w == "7" else w for w in words]
    short = words[:20]
    rows = [(k, "before it. " + " ".join(x) + " and after it") for k, x in enumerate([inserted, dropped, unit, short[:10] + ["really"] + short[10:]])]
    mixed = list(inserted)
    mixed[mixed.index("7")] = "9"
    rows.append((4, " ".join(mixed)))
    got = found(spark, rows, [(9, " ".join(words)), (8, " ".join(short))])
    assert all(9 in got[k][0] for k in (0, 1, 2, 4))
    assert 8 in got[3][0] and [got[k][1] for k in (0, 1, 2, 4)] == [False, False, False, True]


def test_a_chain_leaves_out_an_alignment_with_other_values():
    mark = lambda line, pos, was, now: {"line": line, "pos": pos, "was": [was], "now": [now]}
    places = list(range(20))
    one = [mark(0, p, "a", "x") for p in range(6)]
    assert td.judge(one + [mark(1, p, "a", "x") for p in range(14, 20)], 8, places) == (12, 1.0, False)
    assert td.judge(one + [mark(1, p, "a", "y") for p in range(14, 20)], 8, places) is None
    assert td.judge(one + [mark(40, p, "a", "x") for p in range(14, 20)], 8, places) is None


def test_names_that_open_sentences(spark):
    item = "Alice buys 3 apples. Alice gives 2 to Bob. How many does Alice have?"
    only = "Alice walks 4 km to the old mill and buys 3 bags of flour. Alice carries them home and bakes 6 loaves of bread. Dana eats 2 loaves on the way."
    carol = lambda x: x.replace("Alice", "Carol").replace("Dana", "Emil")
    rows = [(1, carol(item)), (2, "before it stands a word. " + carol(only) + " Then more."), (3, "Exercise: " + carol(only)), (5, item), (6, "a line before\n" + only)]
    got = found(spark, rows, [(8, item), (9, only)])
    assert got == {1: ([8], True), 2: ([9], True), 3: ([9], True), 5: ([8], False), 6: ([9], False)}


def test_items_without_plain_words_match_by_value(spark):
    sums, table, names = "Calculate 12.5 * 8 - 3", "12 7 9 30 41 5 6 8 10 77 3 19", "anna Bert Carla Dora Emil Frida"
    items = [(1, sums), (2, table), (3, names), (4, "3 * 4 - 5")]
    rows = [(1, f"some words and then {sums} is asked"), (2, "Calculate 12.5 * 9 - 3"), (3, f"numbers: {table}, no more"), (4, table.replace("41", "40")), (5, "we saw Anna, Bert, Carla, Dora, Emil, Frida there"), (6, "we saw Anna, Bert and Dora there"), (7, "3 * 4 - 5")]
    assert found(spark, rows, items) == {1: ([1], False), 3: ([2], False), 5: ([3], False), 7: ([4], False)}


def test_a_copy_after_a_capitalised_word_is_no_other_version(spark):
    item = "Rere bakes a loaf of bread for all. Thenor likes it more than the others do. Erlyan wants another one."
    assert found(spark, [(1, "it ends.\nCallmi " + item + " and so on")], [(7, item)]) == {1: ([7], False)}
