"""The inverted index, its stems and its ranking, against versions by hand."""

import math
import random
import uuid

import pytest

from factloom.functions import lexical
from factloom.functions.stemmer import stem
from factloom.operators import postings

RNG = random.Random(9)
VOCABULARY = ["port", "ports", "running", "run", "zebra", "node7", "the", "of", "naïve", "nationally", "e"]
QUERIES = ["port", "port zebra", "run -zebra", "port or zebra run", '"run port"', '"zebra of port" or node7', "naïve nationality e", "-port -zebra", "-port or zebra", "the", "", "absent", 'zebra -"run port" node7', "run.port", "or or port"]


def texts(n):
    return [(i, RNG.choice([" ", ", ", " - "]).join(RNG.choice(VOCABULARY) for _ in range(RNG.randint(0, 40)))) for i in range(n)]


def by_hand(query, docs):
    q = lexical.parse_query(query)
    out = {}
    for i, text in docs:
        at = lexical.crude_places(text or "", q.stems)

        def occurs(t):
            first = at[t.stems[0][0]]
            return any(all(p + k in at[s] for s, k in t.stems) for p in first)

        if not any(all(occurs(t) != t.negated for t in terms) for terms in q.alternatives):
            continue
        if q.by_nearness:
            left, pairs = 1.0, 0
            for k, a in enumerate(q.stems):
                for b in q.stems[k + 1 :]:
                    for x in at[a]:
                        for y in at[b]:
                            pairs += 1
                            if 0 < abs(x - y) <= 100:
                                left *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(abs(x - y) / 1.5 - 2)))
            out[i] = 1 - left if left < 1 else 1e-16 if pairs else 1e-20
        else:
            out[i] = sum(0.1 * sum(1 / j**2 for j in range(1, len(p) + 1)) / 1.64493406685 for p in at.values()) / len(q.stems)
    return out


@pytest.fixture(scope="module")
def docs():
    return [*texts(300), (900, None), (901, ""), (902, "the of"), (903, "zebra " * 3000 + "x " * 200 + "port " * 50)]


@pytest.fixture(scope="module")
def index(spark, docs):
    path = f"file:///tmp/spark-postings-{uuid.uuid4().hex}"
    size, postings.BLOCK = postings.BLOCK, 16
    frame = lambda rows: spark.createDataFrame(rows, "id long, content string")
    postings.create(frame(docs[:200]).repartition(3), path)
    out = postings.add(frame(docs[200:]), path)
    postings.BLOCK = size
    return out


def test_stems_of_the_published_vocabulary():
    pairs = "consigned consign consistency consist consolatory consolatori conspicuously conspicu constables constabl knackeries knackeri knightly knight kneeling kneel generously generous general general communities communiti luxuriated luxuri hopping hop hoping hope controlling control agreed agre feed feed ties tie cries cri gas gas kiwis kiwi say say by by skies sky succeeding succeed news news relational relat hopefulness hope happy happi youth youth enjoyed enjoy beds bed bled bled".split()
    assert [stem(w) for w in pairs[::2]] == pairs[1::2]


def test_queries_as_typed():
    parse = lambda q: [[(t.stems, t.negated) for t in terms] for terms in lexical.parse_query(q).alternatives]
    assert parse("fat rats or cat") == [[((("fat", 0),), False), ((("rat", 0),), False)], [((("cat", 0),), False)]]
    assert parse('-"sad the cat" x') == [[((("sad", 0), ("cat", 2)), True), ((("x", 0),), False)]]
    assert parse("the of") == [] and parse("-the cat") == [[((("cat", 0),), False)]] and parse("A.B-c") == [[((("b", 0), ("c", 1)), False)]]


@pytest.mark.parametrize("query", QUERIES)
def test_matches_and_ranks_by_hand(spark, docs, index, query, monkeypatch):
    everything = spark.createDataFrame([(i,) for i, t in docs if t is not None], "id long")
    want = by_hand(query, [(i, t) for i, t in docs if t is not None])
    got = {r.id: r.lexical for r in postings.match(index.rows, query, everything).collect()}
    assert got == pytest.approx(want, rel=1e-9, abs=1e-14)
    some = everything.filter("id % 3 <> 1")
    monkeypatch.setattr(postings, "WORTH_BOUNDS", 1)
    best = [(r.id, r.lexical) for r in postings.top(index, query, some, 12).collect()]
    assert [i for i, _ in best] == [i for i, s in sorted(((i, got[i]) for i in want if i % 3 != 1), key=lambda x: (-x[1], x[0]))][:12]


def test_bounds_hold_and_prune(spark, docs, index):
    q = lexical.parse_query("port zebra")
    bounds = {r.block: r.bound for r in postings.block_bounds(index.rows, q).collect()}
    ranks = by_hand("port zebra", docs)
    for r in index.rows.filter("stem = 'port'").select("block", "ids").collect():
        assert all(ranks.get(i, 0) <= bounds.get(r.block, 0) + 1e-12 for i in r.ids)
    assert index.blocks > 4 * postings.FIRST_BLOCKS and not bounds.keys() - {r.block for r in index.rows.select("block").collect()}


def test_a_search_reads_its_own_stems_only(spark, index):
    plan = postings.match(index.rows, "port zebra")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(stem, [port,zebra])" in plan and "Python" not in plan and "Arrow" not in plan
    heads = postings.block_bounds(index.rows, lexical.parse_query("port zebra"))._jdf.queryExecution().executedPlan().toString()
    assert "places" not in heads and "ids" not in heads


def test_no_texts(spark):
    none = spark.createDataFrame([], "id string, content string")
    assert postings.match(postings.pack(none), "port", none).count() == 0
