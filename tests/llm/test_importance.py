import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from factloom.llm import importance

RNG = random.Random(11)
SCHEMA = "doc_id long, text string, weight string, bucket int, row string, rank int"


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def buckets(text):
    w = tokens(text)
    return [zlib.crc32(f.encode()) % importance.BUCKETS for f in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]


def brute(docs, target):
    s, t = (Counter(b for x in texts for b in buckets(x)) for texts in ([x for _, x in docs], target))
    size_s, size_t, n = sum(s.values()), sum(t.values()), importance.BUCKETS
    out, enough = [], []
    for i, text in docs:
        found = buckets(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * float(size_s + n) / ((s[b] + 1) * float(size_t + n)))) for b in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        row = [i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        if len(tokens(text)) >= 20:
            enough.append(row)
    enough.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, row in enumerate(enough[: 25 * len(enough) // 100]):
        row[4] = k + 1
    return sorted(map(tuple, out), key=str)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "w", 1, "r", 2) for i, t in docs], SCHEMA)


def texts(n):
    words = ["Port", "réseau", "naïve", "x9", "THE", "a", "Ünder", "日本", "it's", "e-mail", "\U0001f600"]
    return [RNG.choice([" ", ", ", "\n", "\x00"]).join(RNG.choice(words) for _ in range(RNG.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("extra", [[], [(None, None), (None, "word " * 30), (None, "word " * 30), (7, "same " * 25), (7, "same " * 25), (7, "other " * 25), (8, ""), (9, " ,. "), (10, "long " * 200_000), (11, "x" * 300_000)]])
def test_like_brute_force(spark, extra):
    docs = [*enumerate(texts(120)), *extra]
    target = [*texts(9), None, ""]
    got = importance.resample(frame(spark, docs), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, target)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(frame(spark, []), none).count() == 0
    docs = [*enumerate(texts(40))]
    assert sorted((tuple(r) for r in importance.resample(frame(spark, docs), none).collect()), key=str) == brute(docs, [])


def test_ranks_over_many_partitions(spark):
    rows = spark.range(5000).selectExpr("id % 7 as score", "id % 100 as doc_id", "id as row").repartition(13)
    order = (rows.score.desc(), rows.doc_id.asc(), rows.row.asc())
    got = importance.ranked(rows, 3000, *order).collect()
    want = sorted(got, key=lambda r: (-r.score, r.doc_id, r.row))
    assert [r["rank"] for r in want] == [*range(1, 3001), *[None] * 2000]


def test_no_python_in_the_plan(spark):
    docs = frame(spark, [*enumerate(texts(10))])
    plan = importance.weighted(docs, importance.gains(docs.select("text"), docs.select("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan and "NestedLoop" not in plan
