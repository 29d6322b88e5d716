"""Files by ranges of bytes: every line once, whatever the ranges."""

import os
import random

import pyarrow as pa
import pytest

from factloom.plans import formats
from factloom.sources import byte_lines, files

RNG = random.Random(7)


def by_hand(content, base=0, max_line=1 << 30):
    out, at = [], base
    while (end := content.find(b"\n", at)) >= 0:
        line = content[at:end].removesuffix(b"\r")
        out.append((at, end + 1, line if len(line) <= max_line else None))
        at = end + 1
    return out


@pytest.mark.parametrize("chunk", [3, 1 << 20])
def test_every_line_in_one_range(chunk, monkeypatch):
    monkeypatch.setattr(byte_lines, "CHUNK", chunk)
    for _ in range(60):
        content = b"".join(RNG.choice([b"", b"x", b"line", b"long " * 9, b"e\xcc\x81", b"\r"]) + RNG.choice([b"\n", b"\n", b"\r\n", b""]) for _ in range(RNG.randint(0, 25)))
        starts = [0, *(e for _, e, _ in by_hand(content))]
        base = RNG.choice(starts)
        for size in (1, 2, 5, 17, 1000):
            f = pa.BufferReader(content)
            got = [x for r in byte_lines.ranges("a", base, len(content), size) for x in byte_lines.lines_of(f, r.base, r.start, r.end, r.stop, 12)]
            assert got == by_hand(content, base, 12)


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


def texts(df):
    return sorted((r.file_path.rsplit("/", 1)[1], r.byte_start, r.text) for r in df.collect())


def test_growing_changing_and_hidden_files(spark, tmp_path):
    root = tmp_path / "in"
    put(root / "a.jsonl", b"one\ntwo\nhalf")
    put(root / "sub" / "b.jsonl", b"x" * 50 + b"\nok\n")
    put(root / "other.txt", b"no\n")
    put(root / "secrets" / "c.jsonl", b"no\n")
    put(tmp_path / "out" / "d.jsonl", b"no\n")
    os.symlink(tmp_path / "out" / "d.jsonl", root / "e.jsonl")
    os.symlink(tmp_path / "out", root / "linked")
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.discover(spark, str(root)).collect()) == ["a.jsonl", "b.jsonl"]
    assert files.discover(spark, str(root), most=1).count() == 1
    first = files.lines(spark, str(root), max_line=40, range_bytes=5)
    assert first.rdd.getNumPartitions() == 3 + 11
    assert texts(first) == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two"), ("b.jsonl", 0, None), ("b.jsonl", 51, "ok")]
    assert sum(r.oversized for r in first.collect()) == 1
    marks = files.reached(first).cache()
    assert {r.byte_offset for r in marks.collect()} == {8, 54}
    put(root / "a.jsonl", b"one\ntwo\nhalf done\nnext\n")
    assert texts(files.lines(spark, str(root), marks)) == [("a.jsonl", 8, "half done"), ("a.jsonl", 18, "next")]
    put(root / "a.jsonl", b"ONE\ntwo\nhalf\n")
    assert [t for _, _, t in texts(files.lines(spark, str(root), marks))] == ["ONE", "two", "half"]
    (root / "a.jsonl").unlink()
    assert texts(files.lines(spark, str(root), marks)) == []


def test_a_stream_reads_new_bytes_only(spark, tmp_path):
    root, at = tmp_path / "in", str(tmp_path / "checkpoint")

    def drain(name):
        q = files.line_stream(spark, str(root), range_bytes=7).writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(str(tmp_path / name))).option("checkpointLocation", at).trigger(once=True).start()
        q.awaitTermination(120)
        return texts(spark.read.schema(byte_lines.SCHEMA).parquet(str(tmp_path / name)))

    put(root / "a.jsonl", b"one\ntwo\nhal")
    assert drain("1") == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two")]
    put(root / "a.jsonl", b"one\ntwo\nhalf\n")
    put(root / "b.jsonl", b"b\n")
    assert drain("2") == [("a.jsonl", 8, "half"), ("b.jsonl", 0, "b")]
    put(root / "a.jsonl", b"new\n")
    assert drain("3") == [("a.jsonl", 0, "new")]


def test_a_log_of_segments_has_the_places_of_one_file(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {f.__name__: sorted(map(tuple, f(spark, sf).collect())) for f in (formats.s07_lines_with_offsets, formats.t05_only_new_bytes)}
    monkeypatch.setattr(formats, "SEGMENT", 100_000)
    path = formats._log(docs, "test-log")
    sizes = [size for _, size, _ in byte_lines.listed(path, "part-*")]
    assert len(sizes) > 2
    assert {name: sorted(map(tuple, getattr(formats, name)(spark, sf).collect())) for name in want} == want
    assert formats._placed(files.lines(spark, formats._log(docs.limit(0), "test-log"), pattern="part-*"), path).collect() == []


def test_small_ranges_share_a_task(spark, tmp_path):
    content = b"".join(b"line %d%s\n" % (i, b"." * RNG.randint(0, 60)) for i in range(2_000))
    put(tmp_path / "in" / "a.jsonl", content)
    put(tmp_path / "in" / "b.jsonl", b"one\ntwo\n")
    read = files.lines(spark, str(tmp_path / "in"), range_bytes=20)
    assert len(content) / 20 > 2_000 and read.rdd.getNumPartitions() <= 2 * byte_lines.TASKS
    want = [("a.jsonl", at, line.decode()) for at, _, line in by_hand(content)] + [("b.jsonl", 0, "one"), ("b.jsonl", 4, "two")]
    assert texts(read) == sorted(want)
    dealt = byte_lines.shares(byte_lines.ranges("x", 0, 10 << 30, 100_000))
    assert len(dealt) < 700 and sum(len(s.ranges) for s in dealt) == -(-(10 << 30) // 100_000)
