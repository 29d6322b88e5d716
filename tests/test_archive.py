"""Archives: members in order, the same bytes on every run, nothing of what fails."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from factloom.plans import fixtures as fx
from factloom.plans import formats
from factloom.sources import archive, gzip_members

SCHEMAS = {"memory": "id long, content string", "registry": "key string, value string"}


def tables(spark, parts=3):
    facts = spark.range(1000).select("id", F.concat(F.lit("fact é "), "id").alias("content")).repartition(parts)
    return {"memory": facts, "registry": spark.createDataFrame([("b", "2"), ("a", "1"), ("a", "1")], "key string, value string")}


def test_members_are_one_file_and_the_same_again(spark, tmp_path):
    once = []
    for k, parts in enumerate((3, 7)):
        archive.write(tables(spark, parts), f"{tmp_path}/a{k}", "2025-01-01", member_rows=128)
        gzip_members.joined(f"{tmp_path}/a{k}", f"{tmp_path}/a{k}.gz")
        once.append((tmp_path / f"a{k}.gz").read_bytes())
        assert sorted(p.name for p in (tmp_path / f"a{k}").iterdir() if not p.name.startswith(".")) == ["_manifest.json", *(f"member-{n:08d}.jsonl.gz" for n in range(8))]
    assert once[0] == once[1]
    lines = [json.loads(x) for x in gzip.decompress(once[0]).decode().splitlines()]
    assert lines[0]["counts"]["memory"] == 1000 and lines[0]["counts"]["registry"] == 3 and [x["section"] for x in lines[1:]] == ["memory"] * 1000 + ["registry"] * 3
    assert [x["id"] for x in lines[1:1001]] == sorted(range(1000), key=str)
    back = archive.read(spark, f"{tmp_path}/a0", SCHEMAS)
    assert back["memory"].exceptAll(tables(spark)["memory"]).count() == 0 and back["registry"].count() == 3
    assert archive.read(spark, f"{tmp_path}/a0.gz", SCHEMAS)["memory"].count() == 1000


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") % 5).alias("member"), F.col("id").alias("nth"), F.when(F.col("id") == 333, F.raise_error(F.lit("broken"))).otherwise("x").alias("value"))
    with pytest.raises(Exception, match="broken"):
        gzip_members.write(rows, f"{tmp_path}/bad")
    assert not (tmp_path / "bad").exists() or not list((tmp_path / "bad").iterdir())


def test_what_expands_too_much_is_refused(spark, tmp_path):
    bomb = gzip.compress(b"0" * (64 << 20))
    (tmp_path / "bomb.gz").write_bytes(bomb)
    made, refused = gzip_members.expanded(iter([bomb]), 1 << 40, 200)
    assert refused and made <= 200 * len(bomb) + (2 << 20)
    assert gzip_members.expanded(iter([gzip.compress(b"ab"), gzip.compress(b"c")]), 3, 200) == (3, False)
    assert gzip_members.expanded(iter([gzip.compress(b"abcd")]), 3, 200)[1]
    with pytest.raises(ValueError, match="expands"):
        archive.read(spark, f"{tmp_path}/bomb.gz", SCHEMAS)


def test_vault_files_and_manifest(spark, tmp_path):
    notes = spark.createDataFrame([("vault/memory/a/é.md", "one\n"), ("vault/memory/b/x.md", "two é\n")], "path string, contents string")
    for _ in range(2):
        manifest = {r.path: (r.bytes, r.sha256) for r in archive.write_vault(notes, str(tmp_path)).collect()}
    assert {p: n for p, (n, _) in manifest.items()} == {"vault/memory/a/é.md": 4, "vault/memory/b/x.md": 7}
    assert (tmp_path / "vault/memory/b/x.md").read_text() == "two é\n"


def test_every_fact_has_its_note(spark, tmp_path):
    docs = spark.range(0, 100).selectExpr("id as doc_id", "concat('fact ', id) as text", "'en' as lang", "'web' as source")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    facts = fx.fx_memory(spark, str(tmp_path), embedding=False)
    assert 0 < facts.filter("superseded_by is not null").count() < 100 and facts.filter(~formats.live(formats.NOW)).count() > 0
    got = {r.path: r.contents for r in formats.s14_vault_notes(spark, str(tmp_path)).collect()}
    want = {r.path: r.contents for r in archive.vault(facts).select("path", F.md5("contents").alias("contents")).collect()}
    assert len(got) == 100 and got == want
    notes = {r.path.rsplit("-", 1)[1]: r.contents for r in archive.vault(facts).collect()}
    assert "superseded_by: [[2024-01-04-fact-73-73]]\nstatus: superseded" in notes["3.md"] and "> Retired." in notes["3.md"] and "supersedes: [[2024-01-01-fact-3-3]]" in notes["73.md"]
    alone = {r.path.rsplit("-", 1)[1]: r.contents for r in archive.vault(facts.filter("superseded_by is null")).collect()}
    assert 'supersedes: "3"' in alone["73.md"]  # no note of it here
