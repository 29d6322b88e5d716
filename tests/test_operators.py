"""Edge cases of the store's operators, on rows made by hand."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import predicates as p
from factloom.functions import text, vector
from factloom.operators import alias, chains, duplicates, graph, ingest, listing, mutations, policy, registry, review, search, telemetry

NOW = datetime(2025, 6, 1)
T = datetime(2025, 1, 1)
ALL = [("*", "sealed")]


def facts(spark, *rows):
    base = {"namespace": "global", "content": "a fact", "sensitivity": "open", "tags": [], "access_count": 0, "created_at": T}
    names = schemas.MEMORY.names
    return spark.createDataFrame([tuple(({**base, "content": f"fact {r['id']}"} | r).get(n) for n in names) for r in rows], schemas.MEMORY)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_half_open_changeover_and_undated_pair(spark):
    a = {"id": "a", "occurred_at": T - timedelta(9), "occurred_until": T, "superseded_by": "b", "superseded_at": T}
    m = facts(spark, a, {"id": "b", "occurred_at": T})
    assert ids(m.filter(p.held_at(T))) == ["b"]
    undated = facts(spark, {"id": "a", "superseded_by": "b", "superseded_at": T}, {"id": "b", "created_at": T})
    assert ids(undated.filter(p.held_at(T - timedelta(1)))) == []


def test_states_of_a_fact(spark):
    m = facts(spark, {"id": "lost", "superseded_at": T, "occurred_until": T}, {"id": "ended", "occurred_until": T}, {"id": "later", "occurred_until": NOW + timedelta(1)}, {"id": "odd", "sensitivity": "secret"})
    assert ids(m.filter(p.expired(NOW))) == ["ended"]
    assert ids(m.filter(p.live(NOW))) == ["later", "odd"]
    assert "odd" not in ids(m.filter(p.readable(ALL)))
    assert ids(m.filter(p.readable([]))) == []


def test_grants_are_prefixes_and_duplicate_ceilings_are_the_lower(spark):
    m = facts(spark, {"id": "1", "namespace": "project:a_b"}, {"id": "2", "namespace": "project:ab"}, {"id": "3", "namespace": "project:b", "sensitivity": "private"})
    assert ids(m.filter(p.readable([("project:a*", "open")]))) == ["1", "2"]
    assert ids(m.filter(p.within([("project:b", "open"), ("project:b", "private")]))) == []
    table = spark.createDataFrame([("project:a*", "open"), ("project:b", "private")], "pattern string, max string")
    assert ids(p.readable_table(m, table)) == ["1", "2", "3"]
    assert policy.covers([("project:*", "sealed")], "project:a*") and not policy.covers([("project:a", "sealed")], "project:*")


def test_chain_walks(spark):
    m = facts(spark, {"id": "a", "superseded_by": "b"}, {"id": "b", "superseded_by": "c", "sensitivity": "sealed", "supersedes": "a"}, {"id": "c", "supersedes": "b"}, {"id": "x", "superseded_by": "y"}, {"id": "y", "superseded_by": "x"})
    rows = chains.subject_history(m, "c", [("*", "open")]).collect()
    assert [(r.id, r.depth, r.withheld, r.depth_capped) for r in rows] == [("a", -2, 1, False), ("c", 0, 1, False)]
    assert chains.subject_history(m, "b", [("*", "open")]).count() == 0
    assert chains.chain_ids(m, "x").count() == 64
    assert chains.subject_history(m, "x", ALL).first().depth_capped
    assert {r.id: (r["head"], r.hops) for r in chains.heads(m).collect() if r.id in "abc"} == {"a": ("c", 2), "b": ("c", 1), "c": ("c", 0)}
    assert chains.head(m, "a").first().id == "c"


def test_supersede_refusals_and_ends(spark):
    m = facts(spark, {"id": "a"}, {"id": "b", "occurred_at": T}, {"id": "c", "superseded_by": "a", "superseded_at": T}, {"id": "e", "occurred_until": T}, {"id": "late", "occurred_at": NOW}, {"id": "z", "occurred_at": T - timedelta(3)})
    links = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "b"), ("e", "b"), ("nope", "b"), ("late", "z"), ("b", "c")], "old string, new string")
    after, refused = mutations.supersede(m, links, NOW)
    a = after.filter("id = 'a'").first()
    assert (a.superseded_by, a.superseded_at, a.occurred_until) == ("b", NOW, T)
    assert {(r.old, r.reason) for r in refused.collect()} == {("a", "self"), ("c", "already_superseded"), ("e", "expired"), ("nope", "missing"), ("late", "inversion")} | ({("b", "cycle")} if refused.filter("old = 'b'").count() else set())


def test_cycle_is_refused(spark):
    m = facts(spark, {"id": "a", "superseded_by": "b"}, {"id": "b"})
    _, refused = mutations.supersede(m, spark.createDataFrame([("b", "a")], "old string, new string"), NOW)
    assert refused.first().reason == "cycle"


def test_delete_splices_and_revives(spark):
    m = facts(spark, {"id": "a", "superseded_by": "b", "superseded_at": T}, {"id": "b", "superseded_by": "c", "supersedes": "a"}, {"id": "c", "supersedes": "b"}, {"id": "d", "superseded_by": "e", "superseded_at": T, "occurred_until": T}, {"id": "e", "supersedes": "d"})
    after = {r.id: r for r in mutations.delete(m, spark.createDataFrame([("b",), ("e",)], "id string")).collect()}
    assert (after["a"].superseded_by, after["c"].supersedes) == ("c", "a")
    assert (after["d"].superseded_by, after["d"].superseded_at, after["d"].occurred_until) == (None, None, None)


def test_expire_and_unexpire(spark):
    m = facts(spark, {"id": "a"}, {"id": "b", "superseded_by": "a"})
    one = spark.createDataFrame([("a",), ("b",)], "id string")
    ended = mutations.expire(m, one, NOW)
    assert {r.id: r.occurred_until for r in ended.collect()} == {"a": NOW, "b": None}
    wrong = spark.createDataFrame([("a", T)], "id string, occurred_until timestamp")
    assert mutations.unexpire(ended, wrong).filter("occurred_until is null").count() == 1
    right = spark.createDataFrame([("a", NOW)], "id string, occurred_until timestamp")
    assert mutations.unexpire(ended, right).filter("occurred_until is null").count() == 2


def test_write_batch(spark):
    m = facts(spark, {"id": "a", "content": "The  port is 8787"})
    new = [("the port is 8787", "global", None), ("Fresh", "global", None), ("fresh", "global", None), ("key AKIA" + "A" * 16, "global", None), ("x", "user:you", None), (" ", "global", None), ("soon", "global", NOW), ("since 2025-06-01 it holds", "global", NOW)]
    rows = spark.createDataFrame([(c, n, ["A", "a "], None, at, "cli") for c, n, at in new], "content string, namespace string, tags array<string>, sensitivity string, occurred_at timestamp, source_client string")
    after, out = mutations.write(m, rows, NOW)
    got = {r.content: r.outcome for r in out.collect()}
    assert got["the port is 8787"] == "confirmed" and got["soon"] == "refused_date" and got["since 2025-06-01 it holds"] == "written"
    assert got["x"] == "refused_namespace" and got[""] == "refused_empty" and got["key AKIA" + "A" * 16] == "refused_credential"
    assert sorted(r.outcome for r in out.filter("lower(content) = 'fresh'").collect()) == ["confirmed", "written"]
    assert after.count() == 3 and after.filter("id = 'a'").first().last_confirmed_at == NOW


def test_rrf_of_a_row_in_one_arm(spark):
    m = facts(spark, {"id": "a", "embedding": [1.0, 0.0]}, {"id": "b", "content": "zebra stripes"})
    hits = {r.id: r.score for r in search.search(m, [1.0, 0.0], "zebra", [("global", "open")], now=NOW, fusion="rrf").collect()}
    assert hits["a"] == pytest.approx(1 / 61) and hits["b"] == pytest.approx(0.35 / 61)


def test_lexical_queries(spark):
    m = facts(spark, {"id": "a", "content": "The zebras were running fast"}, {"id": "b", "content": "a fast horse runs"}, {"id": "c", "content": "slow"}, {"id": "s", "content": "zebra", "sensitivity": "private"})
    find = lambda q: ids(search.lexical_arm(m, q, 9))
    assert find("zebra run") == ["a"] and find("slow or fast horse") == ["b", "c"] and find("zebra or slow") == ["a", "c"] and find("fast -horse") == ["a"]
    assert find('"fast horse"') == ["b"] and find('"horse fast"') == [] and find("the") == [] and find("") == []


def test_tag_hubs(spark):
    rows = [{"id": f"{n}-{k}", "tags": [f"t{n}"]} for n in (1, 2, 40, 41) for k in range(n)]
    m = facts(spark, *rows)
    assert sorted(r.tag for r in graph.usable_tags(m).collect()) == ["t2", "t40"]
    assert graph.tag_edges(m).count() == 1 + 40 * 39 // 2


def test_walk_and_route(spark):
    e = spark.createDataFrame([("a", "b", "r"), ("b", "c", "s"), ("c", "d", "s")], "src_id string, dst_id string, relation string")
    assert {(r.id, r.hop, r.via) for r in graph.walk(e, ["a"]).collect()} == {("b", 1, "r"), ("c", 2, "s")}
    scores = lambda *s: spark.createDataFrame([(x,) for x in s], "score double")
    assert graph.route(scores(0.51, 0.5, 0.49, 0.48, 0.477)).first().route == "walk"
    assert graph.route(scores(0.679, 0.6, 0.55, 0.52, 0.504)).first().route == "search"
    assert graph.route(scores()).first().route == "search"


def test_dismissed_pairs_are_no_conflicts(spark):
    m = facts(spark, *[{"id": i, "embedding": [1.0, 0.0], "created_at": T + timedelta(hours=k)} for k, i in enumerate("cab")])
    ledger = mutations.dismiss(spark.createDataFrame([], schemas.PAIR_DISMISSED), spark.createDataFrame([("b", "a"), ("a", "b")], "a string, b string"), "me", NOW)
    assert [(r.lo_id, r.hi_id) for r in ledger.collect()] == [("a", "b")]
    assert {(r.older_id, r.newer_id) for r in duplicates.conflicts(m, ALL, NOW, 0.9, ledger).collect()} == {("c", "a"), ("c", "b")}
    assert mutations.undismiss(ledger, spark.createDataFrame([("a", "b")], "a string, b string")).count() == 0


def test_empty_store(spark):
    m = facts(spark, {"id": "a"}).limit(0)
    r = listing.staleness(m, NOW).first()
    assert (r.live, r.pct_never, r.median_age_days) == (0, 0.0, None)
    assert duplicates.exact_duplicates(m, ALL, NOW).count() == 0


def test_rate_without_denominator(spark):
    calls = spark.createDataFrame([("c", "memory_write", True, None, 3, None, None, NOW)], schemas.TOOL_CALLS)
    r = telemetry.client_rates(telemetry.client_stats(calls, NOW + timedelta(hours=1))).first()
    assert r.writes_per_read is None and r.unprompted_read_rate == 0.0


def test_alias_put(spark):
    rows = [("project:x", "warden", "quill", "manual")]
    have = spark.createDataFrame([(*r[:3], None, None, r[3], T) for r in rows], "namespace string, alias string, canonical string, since timestamp, until timestamp, origin string, created_at timestamp")
    new = spark.createDataFrame([("project:x", " Quill", "Lumen", None, None, "manual", NOW), ("project:x", "warden", "guess", None, None, "derived", NOW), ("project:x", "a", "A", None, None, "manual", NOW)], have.schema)
    after, refused = alias.put(have, new)
    assert {(r.alias, r.canonical) for r in after.collect()} == {("warden", "lumen"), ("quill", "lumen")}
    assert [r.alias for r in refused.collect()] == ["a"]
    assert [r.name for r in alias.group(after, "project:y", "Warden").collect()] == ["lumen", "quill", "warden"]


def test_registry_upsert_and_ceiling(spark):
    reg = spark.createDataFrame([("global", "host", "machines.a.os", "old", "private", 3, None), ("global", "host", "machines.b.os", "old", "open", 1, None)], "namespace string, kind string, key string, value string, sensitivity string, version long, review_after timestamp")
    past = spark.createDataFrame([("global", "host", "machines.b.os", "older", "open", 0, T)], "namespace string, kind string, key string, value string, sensitivity string, version long, replaced_at timestamp")
    new = spark.createDataFrame([("global", "host", k, "new", "private") for k in ("machines.a.os", "machines.b.os", "machines.c.os")], "namespace string, kind string, key string, value string, sensitivity string")
    after, history, refused = registry.upsert(reg, past, new, NOW, "open")
    assert {(r.key[9], r.value, r.version) for r in after.collect()} == {("a", "old", 3), ("b", "new", 2), ("c", "new", 1)}
    assert [r.key for r in refused.collect()] == ["machines.a.os"]
    assert {(r.value, r.sensitivity) for r in history.collect()} == {("old", "private"), ("older", "private")}


def test_queue_is_idempotent_and_survivor(spark):
    props = spark.createDataFrame([], schemas.CLEANUP_PROPOSAL)
    found = spark.createDataFrame([("merge", "global", ["b", "a"], 1.0, NOW), ("merge", "global", ["a", "b", "a"], 1.0, NOW)], "kind string, namespace string, ids array<string>, similarity double, created_at timestamp")
    once = duplicates.queue(props, found)
    assert once.count() == 1 and duplicates.queue(once, found).count() == 1
    g = spark.createDataFrame([("n", "a", T, NOW), ("n", "b", NOW, T), ("m", "c", None, NOW), ("m", "d", None, T)], "norm string, id string, occurred_at timestamp, created_at timestamp")
    assert {r.norm: r.keep_id for r in duplicates.survivors(g).collect()} == {"n": "b", "m": "d"}


def test_same_day_facts_make_no_pair(spark):
    m = facts(spark, *[{"id": i, "tags": ["job"], "occurred_at": at} for i, at in (("a", T), ("b", T), ("c", NOW - timedelta(9)))])
    assert [(r.older_id, r.newer_id) for r in duplicates.successive_facts(m, ALL, "job", NOW).collect()] == [("b", "c")]
    assert duplicates.same_day(m, ALL, "job", NOW).first().same_day == 1


def test_fence(spark):
    u, v = "00000000-0000-0000-0000-000000000001", "00000000-0000-0000-0000-000000000002"
    texts = ["a", f"{ingest.FENCE_BEGIN}{u}", "b", f"{ingest.FENCE_END}{v}", f"{ingest.FENCE_END}{u}", "c", f"{ingest.FENCE_RUN}{v}", "d"]
    lines = spark.createDataFrame([("f", 10 * k, t) for k, t in enumerate(texts)], "file_path string, byte_start long, text string")
    rows = ingest.fenced(lines).orderBy("byte_start").collect()
    assert [r.fenced for r in rows] == [False, True, True, True, True, False, True, True]
    assert rows[3].odd == "close_mismatch" and rows[0].open_since == 60


def test_spans_and_packing(spark):
    e = spark.createDataFrame([("s", 1, "u", "aa"), ("s", 2, "u", "bb"), ("s", 3, "m", "c" * 11), ("s", 4, "m", " "), ("s", 5, "u", "d")], "session_id string, turn long, speaker string, text string")
    assert [r.text for r in ingest.spans(e, 6).orderBy("span").collect()] == ["aa\n\nbb", "cccccc", "ccccc", "d"]
    assert [r.text for r in ingest.pack(e, "session_id", "turn", budget=5).orderBy("chunk").collect()][:2] == ["aa\nbb", "ccccc"]


def test_watermarks_hold_back(spark):
    marks = spark.createDataFrame([("f", "a", 50, "h50", None, T), ("g", "a", 90, "h90", None, T)], schemas.INGEST_WATERMARK)
    to = spark.createDataFrame([("f", 80, "h80"), ("g", 70, "h70")], "file_path string, byte_offset long, prefix_sha256 string")
    holds = spark.createDataFrame([("f", 60)], "file_path string, hold_at long")
    got = {r.file_path: (r.byte_offset, r.prefix_sha256) for r in ingest.advance_watermarks(marks, to, holds, NOW).collect()}
    assert got["g"] == (90, "h90") and got["f"][0] == 60


def test_post_outcomes(spark):
    m = facts(spark, {"id": "a", "content": "shown fact here"})
    shown = spark.createDataFrame([("shown fact here",)], "c string").select(text.content_digest("c").alias("content_sha256"), F.lit("a").alias("memory_id"), F.lit(NOW - timedelta(1)).alias("first_emitted_at"))
    rows = [("1", "shown fact here", "global"), ("2", "new fact", "global"), ("3", "New fact.", "global"), ("4", "x y z", "nowhere"), ("5", "for finance", "personal:finance"), ("6", "ghp_" + "a" * 36, "global"), ("7", "known", "global")]
    f = spark.createDataFrame([(*r, "owner_typed", "so: new fact", NOW) for r in rows], "fact_id string, content string, namespace string, speaker string, span_text string, observed_at timestamp")
    known = spark.createDataFrame([("known",)], "c string").select(text.content_digest("c").alias("fingerprint"), F.lit("global").alias("namespace"))
    out = {r.fact_id: r for r in ingest.post(f, known, shown, m, [("*", "open")], [("personal:*", "private")], NOW).collect()}
    assert {k: v.outcome for k, v in out.items()} == {"1": "echo", "2": "proposed", "3": "duplicate", "4": "refused_namespace", "5": "refused_grant", "6": "refused_credential", "7": "reinforced"}
    assert out["2"].auto and not out["1"].auto


def test_echoes_are_those_of_all_pairs(spark):
    """Boundaries of window and stretch, nulls, unreadable facts; copies are one row a stretch."""
    m = facts(spark, {"id": "a", "content": "x"}, {"id": "b", "content": "x", "sensitivity": "private"})
    tick, length = timedelta(microseconds=1), timedelta(days=90, seconds=300)
    stretch = datetime(1970, 1, 1) + length * 230
    shown_at = [stretch, stretch - tick, stretch + length, stretch + timedelta(40)]
    shown = [(d, i, t) for d, i, t in zip("pqrs", "aaaa", shown_at, strict=True)] + [("t", "b", stretch), (None, "a", stretch), ("u", "a", None)] + [("v", "a", stretch + timedelta(200 * k)) for k in range(9)]
    seen_at = [t + s for t in shown_at for s in (timedelta(90), timedelta(90) + tick, timedelta(seconds=-300), timedelta(seconds=-300) - tick, timedelta(20))] + [None, stretch + timedelta(333)]
    asked = [(n, d, t) for n, (d, t) in enumerate((d, t) for d in [*"pqrstuv", None] for t in seen_at)]
    e = spark.createDataFrame(shown * 3, "content_sha256 string, memory_id string, first_emitted_at timestamp")
    probes = spark.createDataFrame(asked, "n int, content_sha256 string, observed_at timestamp")
    want = {r.n for r in ingest.emissions_matching(e, probes, m, [("*", "open")]).select("n").collect()}
    got = ingest.echoes(e, probes, m, [("*", "open")])
    assert got.columns == ["n", "content_sha256", "observed_at", "echo"] and got.count() == len(asked)
    assert {r.n for r in got.filter("echo").collect()} == want and 20 < len(want) < len(asked) - 20


def test_post_takes_digests_once_and_reads_what_decides(spark, monkeypatch):
    from factloom.functions import credentials

    read = []
    monkeypatch.setattr(credentials, "finding", lambda c, f=credentials.finding: read.append(c) or f(c))
    m = facts(spark, {"id": "a", "content": "one"}, {"id": "b", "content": None})
    f = m.select(F.col("id").alias("fact_id"), "content", F.lit("personal:x").alias("namespace"), F.lit("owner_typed").alias("speaker"), F.col("content").alias("span_text"), F.lit(NOW).alias("observed_at"))
    shown = m.select(text.content_digest("content").alias("content_sha256"), F.col("id").alias("memory_id"), F.lit(NOW).alias("first_emitted_at"))
    known = f.select(text.content_digest("content").alias("fingerprint"), "namespace")
    out = ingest.post(f, known, shown, m, [("*", "sealed")], [("personal:*", "private")], NOW)
    assert "isnotnull(sha2" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.fact_id: r.outcome for r in out.collect()} == {"a": "echo", "b": "proposed"}
    assert f.withColumn("namespace", F.lit("global")).withColumn("_ns_ok", F.lit(True)).filter(read[0].isNotNull()).count() == 1
    assert f.withColumn("_ns_ok", F.lit(True)).filter(read[0].isNotNull()).count() == 0


def test_date_candidates(spark):
    m = facts(spark, {"id": "a", "content": "since 2024-02-03"}, {"id": "b", "content": "2024-02-03 or 4 March 2024"}, {"id": "c", "content": "from 2031-01-01"}, {"id": "d", "content": "2024-01-01", "occurred_at": T})
    assert {r.id: r.verdict for r in review.date_candidates(m, [("global", "open")], 9, NOW).collect()} == {"a": "proposed", "b": "ambiguous"}


def test_archive_merge_remaps(spark):
    m = facts(spark, {"id": "a", "content": "mine"})
    other = facts(spark, {"id": "a", "content": "theirs", "superseded_by": "b"}, {"id": "b", "content": "next", "supersedes": "a"})
    after, ids_ = mutations.merge_archive(m, other)
    to = {r.old_id: r.new_id for r in ids_.collect()}
    assert to["b"] == "b" and to["a"] != "a" and after.count() == 3
    assert after.filter("content = 'next'").first().supersedes == to["a"] and after.filter("content = 'theirs'").first().superseded_by == "b"


def test_parsers():
    from factloom.functions import credentials, guards

    assert guards.suggest_key("machine.box.os") == "machines.box.os" and guards.suggest_key("hosts.box.gpus") == "machines.box.gpu"
    assert guards.suggest_key("box os") == "machines.box.os" and guards.suggest_key("nonsense") is None
    assert guards.collapse_block("port is 8787", "port is 8080") == "digits-differ" and guards.collapse_block("x", "x") is None
    assert guards.dates_in("12 March 2024, March 12, 2024 and (2024-03-13).") == [date(2024, 3, 12), date(2024, 3, 13)]
    rule = lambda t, n=48: (f := credentials.scan(t, n)) and f.rule
    assert rule("-----BEGIN EC PRIVATE KEY-----") == "pem_private_key"
    assert rule("postgres://u:hunter2@h/db") == "connection_string_password" and rule("postgres://u:${PW}@h/db") is None and rule("redis://u:***@h") is None
    assert rule("x AKIA" + "B" * 16) == "aws_access_key_id" and rule("xAKIA" + "B" * 16) is None and rule("AKIA" + "B" * 17) is None
    assert rule("SG." + "a" * 22 + "." + "b" * 16) == "sendgrid_api_key"
    assert rule("token " + "0123456789abcdef" * 3) == "hex_credential" and rule("sha256 token " + "0123456789abcdef" * 3) is None
    assert rule("token " + "ab12" * 10) is None and rule("token " + "ab12" * 10, 40) == "hex_credential"
    assert rule("k aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1eF3") == "high_entropy_token" and rule("k " + "a" * 40) is None
    assert vector.embed_text("", 8).tolist() == [1.0] + [0.0] * 7


def test_sample_is_stable(spark):
    m = facts(spark, *[{"id": str(k)} for k in range(50)])
    one = ids(listing.sample(m, [("global", "open")], 10))
    assert len(one) == 10 and one == ids(listing.sample(m, [("global", "open")], 10))


def test_items_merge_refuse_and_claim(spark):
    from factloom.operators import decisions

    m = facts(spark, {"id": "a"}, {"id": "b", "created_at": T + timedelta(1), "sensitivity": "private"}, {"id": "c"}, {"id": "d", "namespace": "user:me"}, {"id": "e"})
    ledger = spark.createDataFrame([], "lo_id string, hi_id string, dismissed_by string, dismissed_at timestamp")
    asked = [
        ("1", "conflict", "merge", "a", "b", None, " both "),
        ("2", "conflict", "keep_both", "b", "c", None, None),
        ("3", "conflict", "merge", "c", "d", None, "x"),
        ("4", "stale", "delete", "e", None, None, None),
        ("5", "stale", "supersede", "e", None, None, None),
        ("6", "conflict", "supersede", "c", "e", "a", None),
        ("7", "conflict", "merge", "c", "e", None, " "),
        ("8", "stale", "confirm", "gone", None, None, None),
        ("9", "conflict", "keep_both", "e", "d", None, None),
    ]
    df = spark.createDataFrame(asked, "key string, source string, verdict string, a string, b string, keep string, content string")
    after, kept, outcomes = decisions.decide_items(m, ledger, df, NOW)
    assert {r.key: r.reason for r in outcomes.collect()} == {"1": None, "2": "claimed", "3": "namespaces", "4": "not_allowed", "5": "verdict", "6": "not_of_item", "7": "content", "8": "missing", "9": None}
    new = after.filter("content = 'both'").first()
    assert new.sensitivity == "private" and new.namespace == "global"
    assert ids(after.filter(F.col("superseded_by") == new.id)) == ["a", "b"]
    assert [(r.lo_id, r.hi_id) for r in kept.collect()] == [("d", "e")]


def test_findings_are_done_whole_or_not(spark):
    from factloom.operators import decisions

    m = facts(spark, {"id": "a"}, {"id": "b"}, {"id": "c", "occurred_at": T}, {"id": "d", "occurred_at": T - timedelta(1)}, {"id": "e"})
    p = spark.createDataFrame([("1", "merge", "pending", "a"), ("2", "merge", "pending", "b"), ("3", "contradiction", "pending", None), ("4", "stale", "pending", None), ("5", "merge", "rejected", "a")], "id string, kind string, state string, keep_id string").withColumn("decided_at", F.lit(None).cast("timestamp"))
    own = [("1", "a", "keep"), ("1", "b", "retire"), ("2", "b", "keep"), ("2", "a", "retire"), ("3", "c", "retire"), ("3", "d", "retire"), ("4", "e", "retire")]
    members = spark.createDataFrame([(x, i, f"fact {i}", d) for x, i, d in own], "proposal_id string, memory_id string, content string, disposition string")
    asked = spark.createDataFrame([("1", "apply", None), ("2", "apply", None), ("3", "resolve", "d"), ("4", "apply", None), ("5", "unreject", None), ("6", "apply", None)], "proposal_id string, verb string, keep_id string")
    state, after, outcomes = decisions.decide_findings(p, members, m, asked, NOW)
    assert {r.proposal_id: r.reason for r in outcomes.collect()} == {"1": None, "2": "claimed", "3": "inversion", "4": None, "5": None, "6": "missing"}
    assert {r.id: r.state for r in state.collect()} == {"1": "applied", "2": "pending", "3": "pending", "4": "applied", "5": "pending"}
    assert {r.id: r.superseded_by for r in after.collect()} == {"a": None, "b": "a", "c": None, "d": None}


def test_chain_of_an_id_with_a_quote(spark):
    rows = spark.createDataFrame([("a'b", "c"), ("c", None), ("d", None)], "id string, superseded_by string")
    assert {r.id for r in chains.chain_ids(rows, "a'b").collect()} == {"a'b", "c"}


def test_large_namespaces_are_refused_and_long_lists_flagged(spark):
    m = facts(spark, *[{"id": str(k), "embedding": [1.0, float(k)], "created_at": T - timedelta(500)} for k in range(5)])
    for scan in (lambda n: duplicates.conflicts(m, ALL, NOW, 0.9, scan_most=n), lambda n: duplicates.cleanup_pass(m, ALL, NOW, scan_most=n)):
        with pytest.raises(ValueError, match="narrow the scan"):
            scan(4)
        scan(5)
    for most, flag in ((4, True), (5, False)):
        found = duplicates.cleanup_pass(m, ALL, NOW, stale_most=most)
        assert found["stale"].count() == min(most, 5) and found["stale_truncated"].first().truncated is flag
