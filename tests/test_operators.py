"""Operators on small inputs: boundaries, ties, nulls and the documented conflicts."""

from __future__ import annotations

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from repopulse.functions import exprs as x
from repopulse.functions import taxonomy
from repopulse.operators import audit, discovery, health, repository, scoring, tiers
from repopulse.operators import scans
from repopulse.operators import events as ev
from repopulse.sources import archive, sinks, tables
from repopulse.streaming import ingest

NOW = 1_706_659_200


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def values(frame, column):
    return [r[column] for r in frame.collect()]


@pytest.mark.parametrize(("scores", "want"), [([], []), ([100.0], [50.0]), ([0.0, 100.0], [0.0, 100.0]), ([0.0, 50.0, 100.0], [0.0, 50.0, 100.0]), ([50.0] * 3, [50.0] * 3), ([-50.0, 0.0, 50.0], [0.0, 50.0, 100.0])])
def test_min_max(spark, scores, want):
    rows = spark.createDataFrame([(str(i), s) for i, s in enumerate(scores)], "full_name string, s double")
    assert [r["normalized"] for r in scoring.min_max(rows, "s").orderBy("full_name").collect()] == want


def test_percentile(spark):
    rows = spark.createDataFrame([("a", 10.0), ("b", 20.0), ("c", 30.0), ("d", 1000.0)], "full_name string, s double")
    assert [r["percentile"] for r in scoring.percentile(rows, "s").orderBy("full_name").collect()] == [0.0, 33.33, 66.67, 100.0]


def test_velocity_needs_time(spark):
    row = one(spark, a=5, b=9).select(x.rate(F.col("a"), F.col("b"), F.lit(2.0)).alias("loss"), x.rate(F.col("a"), F.col("b"), F.lit(0.0)).alias("none")).first()
    assert (row["loss"], row["none"]) == (-2.0, 0.0)


def test_release_cadence_boundaries(spark):
    now = "TIMESTAMP '2024-01-31 00:00:00'"
    dates = spark.sql(f"SELECT array({now}, {now} - INTERVAL 90 DAYS, {now} - INTERVAL 89 DAYS, {now} + INTERVAL 1 DAY) AS d, {now} AS now")
    assert dates.select(x.release_cadence(F.col("d"), F.col("now")).alias("c")).first()["c"] == 2 / 3


def test_release_history(spark):
    rows = spark.sql("SELECT TIMESTAMP '2024-01-02' AS latest_release_at, array(TIMESTAMP '2024-01-01') AS release_dates, TIMESTAMP '2024-01-01' AS release_known_at")
    assert len(scoring.release_history(rows).first()["release_dates"]) == 2
    same = rows.withColumn("release_known_at", F.col("latest_release_at"))
    assert len(scoring.release_history(same).first()["release_dates"]) == 1


@pytest.mark.parametrize(("text", "want"), [("a/b", "a/b"), ("https://github.com/a/b.git", "a/b"), ("github.com/a/b/", "a/b"), ("a", None), ("a/b/c", None), ("", None)])
def test_parse_repo_id(spark, text, want):
    assert one(spark, t=text).select(x.parse_repo_id(F.col("t")).alias("r")).first()["r"] == want


@pytest.mark.parametrize(("name", "pattern", "case", "any_case"), [
    ("a/b", "a/b", True, True), ("a/b", "a/*", True, True), ("a/b", "*/b", True, False), ("a/b", "*/*", True, False), ("a/b", "A/*", False, True), ("a/b", "A/B", False, True), ("a/b", "a", False, False),
])
def test_exclusion_dialects(spark, name, pattern, case, any_case):
    row = one(spark, n=name, p=pattern).select(x.matches_case(F.col("n"), F.col("p")).alias("a"), x.matches_any_case(F.col("n"), F.col("p")).alias("b")).first()
    assert (row["a"], row["b"]) == (case, any_case)
    names, patterns = spark.createDataFrame([(name,)], "full_name string"), spark.createDataFrame([(pattern,)], "pattern string")
    assert (discovery.excluded_names(names, patterns).count() == 1) == case
    assert (discovery.excluded_any_case(names, patterns).count() == 1) == any_case


def test_tiers(spark):
    rows = spark.createDataFrame([("a", 3.0, 0, None), ("b", 3.0, NOW - 48 * 3600, NOW - 3600), ("c", 1.0, NOW - 47 * 3600, NOW - 100), ("d", 0.5, 0, NOW - 100)], "full_name string, growth_score double, first_seen_s long, last_collected_s long")
    got = {r["full_name"]: (r["rank"], r["tier"], r["is_due"]) for r in tiers.assign(rows, NOW, hot=2, warm=3).collect()}
    assert got == {"a": (0, "hot", True), "b": (1, "hot", True), "c": (2, "new", False), "d": (3, "cold", False)}
    assert values(tiers.due(tiers.assign(rows, NOW, hot=2, warm=3)), "full_name") == ["a", "b"]


def clusters(spark, repos):
    frame = spark.createDataFrame(repos, "full_name string, primary_category string, topics array<string>, confidence double")
    return [(r["tokens"], r["repo_count"], r["qualifies"]) for r in audit.cluster_repos(frame).collect()]


def repos_with(topics, confidence=0.65):
    return [(f"o/r{i}", "ai", t, confidence) for i, t in enumerate(topics)]


def test_clusters_merge_by_overlap(spark):
    assert clusters(spark, repos_with([["x", "y"]] * 4 + [["x"], ["y"]])) == [(["x", "y"], 6, True)]


def test_clusters_stay_apart(spark):
    assert sorted(clusters(spark, repos_with([["x"]] * 4 + [["x", "y"]] + [["y"]] * 4))) == [(["x"], 5, True), (["y"], 5, True)]


def test_cluster_gates(spark):
    assert clusters(spark, repos_with([["x"]] * 5, 0.6)) == [(["x"], 5, True)]
    assert clusters(spark, repos_with([["x"]] * 5, 0.5)) == [(["x"], 5, False)]
    assert clusters(spark, repos_with([["x"]] * 4 + [[], []])) == []


def test_clusters_recompute_sets(spark):
    a, b, c = set(range(1, 11)), {*range(1, 9), 11, 12}, {1, 2, 3, 4, 5, 9, 10, 11, 12}
    topics = [[t for t, s in (("a", a), ("b", b), ("c", c)) if i in s] for i in range(1, 13)]
    assert clusters(spark, repos_with(topics)) == [(["a", "b", "c"], 12, True)]


def greedy(sets):
    """The greedy merge by its definition."""
    found, merged = [([t], sets[t]) for t in sorted(sets, key=lambda t: (-len(sets[t]), t))], True
    while merged:
        merged, i = False, 0
        while i < len(found):
            j = i + 1
            while j < len(found):
                a, b = found[i][1], found[j][1]
                if len(a & b) / len(a | b) >= audit.JACCARD:
                    found[i], merged = (sorted(found[i][0] + found[j][0]), a | b), True
                    del found[j]
                    j = i + 1
                else:
                    j += 1
            i += 1
    return sorted((t, len(s)) for t, s in found)


def near_sets(seed):
    r = random.Random(seed)
    cores = [r.sample(range(60), r.randint(8, 30)) for _ in range(4)]
    return {f"t{k:02}": {x for x in r.choice(cores) if r.random() < 0.85} | set(r.sample(range(60), r.randint(0, 6))) | {60 + k % 3} for k in range(25)}


def test_next_merges_equal_the_greedy_scan():
    grown = 0
    for seed in range(300):
        sets = near_sets(seed)
        rank = {t: (-len(s), t) for t, s in sets.items()}
        now, own, last = dict(sets), {t: [t] for t in sets}, None
        while True:
            order = sorted(now, key=rank.get)
            near = [(rank[a], rank[b], len(now[a]), len(now[b]), len(now[a] & now[b])) for k, a in enumerate(order) for b in order[k + 1 :] if len(now[a] & now[b]) >= audit.NEAR * (1 - 1e-9) * max(len(now[a]), len(now[b]))]
            merges = audit.next_merges(near, last)
            if not merges:
                break
            last, grown = merges[-1], grown + len(merges) - 1
            for (_, a), (_, b) in merges:
                now[a] |= now.pop(b)
                own[a] += own.pop(b)
        assert sorted((sorted(own[t]), len(s)) for t, s in now.items()) == greedy(near_sets(seed))
    assert grown  # some rounds have several merges


def test_clusters_of_a_large_component(spark):
    sets = {t: s for t, s in near_sets(7).items() if len(s) >= audit.MIN_SIZE}
    topics = [[t for t, s in sets.items() if i in s] for i in range(63)]
    assert sorted(x[:2] for x in clusters(spark, repos_with(topics))) == greedy(sets)
    assert not hasattr(audit, "MAX_MEMBERS")  # no component is too large


@pytest.mark.parametrize(("n", "escalated"), [(3, False), (4, True)])
def test_share_is_strict(spark, n, escalated):
    assert audit.share(spark.range(n), spark.range(100)).first()["escalated"] == escalated
    assert audit.share(spark.range(0), spark.range(0)).first()["share_pct"] == 0.0


@pytest.mark.parametrize(("queue", "pct", "daily", "want"), [(1000, 90.0, 6000, "queue_depth"), (999, 80.0, 0, "rate_limit"), (None, None, 5000, "daily_cap"), (None, None, 4999, "")])
def test_pause_reason(spark, queue, pct, daily, want):
    rows = spark.createDataFrame([(queue, pct, daily)], "q long, p double, d long")
    assert rows.select(x.pause_reason(F.col("q"), F.col("p"), F.col("d")).alias("r")).first()["r"] == want


def test_pauses_keep_their_start(spark):
    rows = spark.createDataFrame([(1, ""), (2, "a"), (3, "b"), (4, ""), (5, "a")], "hour_s long, reason string")
    assert [tuple(r) for r in health.pauses(rows).orderBy("start_s").collect()] == [(2, 4, 2, 2, 2), (5, None, 1, 1, None)]


def test_backfill_is_idempotent(spark):
    rows = spark.createDataFrame([("ai-agents", "", 0), ("kubernetes", "", 0), ("other", "", 0), ("cybersecurity", "", 1), ("service-mesh", "", 0)], "primary_category string, primary_subcategory string, excluded int")
    rows = rows.withColumns({"primary_category_legacy": F.lit(""), "needs_review": F.lit(0)})
    once = repository.backfill(rows)
    got = {r["primary_category_legacy"]: (r["primary_category"], r["primary_subcategory"], r["needs_review"]) for r in once.collect()}
    assert got == {"ai-agents": ("ai", "agents", 0), "kubernetes": ("cloud-native", "kubernetes", 0), "other": ("other", "other", 1), "cybersecurity": ("security", "cybersecurity", 0), "service-mesh": ("other", "other", 0)}
    again = repository.backfill(once.drop("classification_refusal_reason"))
    keep = ["primary_category", "primary_subcategory", "primary_category_legacy", "needs_review"]
    assert sorted(map(tuple, again.select(keep).collect())) == sorted(map(tuple, once.select(keep).collect()))


def test_orphan_guard_fails(spark):
    rows = spark.createDataFrame([("", "", 0)], "primary_category string, primary_subcategory string, excluded int")
    with pytest.raises(Exception, match="without a category pair"):
        repository.orphan_guard(rows).collect()


def test_taxonomy_is_closed():
    allowed = {(c, s) for c, subs in taxonomy.TAXONOMY.items() for s in subs}
    assert len(taxonomy.LEGACY) == 43 and len(taxonomy.TAXONOMY) == 15 and set(taxonomy.LEGACY.values()) <= allowed


@pytest.mark.parametrize(("raw", "want"), [('{"category": " Kubernetes ", "confidence": 1.7, "reasoning": "x"}', ("kubernetes", 1.0)), ("{broken", ("other", 0.0)), ('{"category": "pizza", "confidence": -1}', ("other", 0.0)), (None, ("other", 0.0))])
def test_parse_reply(spark, raw, want):
    row = spark.createDataFrame([(raw,)], "raw string").select(x.parse_reply(F.col("raw"), ["kubernetes", "other"]).alias("p")).select("p.*").first()
    assert (row["category"], row["confidence"]) == want


def test_readme_functions(spark):
    row = one(spark, e="", t="éàü").select(x.content_hash(F.col("e")).alias("h"), x.shortened(F.col("t"), 2).alias("s"), x.shortened(F.col("t"), 0).alias("all")).first()
    assert (row["h"], row["s"], row["all"]) == ("", "éà", "éàü")


def archive_file(folder, hour, lines):
    with gzip.open(folder / f"{hour}.json.gz", "wt") as f:
        f.write("\n".join(lines))


def event(repo, kind="WatchEvent"):
    return json.dumps({"type": kind, "repo": {"name": repo}})


def test_archive_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    archive_file(src, "2024-01-30-05", [event("a/b"), event("a/b", "PushEvent"), "", "{broken", event(""), event("c/d", "GollumEvent")])
    archive_file(src, "2024-01-30-06", [event("a/b"), json.dumps({"type": "WatchEvent", "repo": {"name": "big/one"}, "pad": "x" * 70_000})])
    rollup, check = str(tmp_path / "rollup"), str(tmp_path / "check")
    ingest.ingest(ingest.archive_stream(spark, str(src)), rollup, check, NOW).awaitTermination()
    got = {(r["repo_name"], r["hour_key"], r["event_count"]) for r in spark.read.option("basePath", rollup).parquet(rollup).collect()}
    assert got == {("a/b", "2024-01-30-05", 2), ("a/b", "2024-01-30-06", 1), ("big/one", "2024-01-30-06", 1)}
    parsed = archive.parse_events(archive.read_lines(spark, str(src)))
    assert parsed.filter(~F.col("ok")).count() == 2
    archive_file(src, "2024-01-30-07", [event("e/f")])
    ingest.ingest(ingest.archive_stream(spark, str(src)), rollup, check, NOW).awaitTermination()
    assert spark.read.parquet(rollup).agg(F.sum("event_count")).first()[0] == 5


def test_rollup_replay_overwrites(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", "WatchEvent", "2024-01-30 05:00:00")], "repo_name string, type string, h string").withColumn("hour", F.to_timestamp("h"))
    path = str(tmp_path / "rollup")
    for _ in range(2):
        sinks.write_rollup(ev.hour_rollup(rows), path)
    assert spark.read.parquet(path).count() == 1


def test_gate_stream(spark, tmp_path):
    src = str(tmp_path / "signals")
    spark.createDataFrame([("s", h, q, None, 0) for h, q in ((1, 0), (2, 2000), (3, 2000), (4, 0))], "source string, hour_s long, queue_depth long, rate_limit_pct double, rolling long").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    job = ingest.gate_stream(stream).writeStream.format("memory").queryName("gate_events").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    assert [tuple(r) for r in spark.table("gate_events").orderBy("hour_s").collect()] == [("s", 2, "pause", "queue_depth", 0), ("s", 4, "resume", "queue_depth", 2)]


def test_state_upsert_carries_previous(spark, tmp_path):
    src, folder = tmp_path / "snap", str(tmp_path / "state")
    schema = "full_name string, collected_at long, stars long"
    job = lambda: ingest.upsert_state(spark.readStream.schema(schema).json(str(src)), folder, str(tmp_path / "ck"), ["stars"]).awaitTermination()
    src.mkdir()
    (src / "1.json").write_text(json.dumps({"full_name": "a/b", "collected_at": 1, "stars": 10}))
    job()
    (src / "2.json").write_text("\n".join(json.dumps(r) for r in ({"full_name": "a/b", "collected_at": 2, "stars": 15}, {"full_name": "c/d", "collected_at": 2, "stars": 1})))
    job()
    stands = lambda: sorted((r["full_name"], r["stars"], r["stars_prev"]) for r in ingest.latest_state(spark, folder, ["stars"]).collect())
    assert stands() == [("a/b", 15, 10), ("c/d", 1, 0)]
    (src / "3.json").write_text("\n".join(json.dumps({"full_name": "a/b", "collected_at": at, "stars": n}) for at, n in ((1, 99), (2, 99), (5, 40), (4, 30))))
    job()
    assert stands() == [("a/b", 40, 30), ("c/d", 1, 0)]
    (src / "4.json").write_text(json.dumps({"full_name": "a/b", "collected_at": 3, "stars": 7}))
    job()
    assert stands() == [("a/b", 40, 30), ("c/d", 1, 0)]


def test_nested_activity(spark):
    full = [{"mergedAt": "2024-01-30T00:00:00Z", "updatedAt": "2024-01-30T00:00:00Z"}] * 99 + [{"mergedAt": "2023-01-01T00:00:00Z", "updatedAt": "2024-01-29T00:00:00Z"}]
    nodes = [{"nameWithOwner": "a/b", "recentMergedPRs": {"nodes": full, "pageInfo": {"hasNextPage": True}}, "recentIssues": {"nodes": [{"createdAt": "2024-01-30T00:00:00Z"}, {"createdAt": "2023-01-30T00:00:00Z"}], "pageInfo": {"hasNextPage": False}}}]
    frame = spark.read.schema(archive.NODE).json(spark.sparkContext.parallelize([json.dumps(n) for n in nodes]))
    row = archive.nested_activity(frame, F.lit("2024-01-31 00:00:00").cast("timestamp")).first()
    assert (row["merged_prs_7d"], row["new_issues_7d"], row["truncated"]) == (99, 1, True)


def test_state_file(spark, tmp_path):
    doc = {"repos": {"a/b": {"owner": "a", "name": "b", "stars": 3}}, "star_observations": {"a/b": {"stars": 2, "observed_at": "2024-01-30T00:00:00Z"}}, "discovery": {"known_repos": {"a/b": True, "c/d": False}, "topic_scans": {"ai": "bad time"}}}
    path = tmp_path / "state.json"
    path.write_text(json.dumps(doc, indent=1))
    got = archive.read_state(spark, str(path))
    assert got["repos"].first()["stars"] == 3 and values(got["known"], "full_name") == ["a/b"] and values(got["topic_scans"], "scanned_at") == [None]


def test_merge_upsert_keeps_other_columns(spark):
    target = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v long, status string")
    source = spark.createDataFrame([("b", 5), ("c", 6)], "k string, v long")
    got = tables.merge_upsert(target, source, "k", ["v"], {"status": F.lit("pending")})
    assert sorted(map(tuple, got.collect())) == [("a", 1, "x"), ("b", 5, "y"), ("c", 6, "pending")]


def test_schema_evolution_is_idempotent(spark):
    once = tables.evolve(spark.createDataFrame([(1, 2)], "a long, old long"), {"fresh": F.lit("")}, ["old"])
    assert tables.evolve(once, {"fresh": F.lit("?")}, ["old"]).first().asDict() == {"a": 1, "fresh": ""}


def test_report(spark):
    frame = spark.createDataFrame(repos_with([["x"]] * 5), "full_name string, primary_category string, topics array<string>, confidence double")
    found = audit.cluster_repos(frame)
    lines = values(audit.report(found, audit.per_category(frame, found), audit.share(frame, spark.range(100)), "2024-01-31"), "line")
    assert '"gate":"BREACH >3% [CRITICAL]"' in lines[0] and any(x.startswith('{"filed":"ai/x","repo_count":5,"tokens":["x"]') for x in lines)
    filed = []
    issues = spark.createDataFrame([("Subcat graduation proposal: ai/x, again", 10)], "title string, created_s long")
    assert values(audit.audit_other_drift(lambda: (frame, spark.range(100)), lambda d: filed.extend(d.collect()), issues.limit(0), "2024-01-31", 20), "line") == lines
    assert [r["title"] for r in filed] == ["Subcat graduation proposal: ai/x"]
    assert audit.not_filed_lately(audit.drafts(found), issues, 20).count() == 0
    assert audit.draft_repos(found, audit.memberships(frame)).count() == 5
    assert values(audit.drafts(found), "title") == ["Subcat graduation proposal: ai/x"]
    assert sinks.report_name("2024-01-31") == "2024-01.md"


def test_fallback_hours(spark):
    assert archive.fallback_hours(spark, NOW, 0.5).count() == 1 and archive.fallback_hours(spark, NOW, 3.9).count() == 3


def test_collectors_can_be_plugged(spark):
    repos = spark.createDataFrame([("a/b",), ("a/b",), ("c/d",)], "repo_name string")
    found = scans.collect(repos, 24, lambda asked, hours: asked.withColumn("stars", F.lit(hours)))
    assert sorted((r["repo_name"], r["stars"], r["partial"]) for r in found.collect()) == [("a/b", 24, True), ("c/d", 24, True)]
    rows = spark.createDataFrame([("a/b", 1, True), ("c/d", 2, True), ("e/f", 3, False)], "full_name string, stars long, partial boolean")
    before = spark.createDataFrame([("a/b", 9), ("e/f", 9), ("g/h", 9)], "full_name string, stars long")
    assert sorted((r["full_name"], r["stars"]) for r in scans.apply_partial(rows, before, ["stars"]).collect()) == [("a/b", 9), ("c/d", 2), ("e/f", 3)]


def test_written_tables_are_cleared(spark):
    from pathlib import Path

    folder = Path(tables.shared_folder(spark).removeprefix("file:"))
    assert tables.written(spark.range(3), "three").count() == 3
    assert folder.exists() and spark.sparkContext.applicationId in folder.name
    tables.clear_written(spark)
    assert not folder.exists()
