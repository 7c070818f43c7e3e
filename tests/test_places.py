"""Row numbers, ranges, sketches, components, caps: against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from repopulse.operators import audit, events, health
from repopulse.sources import archive, tables
from repopulse.streaming import caps, ingest

rng = random.Random(4)


def test_numbers_have_no_gaps_and_follow_the_order(spark):
    keys = [rng.choice("abcdef") + str(rng.randrange(400)) for _ in range(700)] + [None, None]
    frame = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i long").repartition(5)
    rows = tables.numbered(frame, "k", first=1).orderBy("row_no").collect()
    assert [r.row_no for r in rows] == list(range(1, len(keys) + 1))
    assert [r.k for r in rows] == sorted(keys, key=lambda k: (k is not None, k)) and sorted(r.i for r in rows) == list(range(len(keys)))
    assert tables.numbered(frame.limit(0), "k").count() == 0


@pytest.mark.parametrize("width", [1, 7, 25])
def test_ranges_hold_what_brute_force_finds(spark, width):
    ranges = [(a, a + rng.randint(-3, 40)) for a in (rng.randrange(-10, 320) for _ in range(25))]
    rows = spark.createDataFrame([(n, n) for n in range(300)], "row_no long, start_no long")
    got = health.in_ranges(rows, "row_no", spark.createDataFrame(ranges, "start_no long, end_no long"), width)
    assert got.columns == ["row_no", "start_no"]
    assert sorted(r.row_no for r in got.collect()) == [n for n in range(300) if any(a <= n < b for a, b in ranges)]


def test_batches_are_full_whatever_the_keys(spark):
    rows = spark.createDataFrame([(i * i,) for i in range(60)], "id long")
    assert [r["count"] for r in health.batches_in_order(rows, "id").groupBy("batch").count().orderBy("batch").collect()] == [25, 25, 10]


def test_sketches_unite_over_hours(spark):
    rows = [(f"r{i % 2}", "WatchEvent" if i % 3 else "ForkEvent", f"u{i % 500 if i % 2 else i % 50}", f"2024-01-01 0{i % 7}:00:00") for i in range(4000)]
    frame = spark.createDataFrame(rows, "repo_name string, type string, actor_login string, h string").withColumn("hour", F.to_timestamp("h"))
    got = {r.repo_name: (r.starrers, r.forkers) for r in events.distinct_actors(events.actor_sketches(frame)).collect()}
    for repo, (s, f) in got.items():
        exact = [len({a for n, k, a, _ in rows if n == repo and k == kind}) for kind in ("WatchEvent", "ForkEvent")]
        assert abs(s - exact[0]) <= max(1, exact[0] / 20) and abs(f - exact[1]) <= max(1, exact[1] / 20)


def test_long_chains_are_one_component(spark):
    names = [f"t{rng.random()}" for _ in range(130)]
    pairs = list(zip(names[:100], names[1:100])) + list(zip(names[100:], names[101:]))
    tokens = spark.createDataFrame([(n, 5) for n in [*names, "lone"]], "token string, size long")
    got = {r.token: r.component for r in audit.token_components(tokens, spark.createDataFrame([tuple(sorted(p)) for p in pairs], "token_a string, token_b string")).collect()}
    assert {got[n] for n in names[:100]} == {min(names[:100])} and {got[n] for n in names[100:]} == {min(names[100:])} and got["lone"] == "lone"


def test_the_last_scan_of_a_state_file(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"repos": {}, "discovery": {"last_scan": "2024-01-30T01:02:03Z"}}')
    assert str(archive.read_state(spark, str(tmp_path / "s.json"))["last_scan"].first()[0]) == "2024-01-30 01:02:03"


def test_repos_by_fixed_columns(spark, tmp_path):
    path = str(tmp_path / "repos")
    spark.createDataFrame([("a/b", 5, "new")], "full_name string, stars long, later string").write.parquet(path)
    row = tables.read_repos(spark, path).first()
    assert (row.full_name, row.stars, row.etag) == ("a/b", 5, None) and "later" not in row and len(row) == len(tables.REPO_COLUMNS.split(", "))


def test_sliding_totals_of_hours(spark):
    hours = spark.createDataFrame([("a", 0, 2), ("a", 3600 * 23, 3), ("a", 3600 * 24, 1)], "repo_name string, hour_s long, n long")
    got = {r.edge_s // 3600: r.total for r in ingest.sliding_totals(hours).collect()}
    assert got[1] == 2 and got[24] == 5 and got[25] == 4 and got[48] == 1 and max(got) == 48


def dense(rows, warn, hard):
    """Changes of each source on a grid of all its hours."""
    out = []
    for source in {r[0] for r in rows}:
        by = {}
        for s, h, n in rows:
            if s == source:
                by[h] = by.get(h, 0) + n
        was = "ok"
        for h in range(min(by), max(by) + 3600, 3600):
            rolling = sum(n for k, n in by.items() if h - 86400 <= k <= h)
            now = "hard" if rolling >= hard else "warn" if rolling >= warn else "ok"
            if now != was:
                out.append((source, h, was, now, rolling))
            was = now
    return sorted(out)


def test_caps_over_many_batches_equal_a_dense_grid(spark, tmp_path):
    rows = [(s, 3600 * (1000 + h), rng.randrange(0, 30)) for s, gap in (("a", 1), ("b", 3), ("c", 40)) for h in range(0, 200, gap) if rng.random() < 0.8]
    rows.sort(key=lambda r: r[1])
    src, folder = str(tmp_path / "in"), str(tmp_path / "out")
    provider = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for lo, hi in ((0, 1050), (1050, 1120), (1120, 9999)):
            spark.createDataFrame([r for r in rows if lo <= r[1] // 3600 < hi], "source string, hour_s long, emitted long").coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema("source string, hour_s long, emitted long").parquet(src)
            job = caps.cap_stream(stream, 200, 260).writeStream.format("parquet").option("path", folder).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            job.awaitTermination()
    finally:
        spark.conf.set(provider, was)
    ends = {s: max(r[1] for r in rows if r[0] == s) for s in "abc"}
    got = sorted(tuple(r) for r in spark.read.schema(caps.CAP_OUT).parquet(folder).collect() if r.hour_s <= ends[r.source])
    want = dense(rows, 200, 260)
    assert got == want and len(want) > 6
