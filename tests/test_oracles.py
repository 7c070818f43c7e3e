"""Every query with oracle SQL against DuckDB on the small tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pytest

from repopulse import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c


def show(v):
    """A value as text that is equal for equal numbers of any type."""
    if v is None or v != v:
        return "~"
    if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_)):
        return f"{float(v):.9g}"
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(tuple(map(show, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_oracle(spark, tables, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    want = tables.execute(plans.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_oracle_run(spark):
    for name in sorted(set(plans.QUERIES) - set(plans.ORACLE)):
        assert plans.QUERIES[name](spark, SF).count() >= 0


def test_a_pause_of_several_hours_that_is_still_open(spark, tmp_path):
    # 20 events an hour fill the queue: a closed pause, then one that lasts to the end of the log
    hours = [(h, 20 if h in (2, 3, 6, 7, 8) else 1) for h in range(9)]
    start = 473_353 * 3600  # none of these hours is a multiple of 11, which lacks a queue depth
    events = [(h * 100 + i, start + h * 3600 + i, 1, "view", 1.0, "{}") for h, n in hours for i in range(n)]
    spark.createDataFrame(events, "event_id long, s long, user_id long, event_type string, value double, props string").selectExpr("event_id", "CAST(timestamp_seconds(s) AS timestamp_ntz) AS ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = rows(plans.QUERIES["w7_pauses"](spark, str(tmp_path)).toPandas())
    assert got == rows(c.execute(plans.ORACLE["w7_pauses"]).df())
    assert len(got) == 2


def test_memberships_are_never_the_side_that_is_sent_whole(spark):
    plan = plans.QUERIES["s15_draft_repos"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [token" in plan and "BuildRight" in plan and "BuildLeft" not in plan


def test_merged_tokens_have_a_known_size(spark):
    from repopulse.operators import audit

    rows = spark.createDataFrame([(f"o/r{i}", "ai", ["x", "y"], 0.7) for i in range(5)], "full_name string, primary_category string, topics array<string>, confidence double")
    members = audit.memberships(rows)
    tokens = audit.candidates(members)
    merged = audit.merged_tokens(members, tokens, audit.token_components(tokens, audit.overlaps(members, tokens)))
    assert sorted(map(tuple, merged.collect())) == [("x", "x", 2), ("y", "x", 2)]
    assert "Join" not in merged._jdf.queryExecution().optimizedPlan().toString()  # a scan, which the joins with memberships can weigh
