"""Queries over event archives and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as x
from ..operators import events as ev
from ..operators import health, scoring
from ..sources.views import NOW
from .registry import query


def edge():
    """Right edge of the windows."""
    return F.timestamp_seconds(F.lit(NOW))


WEEK = 168
_KEPT = "type IN ('WatchEvent', 'ForkEvent', 'PushEvent', 'PullRequestEvent') AND repo_name <> ''"
_HOURLY = f"SELECT repo_name, EPOCH(hour) AS hour_s, count(*) AS event_count FROM repo_events WHERE {_KEPT} GROUP BY 1, 2"


def hour_in_seconds(df):
    return df.withColumn("hour_s", F.unix_timestamp("hour")).drop("hour")


@query("a1_hour_counts", _HOURLY)
def _(t):
    return hour_in_seconds(ev.hour_counts(t.repo_events))


@query("a2_hour_types", f"SELECT repo_name, EPOCH(hour) AS hour_s, type, count(*) AS n FROM repo_events WHERE {_KEPT} GROUP BY 1, 2, 3")
def _(t):
    return ev.hour_rollup(t.repo_events).select("repo_name", F.unix_timestamp("hour").alias("hour_s"), F.explode("per_type").alias("type", "n"))


@query("a3_kept_discarded", f"SELECT EPOCH(hour) AS hour_s, type, count(*) FILTER (WHERE {_KEPT}) AS kept, count(*) FILTER (WHERE NOT ({_KEPT})) AS discarded FROM repo_events GROUP BY 1, 2")
def _(t):
    return hour_in_seconds(ev.kept_counts(t.repo_events))


_TOTALS = f"SELECT repo_name, CAST(sum(event_count) AS BIGINT) AS total, max(event_count) AS peak FROM ({_HOURLY}) WHERE hour_s >= {{NOW}} - {WEEK * 3600} AND hour_s < {{NOW}} GROUP BY 1"


@query("a4_window_totals", _TOTALS)
def _(t):
    return ev.window_totals(ev.hour_counts(t.repo_events), edge(), WEEK)


@query("a4_window_types", f"SELECT repo_name, type, count(*) AS n FROM repo_events WHERE {_KEPT} AND EPOCH(hour) >= {{NOW}} - {WEEK * 3600} AND EPOCH(hour) < {{NOW}} GROUP BY 1, 2")
def _(t):
    return ev.window_types(ev.hour_rollup(t.repo_events), edge(), WEEK)


@query("a4b_hour_series", f"""WITH h AS ({_HOURLY}), r AS (SELECT DISTINCT repo_name FROM h WHERE hour_s >= {{NOW}} - 86400 AND hour_s < {{NOW}}),
s AS (SELECT repo_name, unnest(generate_series(0, 23)) AS slot FROM r)
SELECT s.repo_name, string_agg(CAST(coalesce(h.event_count, 0) AS VARCHAR), ',' ORDER BY slot) AS series FROM s LEFT JOIN h ON h.repo_name = s.repo_name AND h.hour_s = {{NOW}} - 86400 + slot * 3600 GROUP BY 1""")
def _(t):
    return ev.hour_series(ev.hour_counts(t.repo_events), edge()).select("repo_name", F.array_join(F.transform("hour_counts", lambda c: c.cast("string")), ",").alias("series"))


@query("a5_dominant_type", f"""WITH n AS (SELECT repo_name, type, count(*) AS n FROM repo_events WHERE {_KEPT} GROUP BY 1, 2)
SELECT repo_name, type AS dominant_type FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY n DESC, type) AS rn FROM n) WHERE rn = 1""")
def _(t):
    counts = t.repo_events.filter(ev.kept()).groupBy("repo_name", "type").agg(F.count(F.lit(1)).alias("n"))
    return ev.dominant_type(counts)


_ASKED = "SELECT DISTINCT repo_name FROM repo_events WHERE event_id % 2 = 0 UNION SELECT 'nobody/none'"
_DAYS = "CAST(30 AS DOUBLE)"


def _asked(t):
    names = t.repo_events.filter("event_id % 2 = 0").select("repo_name").distinct()
    return names.union(t.spark.createDataFrame([("nobody/none",)], "repo_name string"))


@query("a6_repo_metrics", f"""WITH a AS ({_ASKED}), m AS (SELECT repo_name, count(*) FILTER (WHERE type = 'WatchEvent') AS stars, count(*) FILTER (WHERE type = 'ForkEvent') AS forks,
  count(DISTINCT CASE WHEN type = 'PullRequestEvent' AND action = 'closed' AND merged THEN number END) AS merged_prs,
  count(DISTINCT CASE WHEN type = 'IssuesEvent' AND action = 'opened' THEN number END) AS new_issues,
  count(DISTINCT CASE WHEN type = 'WatchEvent' THEN actor_login END) AS starrers, count(DISTINCT CASE WHEN type = 'ForkEvent' THEN actor_login END) AS forkers
  FROM repo_events GROUP BY 1),
f AS (SELECT a.repo_name, coalesce(stars, 0) AS stars, coalesce(forks, 0) AS forks, coalesce(merged_prs, 0) AS merged_prs, coalesce(new_issues, 0) AS new_issues, coalesce(starrers, 0) AS starrers, coalesce(forkers, 0) AS forkers FROM a LEFT JOIN m ON a.repo_name = m.repo_name)
SELECT *, CAST(stars AS DOUBLE) / {_DAYS} AS stars_per_day, CAST(forks AS DOUBLE) / {_DAYS} AS forks_per_day, CAST(merged_prs AS DOUBLE) / {_DAYS} AS merged_prs_per_day, CAST(new_issues AS DOUBLE) / {_DAYS} AS new_issues_per_day FROM f""")
def _(t):
    return ev.repo_metrics(t.repo_events, _asked(t), 720)


@query("a8_release_dates", "SELECT repo_name, string_agg(CAST(created_s AS VARCHAR), ',' ORDER BY created_s) AS dates FROM repo_events WHERE type = 'ReleaseEvent' AND action = 'published' GROUP BY 1")
def _(t):
    dates = F.transform("release_dates", lambda d: F.unix_timestamp(d).cast("string"))
    return ev.release_dates(t.repo_events).select("repo_name", F.array_join(dates, ",").alias("dates"))


@query("a9_requested_share", f"WITH a AS ({_ASKED}) SELECT count(*) FILTER (WHERE repo_name IN (SELECT repo_name FROM a)) AS kept, count(*) FILTER (WHERE repo_name NOT IN (SELECT repo_name FROM a)) AS discarded FROM repo_events WHERE event_id % 5 <> 9")
def _(t):
    return ev.requested_share(t.repo_events, _asked(t))


@query("a33_distinct_repos", f"SELECT count(DISTINCT repo_name) AS repos FROM repo_events WHERE {_KEPT} AND EPOCH(hour) >= {{NOW}} - 86400 AND EPOCH(hour) < {{NOW}}")
def _(t):
    return ev.in_window(ev.hour_counts(t.repo_events), edge(), 24).agg(F.count_distinct("repo_name").alias("repos"))


@query("w1_sliding_totals", f"SELECT repo_name, hour_s, event_count, CAST(sum(event_count) OVER (PARTITION BY repo_name ORDER BY hour_s RANGE BETWEEN 82800 PRECEDING AND CURRENT ROW) AS BIGINT) AS window_total FROM ({_HOURLY})")
def _(t):
    return hour_in_seconds(ev.sliding_totals(ev.hour_counts(t.repo_events)))


@query("t1_top_active", f"SELECT repo_name, total, peak FROM ({_TOTALS}) WHERE total >= 10 ORDER BY total DESC, repo_name LIMIT 50")
def top_active(t):
    return ev.top_active(ev.active(ev.window_totals(ev.hour_counts(t.repo_events), edge(), WEEK)), 50)


@query("x16_archive_hours", """SELECT DISTINCT strftime(hour, '%Y-%m-%d-%H') AS archive, EPOCH(hour) AS hour_s, {NOW} - EPOCH(hour) AS lag_s, {NOW} - EPOCH(hour) >= 5400 AS ready,
  CASE WHEN {NOW} - EPOCH(hour) >= 14400 THEN 'critical' WHEN {NOW} - EPOCH(hour) >= 3600 THEN 'warning' ELSE 'ok' END AS level FROM repo_events""")
def _(t):
    names = t.repo_events.select(x.archive_name(F.col("hour")).alias("archive")).distinct()
    hour = x.archive_hour(F.concat("archive", F.lit(".json.gz")))
    lag = x.lag_seconds(NOW, hour)
    return names.select("archive", F.unix_timestamp(hour).alias("hour_s"), lag.alias("lag_s"), x.archive_ready(NOW, hour).alias("ready"), x.lag_level(lag).alias("level"))


@query("a31_dashboard", """SELECT created_s - created_s % 300 AS slot_s, type, count(*) AS events, avg(CAST({NOW} - created_s AS DOUBLE)) AS avg_lag_s,
  avg(CAST(number AS DOUBLE)) AS avg_ratio, CASE WHEN avg(CAST({NOW} - created_s AS DOUBLE)) >= 14400 THEN 'critical' WHEN avg(CAST({NOW} - created_s AS DOUBLE)) >= 3600 THEN 'warning' ELSE 'ok' END AS level
FROM repo_events GROUP BY 1, 2""")
def _(t):
    points = t.repo_events.select("created_s", "type", (F.lit(NOW) - F.col("created_s")).cast("double").alias("lag_s"), F.col("number").cast("double").alias("ratio"))
    return health.five_minutes(points)


_LAGGED = """SELECT *, coalesce(lag(stars) OVER w, 0) AS stars_prev, coalesce(lag(forks) OVER w, 0) AS forks_prev, coalesce(lag(contributors) OVER w, 0) AS contributors_prev,
  coalesce(CAST(day - lag(day) OVER w AS DOUBLE) / 86400.0::DOUBLE, 0.0::DOUBLE) AS days FROM snapshots WINDOW w AS (PARTITION BY full_name ORDER BY day)"""


def _rate(c: str) -> str:
    return f"CASE WHEN days > 0 THEN CAST({c} - {c}_prev AS DOUBLE) / days ELSE 0.0::DOUBLE END"


_VELOCITIES = f"""WITH l AS ({_LAGGED}), v AS (SELECT *, {_rate('stars')} AS star_velocity FROM l),
p AS (SELECT *, coalesce(lag(star_velocity) OVER (PARTITION BY full_name ORDER BY day), 0.0::DOUBLE) AS star_velocity_prev FROM v),
s AS (SELECT full_name, day, star_velocity, star_velocity - star_velocity_prev AS star_acceleration, {_rate('forks')} AS fork_velocity, {_rate('contributors')} AS contributor_growth,
  CAST(merged_prs_7d AS DOUBLE) / 7.0::DOUBLE AS pr_velocity, CAST(new_issues_7d AS DOUBLE) / 7.0::DOUBLE AS issue_velocity, CAST(releases AS DOUBLE) / 3.0::DOUBLE AS release_cadence FROM p),
o AS (SELECT *, star_velocity * 2.0::DOUBLE + star_acceleration * 3.0::DOUBLE + fork_velocity * 1.5::DOUBLE + release_cadence * 1.0::DOUBLE + contributor_growth * 1.5::DOUBLE + pr_velocity * 1.0::DOUBLE + issue_velocity * 0.5::DOUBLE AS raw_score FROM s)"""


def _scored(t):
    rows = scoring.with_previous(t.snapshots).withColumn("release_cadence", x.double(F.col("releases")) / F.lit(3.0))
    return scoring.velocities(rows).select(
        "full_name", "day", "star_velocity", "star_acceleration", "fork_velocity", "contributor_growth", "pr_velocity", "issue_velocity", "release_cadence", "raw_score"
    )


@query("w4_velocities", f"{_VELOCITIES} SELECT full_name, day, star_velocity, star_acceleration, fork_velocity, contributor_growth, pr_velocity, issue_velocity, release_cadence, raw_score FROM o")
def _(t):
    return _scored(t)


_LATEST = f"{_VELOCITIES}, z AS (SELECT full_name, raw_score FROM (SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY day DESC) AS rn FROM o) WHERE rn = 1), b AS (SELECT min(raw_score) AS lo, max(raw_score) AS hi, count(*) AS n FROM z)"
_NORMAL = "CASE WHEN n = 1 OR hi - lo = 0 THEN 50.0::DOUBLE ELSE floor((raw_score - lo) / (hi - lo) * 100.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END"


@query("w8_normalized", f"{_LATEST} SELECT full_name, raw_score, {_NORMAL} AS normalized FROM z, b")
def _(t):
    return scoring.min_max(scoring.latest(_scored(t)), "raw_score").select("full_name", "raw_score", "normalized")


@query("w3_percentile", f"{_LATEST}, r AS (SELECT full_name, raw_score, row_number() OVER (ORDER BY raw_score, full_name) - 1 AS k FROM z) SELECT full_name, raw_score, CASE WHEN n = 1 THEN 50.0::DOUBLE ELSE floor(CAST(k AS DOUBLE) / CAST(n - 1 AS DOUBLE) * 100.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS percentile FROM r, b")
def _(t):
    return scoring.percentile(scoring.latest(_scored(t)).select("full_name", "raw_score"), "raw_score")


@query("t3_top_scored", f"{_LATEST} SELECT full_name, raw_score, {_NORMAL} AS normalized FROM z, b ORDER BY normalized DESC, full_name LIMIT 20")
def _(t):
    return scoring.top(scoring.min_max(scoring.latest(_scored(t)), "raw_score").select("full_name", "raw_score", "normalized"), 20)


@query("w11_release_cadence", "SELECT repo_name, CAST(count(*) FILTER (WHERE created_s <= {NOW} AND created_s > {NOW} - 90 * 86400) AS DOUBLE) / 3.0::DOUBLE AS cadence FROM repo_events WHERE type = 'ReleaseEvent' AND action = 'published' GROUP BY 1")
def _(t):
    return ev.release_cadence(t.repo_events, edge())


@query("w10_release_history", """WITH r AS (SELECT repo_name, created_at, row_number() OVER (PARTITION BY repo_name ORDER BY created_at DESC, event_id DESC) AS rn FROM repo_events WHERE type = 'ReleaseEvent' AND action = 'published')
SELECT repo_name, string_agg(CAST(EPOCH(created_at) AS VARCHAR), ',' ORDER BY rn) AS history FROM r WHERE rn <= 10 GROUP BY 1""")
def _(t):
    dates = ev.latest_releases(t.repo_events, 11).withColumn("d", F.col("release_dates"))
    rows = dates.select("repo_name", F.element_at("d", 1).alias("latest_release_at"), F.slice("d", 2, 1000000).alias("release_dates"), F.lit(None).cast("timestamp").alias("release_known_at"))
    out = scoring.release_history(rows)
    return out.select("repo_name", F.array_join(F.transform("release_dates", lambda d: F.unix_timestamp(d).cast("string")), ",").alias("history"))


@query("a7b_sketched_actors", "SELECT repo_name, count(DISTINCT actor_login) FILTER (WHERE type = 'WatchEvent') AS starrers, count(DISTINCT actor_login) FILTER (WHERE type = 'ForkEvent') AS forkers, true AS near FROM repo_events GROUP BY 1")
def _(t):
    """Exact distinct actors, and whether the united hourly sketches come within a twentieth of them."""
    sketched = ev.distinct_actors(ev.actor_sketches(t.repo_events)).select("repo_name", F.col("starrers").alias("s"), F.col("forkers").alias("f"))
    kind = lambda k: F.count_distinct(F.when(F.col("type") == k, F.col("actor_login")))
    exact = t.repo_events.groupBy("repo_name").agg(kind("WatchEvent").alias("starrers"), kind("ForkEvent").alias("forkers"))
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(1.0), F.col(b) / 20)
    return exact.join(sketched, "repo_name").select("repo_name", "starrers", "forkers", (close("s", "starrers") & close("f", "forkers")).alias("near"))
