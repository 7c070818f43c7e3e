"""Queries over candidates, exclusion lists, tiers and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as x
from ..operators import discovery as d
from ..operators import events as ev
from ..operators import health, scoring, tiers
from ..sources import archive
from ..sources.views import NOW
from .event_queries import _TOTALS, WEEK, edge
from .registry import query

YEAR_AGO = NOW - 365 * x.DAY


@query("f3_gates", "SELECT source, full_name, stars FROM candidates WHERE stars >= 100 AND (created_s IS NULL OR {NOW} - created_s <= 90 * 86400)")
def _(t):
    return t.candidates.filter(x.passes_gates(F.col("stars"), F.col("created_s"), NOW, 100, 90)).select("source", "full_name", "stars")


def _names(t, column: str, values: list[str]):
    return t.spark.createDataFrame([(v,) for v in values], f"{column} string")


_SPLIT = "SELECT DISTINCT full_name, source, stars, created_s, unnest(string_split(topics_text, ' ')) AS topic FROM candidates"


@query("f4_topic_search", f"""WITH s AS ({_SPLIT}) SELECT topic, full_name, stars, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY stars DESC, full_name) AS nth FROM s
WHERE source = 'topic' AND topic IN ('blue', 'red', 'ring', 'red-kit') AND stars >= 50 AND created_s >= {YEAR_AGO}) WHERE nth <= 100""")
def _(t):
    found = d.by_topic(t.candidates.filter("source = 'topic'"), _names(t, "topic", ["blue", "red", "ring", "red-kit"]), 50, YEAR_AGO)
    return found.select("topic", "full_name", "stars", "nth")


@query("f5_owner_search", f"""SELECT owner, full_name, stars, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY stars DESC, full_name) AS nth FROM candidates
WHERE source = 'org' AND owner IN ('org1', 'org2', 'org3') AND stars >= CASE owner WHEN 'org2' THEN 2000 ELSE 100 END AND created_s >= {YEAR_AGO}) WHERE nth <= 100""")
def _(t):
    owners = t.spark.createDataFrame([("org1", 0), ("org2", 2000), ("org3", 0)], "owner string, min_stars long")
    return d.by_owner(t.candidates.filter("source = 'org'"), owners, 100, YEAR_AGO).select("owner", "full_name", "stars", "nth")


@query("f6_language_search", """SELECT step, full_name, updated_s, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY updated_s DESC, full_name) AS nth
FROM (SELECT c.*, concat(lower(language), '/pushed-', w, 'd') AS step FROM candidates c, (VALUES (7), (14)) AS ws(w) WHERE source = 'language' AND language IN ('Go', 'Rust') AND stars >= 50 AND pushed_s >= {NOW} - w * 86400)) WHERE nth <= 100""")
def _(t):
    found = d.by_language(t.candidates.filter("source = 'language'"), _names(t, "language", ["Go", "Rust"]), [7, 14], 50, NOW)
    return found.select("step", "full_name", "updated_s", "nth")


_MATCH = """(r.full_name = p.pattern OR (length(p.pattern) - length(replace(p.pattern, '/', '')) = 1 AND (split_part(p.pattern, '/', 1) IN ('*', split_part(r.full_name, '/', 1))) AND (split_part(p.pattern, '/', 2) IN ('*', split_part(r.full_name, '/', 2)))))"""


@query("f7_excluded", f"SELECT DISTINCT r.full_name FROM repos r JOIN exclusions p ON {_MATCH}")
def _(t):
    return d.excluded_names(t.repos, t.exclusions)


@query("f8_excluded_any_case", """SELECT DISTINCT r.full_name FROM repos r JOIN exclusions p ON lower(r.full_name) = lower(p.pattern)
  OR (p.pattern LIKE '%/*' AND split_part(p.pattern, '/', 1) <> '*' AND lower(split_part(p.pattern, '/', 1)) = lower(split_part(r.full_name, '/', 1)))""")
def _(t):
    return d.excluded_any_case(t.repos, t.exclusions)


@query("f8b_valid_patterns", """SELECT DISTINCT pattern, trim(pattern) <> '' AND NOT contains(pattern, '..') AND NOT regexp_matches(trim(pattern), '^[./~]') AND regexp_full_match(trim(pattern), '[A-Za-z0-9_.][A-Za-z0-9_.-]*/([A-Za-z0-9_.][A-Za-z0-9_.-]*|\\*)') AS ok FROM exclusions""")
def _(t):
    return t.exclusions.select("pattern", x.valid_pattern(F.col("pattern")).alias("ok")).distinct()


_FLAGGED = f"""WITH b AS (SELECT DISTINCT r.full_name FROM candidates r JOIN exclusions p ON {_MATCH}),
fl AS (SELECT c.*, c.full_name IN (SELECT full_name FROM tracked) AS already_tracked, c.full_name IN (SELECT full_name FROM b) AS is_excluded FROM candidates c)"""
_GATED = """age AS (SELECT *, CAST({NOW} - created_s AS DOUBLE) / 86400.0::DOUBLE AS age FROM fl WHERE stars >= 50 AND (created_s IS NULL OR {NOW} - created_s <= 365 * 86400)),
prev AS (SELECT *, CASE WHEN {NOW} - updated_s < 7 * 86400 AND created_s IS NOT NULL AND age > 0 THEN greatest(0, CAST(trunc(CAST(stars AS DOUBLE) - CAST(stars AS DOUBLE) / age * 7.0::DOUBLE) AS BIGINT)) ELSE 0 END AS before FROM age),
vel AS (SELECT *, CAST(stars - before AS DOUBLE) / 7.0::DOUBLE AS v, CAST(forks AS DOUBLE) / 7.0::DOUBLE AS fv FROM prev),
sc AS (SELECT *, v * 2.0::DOUBLE + v * 3.0::DOUBLE + fv * 1.5::DOUBLE AS raw_score FROM vel),
bo AS (SELECT source, min(raw_score) AS lo, max(raw_score) AS hi, count(*) AS n FROM sc GROUP BY source),
nm AS (SELECT sc.*, CASE WHEN n = 1 OR hi - lo = 0 THEN 50.0::DOUBLE ELSE floor((raw_score - lo) / (hi - lo) * 100.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS normalized FROM sc JOIN bo USING (source)),
au AS (SELECT *, NOT already_tracked AND NOT is_excluded AND normalized >= 50.0::DOUBLE AS auto_track FROM nm)"""


def _discovered(t):
    return d.discover(t.candidates, t.tracked.select("full_name"), t.exclusions, NOW)


@query("c1_discover", f"{_FLAGGED}, {_GATED} SELECT source, full_name, already_tracked, is_excluded, raw_score, normalized, auto_track FROM au")
def _(t):
    return _discovered(t).select("source", "full_name", "already_tracked", "is_excluded", "raw_score", "normalized", "auto_track")


@query("c2_discover_all", f"{_FLAGGED}, {_GATED} SELECT full_name, source, step_ord, pos, normalized, auto_track FROM (SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY step_ord, pos) AS rn FROM au) WHERE rn = 1")
def _(t):
    return d.first_source(_discovered(t)).select("full_name", "source", "step_ord", "pos", "normalized", "auto_track")


@query("a17_source_counters", f"""{_FLAGGED}, g AS (SELECT *, stars >= 100 AND (created_s IS NULL OR {{NOW}} - created_s <= 90 * 86400) AS ok FROM fl)
SELECT source, count(*) AS total_found, count(*) FILTER (WHERE ok) AS after_filters, count(*) FILTER (WHERE ok AND NOT already_tracked AND NOT is_excluded) AS new_repos,
 count(*) FILTER (WHERE already_tracked) AS tracked, count(*) FILTER (WHERE is_excluded) AS excluded FROM g GROUP BY source""")
def _(t):
    return d.source_counters(d.flagged(t.candidates, t.tracked.select("full_name"), t.exclusions), 100, 90, NOW)


@query("x20_listing", f"""{_FLAGGED}, {_GATED} SELECT source, full_name, CASE WHEN already_tracked THEN 'tracked' WHEN is_excluded THEN 'excluded' WHEN auto_track THEN 'auto-track' ELSE 'new' END AS status,
 CASE WHEN length(description) > 30 THEN concat(substring(description, 1, 27), '...') ELSE description END AS description FROM au""")
def _(t):
    rows = _discovered(t)
    status = x.listing_status(F.col("already_tracked"), F.col("is_excluded"), F.col("auto_track"))
    return rows.select("source", "full_name", status.alias("status"), x.cut_text(F.col("description")).alias("description"))


@query("f11_prefilter", """SELECT c.source, c.full_name FROM candidates c LEFT JOIN star_obs o ON c.full_name = o.full_name
WHERE NOT coalesce({NOW} - observed_s >= 0 AND {NOW} - observed_s < 7 * 86400 AND o.stars < 100, false)""")
def _(t):
    return d.prefilter(t.candidates, t.star_obs, 100, 7 * x.DAY, NOW).select("source", "full_name")


@query("j4_fresh_observations", "SELECT c.source, c.full_name, o.stars AS seen FROM candidates c JOIN star_obs o ON c.full_name = o.full_name AND {NOW} - observed_s BETWEEN 0 AND 7 * 86400 - 1")
def _(t):
    obs = t.star_obs.withColumnRenamed("stars", "seen")
    age = F.lit(NOW) - F.col("observed_s")
    return t.candidates.join(obs, "full_name").filter((age >= 0) & (age < 7 * x.DAY)).select("source", "full_name", "seen")


_META = "SELECT full_name, max(stars) AS stars, max(day) AS updated_s FROM snapshots GROUP BY 1"


@query("c3_from_events", f"""WITH tt AS ({_TOTALS}), m AS ({_META}), tr AS (SELECT DISTINCT repo_name FROM repo_events WHERE actor_login = 'u13' AND type = 'WatchEvent'),
r AS (SELECT repo_name AS full_name, total FROM tt WHERE total >= 5 ORDER BY total DESC, repo_name LIMIT 500),
o AS (SELECT full_name, CASE WHEN stars % 3 = 0 THEN 1 ELSE 9 END AS seen, {{NOW}} - (stars % 10) * 86400 AS observed_s FROM m WHERE stars % 2 = 0),
k AS (SELECT r.full_name, total, m.stars FROM r JOIN m ON r.full_name = m.full_name LEFT JOIN o ON r.full_name = o.full_name WHERE NOT coalesce(seen < 3 AND {{NOW}} - observed_s < 7 * 86400, false) AND regexp_full_match(r.full_name, '[^/]+/[^/]+') AND r.full_name NOT IN (SELECT repo_name FROM tr) AND split_part(r.full_name, '/', 1) <> 'org3'
  AND m.stars >= 3 AND {{NOW}} - m.updated_s <= 365 * 86400),
c AS (SELECT * FROM k ORDER BY total DESC, full_name LIMIT 60), b AS (SELECT min(total) AS lo, max(total) AS hi, count(*) AS n FROM c)
SELECT full_name, total, stars, CASE WHEN n = 1 OR hi = lo THEN 50.0::DOUBLE ELSE floor(CAST(total - lo AS DOUBLE) / CAST(hi - lo AS DOUBLE) * 100.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS normalized FROM c, b""")
def _(t):
    events = t.repo_events
    tracked = events.filter("actor_login = 'u13' AND type = 'WatchEvent'").select(F.col("repo_name").alias("full_name")).distinct()
    banned = _names(t, "pattern", ["org3/*", "org99/*"])
    meta = t.snapshots.groupBy("full_name").agg(F.max("stars").alias("stars"), F.max("day").alias("updated_s"))
    seen = F.when(F.col("stars") % 3 == 0, 1).otherwise(9).cast("long").alias("stars")
    seen = meta.filter("stars % 2 = 0").select("full_name", seen, (F.lit(NOW) - (F.col("stars") % 10) * x.DAY).alias("observed_s"))
    totals = ev.window_totals(ev.hour_counts(events), edge(), WEEK)
    return d.from_events(totals, tracked, banned, meta, seen, NOW, floor=5, star_gate=3, cap=60).select("full_name", "total", "stars", "normalized")


@query("a18_dedup_ratio", """WITH n AS (SELECT count(*) AS total, count(*) FILTER (WHERE full_name IN (SELECT full_name FROM tracked)) AS dropped FROM candidates)
SELECT total, dropped, CAST(dropped AS DOUBLE) / CAST(nullif(total, 0) AS DOUBLE) AS ratio FROM n""")
def _(t):
    flagged = t.candidates.join(t.tracked.select("full_name").distinct().withColumn("known", F.lit(True)), "full_name", "left")
    counts = flagged.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("known", F.lit(False))).alias("dropped"))
    return counts.withColumn("ratio", x.double(F.col("dropped")) / x.double(F.nullif("total", F.lit(0))))


@query("w9_running_cap", "SELECT repo_name, total FROM ({}) ORDER BY total DESC, repo_name LIMIT 25".format(_TOTALS))
def _(t):
    return d.cap_running(ev.window_totals(ev.hour_counts(t.repo_events), edge(), WEEK), 25, [F.desc("total"), F.col("repo_name")]).select("repo_name", "total")


@query("m12_auto_tracked", f"{_FLAGGED}, {_GATED} SELECT DISTINCT full_name FROM (SELECT full_name FROM au WHERE auto_track UNION ALL SELECT full_name FROM tracked)")
def _(t):
    auto = d.first_source(_discovered(t).filter("auto_track")).select("full_name")
    return auto.union(t.tracked.select("full_name")).distinct()


_TIERS = """WITH r AS (SELECT full_name, growth_score, first_seen_s, last_collected_s, row_number() OVER (ORDER BY growth_score DESC, full_name) - 1 AS rank FROM repos),
ti AS (SELECT *, CASE WHEN {NOW} - first_seen_s < 48 * 3600 THEN 'new' WHEN rank < 500 THEN 'hot' WHEN rank < 2000 THEN 'warm' ELSE 'cold' END AS tier FROM r),
iv AS (SELECT *, CAST(CASE tier WHEN 'warm' THEN 4 WHEN 'cold' THEN 12 ELSE 1 END AS BIGINT) * 3600 AS interval_s, CASE tier WHEN 'new' THEN 0 WHEN 'hot' THEN 1 WHEN 'warm' THEN 2 ELSE 3 END AS ord FROM ti),
du AS (SELECT *, last_collected_s + interval_s AS due_s, coalesce(last_collected_s + interval_s <= {NOW}, true) AS is_due FROM iv)"""


@query("w2_tiers", f"{_TIERS} SELECT full_name, rank, tier, interval_s, due_s, is_due FROM du")
def _(t):
    return tiers.assign(t.repos.select("full_name", "growth_score", "first_seen_s", "last_collected_s"), NOW).select("full_name", "rank", "tier", "interval_s", "due_s", "is_due")


@query("f15_due", f"{_TIERS} SELECT full_name, tier, rank FROM du WHERE is_due ORDER BY ord, rank")
def _(t):
    return tiers.due(tiers.assign(t.repos.select("full_name", "growth_score", "first_seen_s", "last_collected_s"), NOW)).select("full_name", "tier", "rank")


@query("a19_tier_histogram", f"{_TIERS}, s(tier) AS (VALUES ('new'), ('hot'), ('warm'), ('cold')) SELECT s.tier, count(du.tier) AS n FROM s LEFT JOIN du ON s.tier = du.tier GROUP BY 1")
def _(t):
    return tiers.histogram(tiers.assign(t.repos.select("full_name", "growth_score", "first_seen_s", "last_collected_s"), NOW))


_GATES = """WITH g AS (SELECT *, CAST(sum(emitted) OVER (ORDER BY hour_s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling FROM gate_log),
st AS (SELECT *, CASE WHEN queue_depth >= 1000 THEN 'queue_depth' WHEN rate_limit_pct >= 80 THEN 'rate_limit' WHEN rolling >= 5000 THEN 'daily_cap' ELSE '' END AS reason,
  CASE WHEN rolling >= 5000 THEN 'hard' WHEN rolling >= 4000 THEN 'warn' ELSE 'ok' END AS cap_state FROM g)"""


def _states(t):
    return health.gate_states(health.rolling_emissions(t.gate_log))


@query("w5_rolling_emissions", f"{_GATES} SELECT hour_s, emitted, rolling FROM st")
def _(t):
    return _states(t).select("hour_s", "emitted", "rolling")


@query("x28_gate_states", f"{_GATES} SELECT hour_s, reason, cap_state FROM st")
def _(t):
    return _states(t).select("hour_s", "reason", "cap_state")


@query("w7_transitions", f"{_GATES} SELECT hour_s, was, reason FROM (SELECT hour_s, reason, coalesce(lag(reason) OVER (ORDER BY hour_s), '') AS was FROM st) WHERE was <> reason")
def _(t):
    return health.transitions(_states(t), "reason", "").select("hour_s", "was", "reason")


@query("w7_pauses", f"""{_GATES}, p AS (SELECT hour_s, reason, reason <> '' AND coalesce(lag(reason) OVER (ORDER BY hour_s), '') = '' AS fresh, lead(hour_s) OVER (ORDER BY hour_s) AS nxt FROM st),
i AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (ORDER BY hour_s) AS id FROM p)
SELECT min(hour_s) AS start_s, arg_max(nxt, hour_s) AS end_s, count(DISTINCT reason) AS reasons, count(*) AS hours, CASE WHEN bool_or(nxt IS NULL) THEN NULL ELSE arg_max(nxt, hour_s) - min(hour_s) END AS paused_s FROM i WHERE reason <> '' GROUP BY id""")
def _(t):
    return health.pauses(_states(t))


@query("x21_fallback", """SELECT id, stars AS lim, forks AS remaining, status = 'active' AND stars <> 0 AND CAST(forks AS DOUBLE) / CAST(nullif(stars, 0) AS DOUBLE) < 0.25::DOUBLE AS falls_back,
  CASE WHEN stars <> 0 THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - CAST(forks AS DOUBLE) / CAST(nullif(stars, 0) AS DOUBLE)) END AS used, greatest(0, first_seen_s + 86400 * (id % 5) - {NOW}) AS reset_in_s FROM repos WHERE stars <> 0""")
def _(t):
    r = t.repos.filter("stars <> 0").select("id", F.col("stars").alias("lim"), F.col("forks").alias("remaining"), (F.col("status") == "active").alias("on"), (F.col("first_seen_s") + x.DAY * (F.col("id") % 5)).alias("reset_s"))
    return r.select("id", "lim", "remaining", x.falls_back(F.col("on"), F.col("lim"), F.col("remaining")).alias("falls_back"), x.used_ratio(F.col("lim"), F.col("remaining")).alias("used"), x.reset_seconds(F.col("reset_s"), NOW).alias("reset_in_s"))


@query("s3_hours_to_read", """WITH e AS (SELECT max(EPOCH(hour)) - 36000 AS cursor FROM repo_events), h AS (SELECT unnest(generate_series(cursor + 3600, ({NOW} - 5400) // 3600 * 3600, 3600)) AS hour_s FROM e)
SELECT CAST(h.hour_s AS BIGINT) AS hour_s, count(event_id) AS events FROM h LEFT JOIN repo_events r ON EPOCH(r.hour) = h.hour_s GROUP BY 1""")
def _(t):
    events = t.repo_events
    cursor = events.agg(F.max(F.unix_timestamp("hour"))).first()[0] - 36000
    counts = events.groupBy("hour").agg(F.count(F.lit(1)).alias("events"))
    return archive.hours_to_read(t.spark, cursor, NOW).join(counts, "hour", "left").fillna(0, ["events"]).select(F.unix_timestamp("hour").alias("hour_s"), "events")


@query("s3b_fallback_hours", """WITH h AS (SELECT unnest(generate_series({NOW} // 3600 * 3600 - 29 * 3600, {NOW} // 3600 * 3600, 3600)) AS hour_s)
SELECT CAST(h.hour_s AS BIGINT) AS hour_s, count(event_id) AS events FROM h LEFT JOIN repo_events r ON EPOCH(r.hour) = h.hour_s GROUP BY 1""")
def _(t):
    counts = t.repo_events.groupBy("hour").agg(F.count(F.lit(1)).alias("events"))
    return archive.fallback_hours(t.spark, NOW, 30.9).join(counts, "hour", "left").fillna(0, ["events"]).select(F.unix_timestamp("hour").alias("hour_s"), "events")


@query("x32_search_steps", """WITH a AS (SELECT source, step_ord, CASE source WHEN 'topic' THEN split_part(topics_text, ' ', 1) WHEN 'org' THEN owner ELSE concat(lower(language), '/pushed-7d') END AS label FROM candidates)
SELECT step_ord, source, label, count(*) AS found FROM a GROUP BY 1, 2, 3""")
def _(t):
    first = F.split_part("topics_text", F.lit(" "), F.lit(1))
    rows = t.candidates.select("source", d.step_label(F.col("source"), first, F.col("owner"), F.col("language"), 7).alias("label"))
    return d.search_plan(rows)


@query("w13_batches", "SELECT id, id // 25 AS batch FROM repos")
def _(t):
    return health.batches(t.repos.select("id"), "id")


_BATCH = "WITH b AS (SELECT id // 25 AS batch, count(*) FILTER (WHERE id % 31 = 0) = 0 AS ok FROM repos GROUP BY 1)"


@query("w14_abort", f"{_BATCH} SELECT min(batch) AS abort_at FROM (SELECT batch, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (ORDER BY batch ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS bad FROM b) WHERE bad >= 3")
def _(t):
    rows = health.batches(t.repos.select("id"), "id").groupBy("batch").agg((F.count_if(F.col("id") % 31 == 0) == 0).alias("ok"))
    return health.first_abort(rows)


@query("j15_failed_batch_rows", f"{_BATCH} SELECT r.id, r.full_name FROM repos r JOIN b ON r.id >= b.batch * 25 AND r.id < b.batch * 25 + 25 AND NOT b.ok WHERE r.last_collected_s IS NULL OR r.id % 2 = 1")
def _(t):
    rows = health.batches(t.repos.select("id", "full_name", "last_collected_s"), "id")
    failed = rows.groupBy("batch").agg((F.count_if(F.col("id") % 31 == 0) == 0).alias("ok")).filter("NOT ok").select("batch")
    done = rows.filter("last_collected_s IS NOT NULL AND id % 2 = 0").select("id")
    # ranges of fixed size are an equi-join on the batch number
    return rows.join(failed, "batch", "left_semi").join(done, "id", "left_anti").select("id", "full_name")


@query("w13_batches_by_name", "SELECT full_name, (row_number() OVER (ORDER BY full_name) - 1) // 25 AS batch FROM repos")
def _(t):
    return health.batches_in_order(t.repos.select("full_name"), "full_name").select("full_name", "batch")


#: Failed ranges of rows of any length, some of them empty, overlapping or beyond the end.
_RANGES = "SELECT CAST((s_suppkey * 131) % 2500 AS BIGINT) AS start_no, CAST((s_suppkey * 131) % 2500 + s_suppkey % 60 AS BIGINT) AS end_no FROM supplier"


@query("j15_rows_of_failed_ranges", f"""WITH n AS (SELECT full_name, last_collected_s, row_number() OVER (ORDER BY full_name) - 1 AS row_no FROM repos), f AS ({_RANGES})
SELECT full_name, row_no FROM n WHERE EXISTS (SELECT 1 FROM f WHERE row_no >= start_no AND row_no < end_no) AND last_collected_s IS NULL OR row_no % 2 = 1 AND EXISTS (SELECT 1 FROM f WHERE row_no >= start_no AND row_no < end_no)""")
def _(t):
    """Rows to fetch one by one: in a failed range, and not fetched otherwise."""
    supplier = t.spark.read.parquet(f"{t.sf_dir}/supplier.parquet")
    start = (F.col("s_suppkey") * 131) % 2500
    ranges = supplier.select(start.cast("long").alias("start_no"), (start + F.col("s_suppkey") % 60).cast("long").alias("end_no"))
    rows = health.batches_in_order(t.repos.select("full_name", "last_collected_s"), "full_name")
    return health.in_ranges(rows.filter("last_collected_s IS NULL OR row_no % 2 = 1"), "row_no", ranges).select("full_name", "row_no")


@query("w12_failure_runs", """WITH l AS (SELECT user_id AS archive, event_id AS run, event_type <> 'error' AS ok FROM events),
s AS (SELECT archive, coalesce(max(run) FILTER (WHERE ok), -1) AS last_ok FROM l GROUP BY 1)
SELECT archive, count(*) FILTER (WHERE NOT ok AND run > last_ok) AS failures, count(*) FILTER (WHERE NOT ok AND run > last_ok) >= 2 AS skipped FROM l JOIN s USING (archive) GROUP BY 1""")
def _(t):
    log = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").select(F.col("user_id").alias("archive"), F.col("event_id").alias("run"), (F.col("event_type") != "error").alias("ok"))
    return health.failure_runs(log, 2)


@query("a34_api_calls", "SELECT event_type AS resource, CASE WHEN value < 20 THEN 'ok' ELSE 'error' END AS result, count(*) AS calls FROM events GROUP BY 1, 2")
def _(t):
    log = t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    return health.api_calls(log.select(F.col("event_type").alias("resource"), F.when(F.col("value") < 20, "ok").otherwise("error").alias("result")))


@query("m13_normalized_state", """WITH b AS (SELECT min(growth_score) AS lo, max(growth_score) AS hi FROM repos)
SELECT full_name, floor((growth_score - lo) / (hi - lo) * 100.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS normalized FROM repos, b""")
def _(t):
    return scoring.min_max(t.repos, "growth_score").select("full_name", "normalized")
