"""Queries over scan cycles, nested activity, lists and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..functions import taxonomy
from ..operators import audit, classification, health, scans, tiers
from ..operators import discovery as d
from ..operators import events as ev
from ..operators import repository as r
from ..sources import archive, sinks
from ..sources.tables import merge_upsert, shared_folder
from ..sources.views import NOW
from .discovery_queries import _FLAGGED, _TIERS
from .event_queries import _HOURLY, _KEPT, edge
from .registry import query
from .repo_queries import _CATEGORIES, _CLUSTERS, _LEGACY, _PAIRS

WEEK = 7 * x.DAY


@query("f17_recent_activity", f"""SELECT repo_name AS full_name, count(*) FILTER (WHERE type = 'PullRequestEvent' AND merged AND created_s > {{NOW}} - {WEEK}) AS merged_prs_7d,
 count(*) FILTER (WHERE type = 'IssuesEvent' AND created_s > {{NOW}} - {WEEK}) AS new_issues_7d FROM repo_events WHERE type IN ('PullRequestEvent', 'IssuesEvent') GROUP BY 1""")
def _(t):
    rows = t.repo_events.filter("type IN ('PullRequestEvent', 'IssuesEvent')")
    listed = rows.select(F.col("repo_name").alias("full_name"), (F.col("type") == "PullRequestEvent").alias("is_pull_request"), F.when(F.col("merged"), F.col("created_s")).alias("merged_s"), "created_s")
    return scans.recent_activity(listed, NOW)


@query("f18_nested_activity", f"""WITH r AS (SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY repo_name, type) AS n FROM repo_events WHERE type IN ('PullRequestEvent', 'IssuesEvent') WINDOW w AS (PARTITION BY repo_name, type ORDER BY created_at DESC, event_id DESC)),
p AS (SELECT *, created_at > to_timestamp({{NOW}} - {WEEK})::TIMESTAMP AS fresh FROM r WHERE nth <= 5)
SELECT repo_name AS full_name, count(*) FILTER (WHERE type = 'PullRequestEvent' AND merged AND fresh) AS merged_prs_7d, count(*) FILTER (WHERE type = 'IssuesEvent' AND fresh) AS new_issues_7d, bool_or(nth = 5 AND n > 5 AND fresh) AS truncated FROM p GROUP BY 1""")
def _(t):
    size = 5  # a page; what is behind it is only known to be there
    w = Window.partitionBy("repo_name", "type").orderBy(F.desc("created_at"), F.desc("event_id"))
    rows = t.repo_events.filter("type IN ('PullRequestEvent', 'IssuesEvent')").withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= size + 1)
    here = F.col("nth") <= size

    def page(kind: str, *fields):
        items = F.sort_array(F.collect_list(F.when(here & (F.col("type") == kind), F.struct("nth", *fields))))
        more = F.count_if(~here & (F.col("type") == kind)) > 0
        return F.struct(items.alias("nodes"), F.struct(more.alias("hasNextPage")).alias("pageInfo"))

    merged = F.when(F.col("merged"), F.col("created_at")).alias("mergedAt")
    nodes = rows.groupBy(F.col("repo_name").alias("nameWithOwner")).agg(
        page("PullRequestEvent", merged, F.col("created_at").alias("updatedAt")).alias("recentMergedPRs"), page("IssuesEvent", F.col("created_at").alias("createdAt")).alias("recentIssues")
    )
    out = archive.nested_activity(nodes, edge(), size)
    return out.withColumns({k: F.col(k).cast("long") for k in ("merged_prs_7d", "new_issues_7d")})


@query("f19_legacy_view", "SELECT id, full_name, primary_category_legacy AS legacy_category FROM repos WHERE primary_category_legacy <> ''")
def _(t):
    return t.repos.withColumn("legacy_category", F.col("primary_category_legacy")).filter("legacy_category <> ''").select("id", "full_name", "legacy_category")


@query("f23_topic_scans", """WITH s AS (SELECT split_part(topics_text, ' ', 1) AS topic, max(first_seen_s) AS seen FROM repos WHERE id % 2 = 0 GROUP BY 1), a AS (SELECT DISTINCT unnest(string_split(topics_text, ' ')) AS topic FROM repos)
SELECT a.topic, coalesce(seen, 0) AS scanned_s FROM a LEFT JOIN s ON a.topic = s.topic""")
def _(t):
    first = t.repos.filter("id % 2 = 0").groupBy(F.split_part("topics_text", F.lit(" "), F.lit(1)).alias("topic")).agg(F.max("first_seen_s").alias("scanned_s"))
    asked = t.repos.select(F.explode(F.split("topics_text", " ")).alias("topic")).distinct()
    return asked.join(first, "topic", "left").fillna(0, ["scanned_s"])


@query("m10_key_values", """WITH o AS (SELECT split_part(topics_text, ' ', 1) AS k, CAST(max(id) AS VARCHAR) AS v FROM repos WHERE id % 2 = 0 GROUP BY 1), n AS (SELECT split_part(topics_text, ' ', 2) AS k, CAST(min(id) AS VARCHAR) AS v FROM repos GROUP BY 1)
SELECT coalesce(o.k, n.k) AS k, coalesce(n.v, o.v) AS v FROM o FULL JOIN n ON o.k = n.k""")
def _(t):
    old = t.repos.filter("id % 2 = 0").groupBy(F.split_part("topics_text", F.lit(" "), F.lit(1)).alias("k")).agg(F.max("id").cast("string").alias("v"))
    new = t.repos.groupBy(F.split_part("topics_text", F.lit(" "), F.lit(2)).alias("k")).agg(F.min("id").cast("string").alias("v"))
    return merge_upsert(old, new, "k", ["v"])


@query("j14b_missing_rows", """WITH f AS (SELECT id // 25 AS batch, id % 25 AS alias, id % 7 <> 0 AS found FROM repos), e AS (SELECT id // 25 AS batch, CASE WHEN id % 100 = 14 THEN NULL ELSE id % 25 END AS alias FROM repos WHERE id % 50 = 14 OR id % 49 = 0)
SELECT batch, alias, CASE WHEN found THEN 'found' WHEN EXISTS (SELECT 1 FROM e WHERE e.batch = f.batch AND (e.alias IS NULL OR e.alias = f.alias)) THEN 'batch_failed' ELSE 'gone' END AS outcome FROM f""")
def _(t):
    batch, alias = F.floor(F.col("id") / 25).cast("long"), (F.col("id") % 25)
    rows = t.repos.select(batch.alias("batch"), alias.alias("alias"), (F.col("id") % 7 != 0).alias("found"))
    bad = t.repos.filter("id % 50 = 14 OR id % 49 = 0").select(batch.alias("batch"), F.when(F.col("id") % 100 != 14, alias).alias("alias"), F.lit(True).alias("limited"))
    return scans.missing_outcomes(rows, bad).select("batch", "alias", "outcome")


@query("j16_topics_of_candidates", """SELECT r.full_name, coalesce(t.n, 0) AS topics FROM repos r LEFT JOIN (SELECT full_name, len(string_split(topics_text, ' ')) AS n FROM repos WHERE id % 4 <> 0) t ON r.full_name = t.full_name WHERE primary_subcategory = 'other' AND is_curated_list = 0 AND status = 'active'""")
def _(t):
    topics = t.repos.filter("id % 4 <> 0").select("full_name", F.size(F.split("topics_text", " ")).cast("long").alias("topics"))
    return r.drift_candidates(t.repos).join(topics, "full_name", "left").select("full_name", F.coalesce("topics", F.lit(0).cast("long")).alias("topics"))


@query("j17_known", "SELECT full_name FROM candidates WHERE full_name IN (SELECT full_name FROM tracked)")
def _(t):
    return t.candidates.join(t.tracked, "full_name", "left_semi").select("full_name")


@query("j18_tracked_list", """SELECT t.full_name FROM tracked t WHERE NOT EXISTS (SELECT 1 FROM exclusions p WHERE lower(t.full_name) = lower(p.pattern) OR (p.pattern LIKE '%/*' AND split_part(p.pattern, '/', 1) <> '*' AND lower(split_part(p.pattern, '/', 1)) = lower(split_part(t.full_name, '/', 1))))""")
def _(t):
    return scans.tracked_list(t.tracked.select("full_name"), t.exclusions)[0]


@query("u7_changed_patterns", """SELECT DISTINCT pattern FROM (SELECT pattern FROM exclusions UNION ALL SELECT concat(owner, '/*') FROM repos WHERE id % 40 = 1) WHERE pattern NOT IN (SELECT full_name FROM repos WHERE id % 97 = 5 AND id % 2 = 0)""")
def _(t):
    add = t.repos.filter("id % 40 = 1").select(F.concat("owner", F.lit("/*")).alias("pattern")).union(t.repos.filter("id % 40 = 2").select(F.concat(F.lit("../"), "name").alias("pattern")))
    gone = t.repos.filter("id % 97 = 5 AND id % 2 = 0").select(F.col("full_name").alias("pattern"))
    return scans.change_patterns(t.exclusions, add, gone)


@query("u6_known_names", "SELECT DISTINCT repo_name FROM repo_events")
def _(t):
    return t.repo_events.select("repo_name").distinct()


@query("x12_skipped", "SELECT id, readme_hash <> '' AND readme_hash = concat('h', CAST((id * 7) % 10 AS VARCHAR)) AND primary_category <> '' AS skipped FROM repos")
def _(t):
    fresh = F.concat(F.lit("h"), ((F.col("id") * 7) % 10).cast("string"))
    return t.repos.select("id", x.skip_classification(F.col("readme_hash"), fresh, F.col("primary_category")).alias("skipped"))


@query("x30_scan_path", "SELECT id, CASE WHEN id % 10 = 0 THEN 'canary' WHEN id % 2 = 0 THEN 'bulk' ELSE 'legacy' END AS path, CASE WHEN star_velocity > 0 THEN 'rising' ELSE 'stable' END AS trend FROM repos")
def _(t):
    return t.repos.select("id", scans.scan_path(F.col("id") % 2 == 0, F.col("id") % 10 == 0).alias("path"), x.trend(F.col("star_velocity")).alias("trend"))


_SCAN = """WITH s AS (SELECT full_name, stars, forks, contributors, CAST(merged_prs_7d AS DOUBLE) / 7.0::DOUBLE AS pv, CAST(new_issues_7d AS DOUBLE) / 7.0::DOUBLE AS iv, CASE WHEN id % 4 <> 0 THEN stars_prev ELSE 0 END AS sp, CASE WHEN id % 4 <> 0 THEN forks ELSE 0 END AS fp,
 CASE WHEN id % 4 <> 0 THEN contributors_prev ELSE 0 END AS cp, CASE WHEN id % 4 <> 0 THEN star_velocity ELSE 0.0::DOUBLE END AS vp, id % 4 <> 0 AS known FROM repos),
v AS (SELECT *, CASE WHEN known THEN CAST(stars - sp AS DOUBLE) / 2.0::DOUBLE ELSE 0.0::DOUBLE END AS sv, CASE WHEN known THEN CAST(forks - fp AS DOUBLE) / 2.0::DOUBLE ELSE 0.0::DOUBLE END AS fv, CASE WHEN known THEN CAST(contributors - cp AS DOUBLE) / 2.0::DOUBLE ELSE 0.0::DOUBLE END AS cv FROM s),
o AS (SELECT full_name, sv, sv * 2.0::DOUBLE + (sv - vp) * 3.0::DOUBLE + fv * 1.5::DOUBLE + 1.0::DOUBLE * 1.0::DOUBLE + cv * 1.5::DOUBLE + pv * 1.0::DOUBLE + iv * 0.5::DOUBLE AS raw_score FROM v), b AS (SELECT min(raw_score) AS lo, max(raw_score) AS hi FROM o)"""


@query("c4_scan_and_score", f"{_SCAN} SELECT full_name, sv AS star_velocity, raw_score, floor((raw_score - lo) / (hi - lo) * 100.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS normalized FROM o, b")
def _(t):
    repos = t.repos
    current = repos.select("full_name", "stars", "forks", "contributors", "merged_prs_7d", "new_issues_7d", F.lit(1.0).alias("release_cadence"))
    before = repos.filter("id % 4 <> 0").select("full_name", F.col("stars_prev").alias("stars"), "forks", F.col("contributors_prev").alias("contributors"), "star_velocity")
    return scans.scan_and_score(current, before, 2.0).select("full_name", "star_velocity", "raw_score", "normalized")


@query("c9_plan_refresh", f"{_TIERS} SELECT full_name, tier, rank FROM du WHERE is_due AND full_name IN (SELECT full_name FROM candidates WHERE source = 'topic') ORDER BY ord, rank")
def _(t):
    return scans.plan_refresh(t.repos, t.repos, t.candidates.filter("source = 'topic'"), NOW).select("full_name", "tier", "rank")


@query("c8_export_rows", f"""WITH lg(slug, c, s) AS (VALUES {_LEGACY}), pr(pair) AS (VALUES {_PAIRS}),
w AS (SELECT full_name, stars, status, CASE WHEN force_category <> '' THEN force_category ELSE primary_category END AS raw, CASE WHEN force_category <> '' THEN force_subcategory ELSE primary_subcategory END AS sub FROM repos),
x AS (SELECT full_name, stars, status, coalesce(c, raw) AS category, CASE WHEN c IS NOT NULL AND (sub = '' OR concat(c, '/', sub) NOT IN (SELECT pair FROM pr)) THEN s ELSE sub END AS subcategory FROM w LEFT JOIN lg ON raw = slug)
SELECT x.full_name, stars, CASE WHEN category <> '' THEN category WHEN coalesce(t.categories, '') <> '' THEN t.categories WHEN status = 'pending' THEN 'pending' ELSE 'default' END AS category, subcategory FROM x LEFT JOIN (SELECT full_name, categories FROM tracked WHERE pos < 1000000000) t ON x.full_name = t.full_name""")
def _(t):
    return scans.export_rows(t.repos, t.repos, t.tracked.filter("pos < 1000000000"))


@query("a30_discovery_totals", f"""{_FLAGGED}, g AS (SELECT *, stars >= 100 AND (created_s IS NULL OR {{NOW}} - created_s <= 90 * 86400) AS ok FROM fl)
SELECT count(*) FILTER (WHERE ok AND NOT already_tracked AND NOT is_excluded) AS new_repos, count(*) FILTER (WHERE already_tracked) AS tracked FROM g""")
def _(t):
    counters = d.source_counters(d.flagged(t.candidates, t.tracked.select("full_name"), t.exclusions), 100, 90, NOW)
    return scans.discovery_totals(counters)


@query("a23_per_category", f"{_CLUSTERS} {_CATEGORIES}")
def _(t):
    rows = t.repos.select("full_name", "primary_category", F.split("topics_text", " ").alias("topics"), F.col("category_confidence").alias("confidence"))
    return audit.per_category(rows, audit.cluster_repos(rows))


@query("r13_batch_signals", f"SELECT 'pipeline.lag_seconds' AS metric, strftime(TS(hour_s), '%Y-%m-%d-%H') AS archive, CAST({{NOW}} - hour_s AS DOUBLE) AS value FROM ({_HOURLY}) GROUP BY hour_s UNION ALL SELECT 'pipeline.events', strftime(TS(hour_s), '%Y-%m-%d-%H'), CAST(sum(event_count) AS DOUBLE) FROM ({_HOURLY}) GROUP BY hour_s")
def _(t):
    points = scans.batch_signals(ev.hour_counts(t.repo_events), NOW)
    return points.select("metric", F.col("attributes")["archive"].alias("archive"), "value")


@query("m1_upsert_rows", "SELECT full_name, CASE WHEN id % 3 = 0 THEN stars + 9 ELSE stars END AS stars, first_seen_s FROM repos UNION ALL SELECT concat(full_name, '-v2'), stars, CAST({NOW} AS BIGINT) FROM repos WHERE id % 100 = 1")
def _(t):
    target = t.repos.select("full_name", "stars", "first_seen_s")
    source = t.repos.filter("id % 3 = 0").select("full_name", (F.col("stars") + 9).alias("stars"), F.lit(NOW).cast("long").alias("first_seen_s"))
    source = source.union(t.repos.filter("id % 100 = 1").select(F.concat("full_name", F.lit("-v2")), "stars", F.lit(NOW).cast("long")))
    return merge_upsert(target, source, "full_name", ["stars"])


@query("j11_legacy_counts", f"WITH lg(slug, c, s) AS (VALUES {_LEGACY}) SELECT coalesce(c, 'other') AS category, coalesce(s, 'other') AS subcategory, count(*) AS n FROM repos LEFT JOIN lg ON primary_category = slug GROUP BY 1, 2")
def _(t):
    table = taxonomy.legacy(t.spark)
    rows = t.repos.join(F.broadcast(table), F.col("primary_category") == table["slug"], "left")  # 43 fixed rows
    return rows.groupBy(F.coalesce("category", F.lit("other")).alias("category"), F.coalesce("subcategory", F.lit("other")).alias("subcategory")).agg(F.count(F.lit(1)).alias("n"))


def _written_json(t, rows):
    """A folder of JSON lines."""
    folder = f"{shared_folder(t.spark)}/json-{uuid.uuid4().hex}"
    sinks.write_json(rows, folder)
    return folder


@query("s6_search_results", "SELECT full_name, owner, name, language, stars, forks, CASE WHEN pos % 4 <> 0 THEN created_s END AS created_s, updated_s, len(string_split(topics_text, ' ')) AS topics FROM candidates WHERE source = 'org'")
def _(t):
    def at(c):
        return F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    c = t.candidates.filter("source = 'org'")
    rows = c.select("full_name", F.struct(F.col("owner").alias("login")).alias("owner"), "name", "description", "language", F.split("topics_text", " ").alias("topics"), F.col("stars").alias("stargazers_count"),
                    F.col("forks").alias("forks_count"), F.when(F.col("pos") % 4 == 0, "yesterday").otherwise(at("created_s")).alias("created_at"), at("updated_s").alias("updated_at"), at("pushed_s").alias("pushed_at"))
    r = archive.read_search(t.spark, _written_json(t, rows))
    return r.select("full_name", "owner", "name", "language", "stars", "forks", F.unix_timestamp("created_at").alias("created_s"), F.unix_timestamp("updated_at").alias("updated_s"), F.size("topics").cast("long").alias("topics"))


@query("s7_flat_nodes", "SELECT full_name, stars, forks, language, len(string_split(topics_text, ' ')) AS topics, merged_prs_7d AS open_prs, CASE WHEN id % 3 <> 0 THEN new_issues_7d ELSE 0 END AS open_issues, contributors FROM repos")
def _(t):
    topic = F.transform(F.split("topics_text", " "), lambda s: F.struct(F.struct(s.alias("name")).alias("topic")))
    count = lambda c: F.struct(F.col(c).alias("totalCount"))
    rows = t.repos.select(F.col("full_name").alias("nameWithOwner"), F.col("stars").alias("stargazerCount"), F.col("forks").alias("forkCount"), F.when(F.col("language") != "", F.struct(F.col("language").alias("name"))).alias("primaryLanguage"),
                          F.struct(topic.alias("nodes")).alias("repositoryTopics"), F.when(F.col("id") % 3 != 0, count("new_issues_7d")).alias("issues"), count("merged_prs_7d").alias("pullRequests"), count("contributors").alias("mentionableUsers"))
    out = archive.flat_nodes(archive.read_jsonl(t.spark, _written_json(t, rows), archive.NODE))
    return out.select("full_name", "stars", "forks", "language", F.size("topics").cast("long").alias("topics"), "open_prs", "open_issues", "contributors")


@query("s9_jsonl", "SELECT id, full_name, growth_score FROM repos WHERE id % 2 = 0")
def _(t):
    return archive.read_jsonl(t.spark, _written_json(t, t.repos.filter("id % 2 = 0").select("id", "full_name", "growth_score")), "id bigint, full_name string, growth_score double")


@query("s11_json_rows", """SELECT concat('{"full_name":"', full_name, '","stars":', CAST(stars AS VARCHAR), '}') AS value FROM repos""")
def _(t):
    return sinks.as_json(t.repos.select("full_name", "stars"))


@query("m14_state_tables", """SELECT full_name, stars, forks, star_velocity, 'pending' AS status, CASE WHEN id % 3 = 0 THEN stars + 1 END AS seen, id % 4 = 0 AS known FROM repos""")
def _(t):
    entry = F.struct("owner", "name", "stars", "forks", "contributors", "star_velocity")
    seen = F.when(F.col("id") % 3 == 0, F.struct("full_name", F.struct((F.col("stars") + 1).alias("stars"), F.lit("2024-01-30T00:00:00Z").alias("observed_at"))))
    known = F.when(F.col("id") % 4 == 0, F.struct("full_name", F.lit(True)))
    # objects of at most 500 repositories each
    docs = t.repos.groupBy(F.floor(F.col("id") / 500).alias("part")).agg(
        F.map_from_entries(F.collect_list(F.struct("full_name", entry))).alias("repos"), F.map_from_entries(F.collect_list(seen)).alias("star_observations"), F.struct(F.map_from_entries(F.collect_list(known)).alias("known_repos")).alias("discovery")
    )
    state = archive.read_state(t.spark, _written_json(t, docs.drop("part")), one_a_line=True)
    out = state["repos"].join(state["star_obs"].select("full_name", F.col("stars").alias("seen")), "full_name", "left").join(state["known"].withColumn("known", F.lit(True)), "full_name", "left")
    return out.select("full_name", "stars", "forks", "star_velocity", "status", "seen", F.coalesce("known", F.lit(False)).alias("known"))


@query("m14_last_scan", "SELECT CAST(max({NOW} - id * 60) AS BIGINT) AS last_scan_s FROM repos")
def _(t):
    at = F.date_format(F.timestamp_seconds(F.lit(NOW) - F.col("id") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    state = archive.read_state(t.spark, _written_json(t, t.repos.select(F.struct(at.alias("last_scan")).alias("discovery"))), one_a_line=True)
    return state["last_scan"].select(F.unix_timestamp("last_scan").alias("last_scan_s"))


@query("s13b_all_health_points", f"""{_TIERS}, spine(tier) AS (VALUES ('new'), ('hot'), ('warm'), ('cold')), four(is_excluded, forced) AS (VALUES (false, false), (false, true), (true, false), (true, true))
SELECT 'tier.repos' AS metric, 'tier=' || spine.tier AS labels, CAST(count(du.tier) AS DOUBLE) AS value FROM spine LEFT JOIN du ON spine.tier = du.tier GROUP BY spine.tier
UNION ALL SELECT 'pending.repos', 'forced=' || four.forced || ',is_excluded=' || four.is_excluded, CAST(count(id) AS DOUBLE) FROM four LEFT JOIN (SELECT * FROM repos WHERE status = 'pending') p ON (p.excluded <> 0) = four.is_excluded AND (p.force_category <> '') = four.forced GROUP BY four.is_excluded, four.forced
UNION ALL SELECT 'events.filtered', 'kept=' || ({_KEPT}), CAST(count(*) AS DOUBLE) FROM repo_events GROUP BY ({_KEPT})
UNION ALL SELECT 'fallback.trips', '', CAST(count(*) FILTER (WHERE stars <> 0 AND status = 'active' AND CAST(forks AS DOUBLE) / CAST(nullif(stars, 0) AS DOUBLE) < 0.25::DOUBLE) AS DOUBLE) FROM repos
UNION ALL SELECT 'batch.fallback', 'result=' || CASE WHEN last_collected_s IS NULL THEN 'failed' ELSE 'success' END, CAST(count(*) AS DOUBLE) FROM repos GROUP BY last_collected_s IS NULL
UNION ALL SELECT 'dedup.ratio', '', CAST(count(*) FILTER (WHERE full_name IN (SELECT full_name FROM tracked)) AS DOUBLE) / CAST(count(*) AS DOUBLE) FROM candidates
UNION ALL SELECT 'lag.seconds', '', CAST({{NOW}} - max(EPOCH(hour)) AS DOUBLE) FROM repo_events
UNION ALL SELECT 'repos.gone', '', CAST(count(*) FILTER (WHERE excluded <> 0) AS DOUBLE) FROM repos""")
def _(t):
    kept = t.repo_events.select(ev.kept().alias("kept")).groupBy("kept").agg(F.count(F.lit(1)).alias("n"))
    known = t.tracked.select("full_name").distinct().withColumn("known", F.lit(True))
    flagged = t.candidates.join(known, "full_name", "left").agg((x.double(F.count("known")) / x.double(F.count(F.lit(1)))).alias("ratio"))
    trips = t.repos.filter("stars <> 0").agg(F.count_if(x.falls_back(F.col("status") == "active", F.col("stars"), F.col("forks"))).alias("n"))
    assigned = tiers.assign(t.repos.select("full_name", "growth_score", "first_seen_s", "last_collected_s"), NOW)
    points = health.all_health_points({
        "tier.repos": tiers.histogram(assigned), "pending.repos": r.pending_buckets(t.repos), "events.filtered": kept, "fallback.trips": trips,
        "batch.fallback": t.repos.groupBy(F.when(F.col("last_collected_s").isNull(), "failed").otherwise("success").alias("result")).agg(F.count(F.lit(1)).alias("n")),
        "dedup.ratio": flagged, "lag.seconds": t.repo_events.agg((F.lit(NOW) - F.unix_timestamp(F.max("hour"))).alias("lag_s")), "repos.gone": t.repos.agg(F.count_if(F.col("excluded") != 0).alias("n")),
    })
    labels = F.array_join(F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return points.select("metric", labels.alias("labels"), "value")


@query("f21b_tracked_lookup", """WITH e AS (SELECT lower(trim(full_name)) AS low, arg_min(full_name, pos) AS entry FROM tracked GROUP BY 1)
SELECT r.full_name, e.entry, e.entry IS NOT NULL AS is_tracked FROM (SELECT CASE WHEN id % 2 = 0 THEN upper(full_name) ELSE full_name END AS full_name FROM repos) r LEFT JOIN e ON lower(trim(r.full_name)) = e.low""")
def _(t):
    names = t.repos.select(F.when(F.col("id") % 2 == 0, F.upper("full_name")).otherwise(F.col("full_name")).alias("full_name"))
    return scans.tracked_lookup(names, t.tracked)


@query("r12_star_cache", """WITH u AS (SELECT full_name, stars, observed_s FROM star_obs UNION ALL SELECT full_name, stars + 3, {NOW} - 3600 FROM repos WHERE id % 5 = 0),
l AS (SELECT full_name, max(observed_s) AS observed_s FROM u GROUP BY 1)
SELECT u.full_name, max(u.stars) AS stars, u.observed_s FROM u JOIN l ON u.full_name = l.full_name AND u.observed_s = l.observed_s WHERE {NOW} - u.observed_s < 7 * 86400 GROUP BY 1, 3""")
def _(t):
    seen = t.repos.filter("id % 5 = 0").select("full_name", (F.col("stars") + 3).alias("stars"), F.lit(NOW - 3600).cast("long").alias("observed_s"))
    return scans.star_cache(t.star_obs, seen, NOW)


@query("c5_collect_and_apply", """WITH b AS (SELECT full_name, max(stars) AS stars, max(forks) AS forks FROM snapshots GROUP BY 1),
m AS (SELECT repo_name, count(*) FILTER (WHERE type = 'WatchEvent') AS s, count(*) FILTER (WHERE type = 'ForkEvent') AS f FROM repo_events GROUP BY 1)
SELECT b.full_name, CASE WHEN hash_free THEN b.stars ELSE m.s END AS stars, CASE WHEN hash_free THEN b.forks ELSE m.f END AS forks, CAST(m.s AS DOUBLE) / 30.0::DOUBLE AS star_velocity
FROM (SELECT *, forks % 2 = 0 AS hash_free FROM b) b JOIN m ON b.full_name = m.repo_name""")
def _(t):
    before = t.snapshots.groupBy("full_name").agg(F.max("stars").alias("stars"), F.max("forks").alias("forks"))
    found = scans.collect_from_events(t.repo_events, before.select(F.col("full_name").alias("repo_name")), 720)
    rows = found.select(F.col("repo_name").alias("full_name"), "stars", "forks", F.col("stars_per_day").alias("star_velocity"), "partial")
    return scans.apply_partial(rows, before.filter("forks % 2 = 0"), ["stars", "forks"]).drop("partial")


@query("d2_plugged_classifier", """WITH q AS (SELECT repos.id, full_name FROM repos WHERE excluded = 0 AND force_category = '' AND (primary_category = '' OR status IN ('needs_reclassify', 'needs_review') OR (status = 'pending' AND classified_at = '')))
SELECT full_name, 'testing' AS category, CASE WHEN length(full_name) % 2 = 0 THEN 0.9::DOUBLE ELSE 0.4::DOUBLE END AS confidence, CASE WHEN length(full_name) % 2 = 0 THEN 'active' ELSE 'needs_review' END AS status FROM q""")
def _(t):
    def model(batches):
        for b in batches:
            yield b.assign(category="testing", confidence=b["full_name"].str.len().mod(2).map({0: 0.9, 1: 0.4}))[["full_name", "category", "confidence"]]

    readmes = t.repos.select("id", "full_name").join(t.readmes, "id").select("full_name", "content")
    return classification.classify(t.repos, readmes, classifier=model).select("full_name", "category", "confidence", "status")
