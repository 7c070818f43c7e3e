"""Scan cycles: what a bulk fetch gave, refreshed state, exported rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..functions import taxonomy
from . import health, scoring, tiers
from .discovery import excluded_any_case
from .events import repo_metrics

WEEK = 7 * x.DAY

#: Gives metrics of repositories (repo_name) over a window of hours: a caller's source, or ``from_archive``.
Collector = Callable[[DataFrame, int], DataFrame]


def from_archive(events: DataFrame) -> Collector:
    """Collector that reads archived events."""
    return lambda repos, hours: repo_metrics(events, repos, hours)


def collect(repos: DataFrame, window_hours: int, collector: Collector) -> DataFrame:
    """Metrics of each requested repository; what a collector doesn't name is missing, its ``partial`` is kept.

    Events tell how counts change, not how large they are, so their results are partial.
    """
    found = collector(repos.select("repo_name").distinct(), window_hours)
    return found if "partial" in found.columns else found.withColumn("partial", F.lit(True))


def collect_from_events(events: DataFrame, repos: DataFrame, window_hours: int) -> DataFrame:
    return collect(repos, window_hours, from_archive(events))


def apply_partial(rows: DataFrame, before: DataFrame, absolutes: list[str], key: str = "full_name") -> DataFrame:
    """Partial rows with the absolute values that stood before, where there are any; other rows as they are."""
    old = before.select(key, *[F.col(c).alias(f"_{c}") for c in absolutes])
    out = rows.join(old, key, "left")
    return out.withColumns({c: F.when(F.col("partial"), F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in absolutes}).drop(*[f"_{c}" for c in absolutes])


def carry_forward(before: DataFrame, fresh: DataFrame, columns: list[str], key: str = "full_name") -> DataFrame:
    """All rows of ``before``, with fresh values where a repository has changed."""
    new = fresh.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_new"))
    out = before.join(new, key, "left")
    return out.withColumns({c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop("_new", *[f"_{c}" for c in columns])


def tracked_lookup(names: DataFrame, tracked: DataFrame, key: str = "full_name") -> DataFrame:
    """Each name with the tracked entry that equals it but for the case of letters (the first one), null without."""
    entries = tracked.groupBy(F.lower(F.trim("full_name")).alias("_low")).agg(F.min_by("full_name", F.struct("pos", "full_name")).alias("entry"))
    out = names.withColumn("_low", F.lower(F.trim(key))).join(entries, "_low", "left").drop("_low")
    return out.withColumn("is_tracked", F.col("entry").isNotNull())


def star_cache(cache: DataFrame, seen: DataFrame, now_s: int, ttl_s: int = WEEK) -> DataFrame:
    """Next version of the star observations (full_name, stars, observed_s): the last one wins, old ones go."""
    rows = cache.select("full_name", "stars", "observed_s").unionByName(seen.select("full_name", "stars", "observed_s"))
    last = rows.groupBy("full_name").agg(F.max(F.struct("observed_s", "stars")).alias("r"))
    return last.select("full_name", "r.stars", "r.observed_s").filter(F.lit(now_s) - F.col("observed_s") < ttl_s)


def recent_activity(rows: DataFrame, now_s: int) -> DataFrame:
    """Merges and new issues of a week from listed rows: full_name, kind, is_pull_request, merged_s, created_s."""
    merged = F.col("is_pull_request") & (F.col("merged_s") > now_s - WEEK)
    opened = ~F.col("is_pull_request") & (F.col("created_s") > now_s - WEEK)  # issue lists hold pull requests too
    return rows.groupBy("full_name").agg(F.count_if(merged).alias("merged_prs_7d"), F.count_if(opened).alias("new_issues_7d"))


def missing_outcomes(rows: DataFrame, errors: DataFrame) -> DataFrame:
    """found, gone or batch_failed for fetched rows (batch, alias, found).

    errors: batch, alias (null: the whole batch), limited.  A missing row is gone, unless
    its alias, or its batch without naming an alias, ran into a resource limit.
    """
    limited = errors.filter("limited")
    by_alias = limited.filter("alias IS NOT NULL").select("batch", "alias").distinct().withColumn("_one", F.lit(True))
    by_batch = limited.filter("alias IS NULL").select("batch").distinct().withColumn("_all", F.lit(True))
    out = rows.join(by_alias, ["batch", "alias"], "left").join(by_batch, "batch", "left")
    failed = F.coalesce("_one", "_all", F.lit(False))
    return out.withColumn("outcome", F.when(F.col("found"), "found").when(failed, "batch_failed").otherwise("gone")).drop("_one", "_all")


def tracked_list(tracked: DataFrame, exclusions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid entries that no pattern of the list dialect excludes, and the invalid ones."""
    parsed = tracked.withColumn("parsed", x.parse_repo_id(F.col("full_name")))
    good = parsed.filter("parsed IS NOT NULL").drop("full_name").withColumnRenamed("parsed", "full_name")
    return good.join(excluded_any_case(good, exclusions), "full_name", "left_anti"), parsed.filter("parsed IS NULL").drop("parsed")


def change_patterns(patterns: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """An exclusion list with valid new patterns and without removed ones."""
    valid = add.filter(x.valid_pattern(F.col("pattern"))).select(F.trim("pattern").alias("pattern"))
    return patterns.select("pattern").union(valid).distinct().join(remove, "pattern", "left_anti")


def scan_path(tiered: Column, canary: Column) -> Column:
    return F.when(canary, "canary").when(tiered, "bulk").otherwise("legacy")


def scan_and_score(current: DataFrame, previous: DataFrame, days: float) -> DataFrame:
    """Scores of collected rows against the state before; one without a state counts from 0 with no time passed."""
    keep = ("stars", "forks", "contributors", "star_velocity")
    before = previous.select("full_name", *[F.col(c).alias(f"{c}_prev") for c in keep], F.lit(days).alias("days"))
    rows = current.select("full_name", "stars", "forks", "contributors", "merged_prs_7d", "new_issues_7d", "release_cadence").join(before, "full_name", "left")
    filled = rows.fillna(0, [f"{c}_prev" for c in keep[:3]]).fillna(0.0, ["star_velocity_prev", "days"])
    return scoring.min_max(scoring.velocities(filled), "raw_score")


def plan_refresh(state: DataFrame, repos: DataFrame, requested: DataFrame, now_s: int) -> DataFrame:
    """Due repositories among the requested ones, in order; first_seen_s comes from the repos table."""
    seen = repos.select("full_name", "first_seen_s")
    rows = state.select("full_name", "growth_score", "last_collected_s").join(seen, "full_name", "left").fillna(0, ["first_seen_s"])
    return tiers.due(tiers.assign(rows, now_s).join(requested.select("full_name").distinct(), "full_name", "left_semi"))


def export_rows(state: DataFrame, repos: DataFrame, configured: DataFrame) -> DataFrame:
    """Category of each exported repository: taxonomy, configured list, pending, default.

    configured: full_name, categories (text).
    """
    resolved = taxonomy.resolve(repos).select("full_name", "category", "subcategory", "status")
    rows = state.select("full_name", "stars").join(resolved, "full_name", "left").join(configured.select("full_name", "categories"), "full_name", "left")
    named = F.when(F.coalesce("category", F.lit("")) != "", F.col("category"))
    listed = F.when(F.coalesce("categories", F.lit("")) != "", F.col("categories"))
    rest = F.when(F.col("status") == "pending", "pending").otherwise("default")
    return rows.select("full_name", "stars", F.coalesce(named, listed, rest).alias("category"), F.coalesce("subcategory", F.lit("")).alias("subcategory"))


def discovery_totals(counters: DataFrame) -> DataFrame:
    return counters.agg(F.sum("new_repos").alias("new_repos"), F.sum("tracked").alias("tracked"))


def batch_signals(rollup: DataFrame, now_s: int) -> DataFrame:
    """Lag and events of ingested hours as metric points."""
    lag = rollup.groupBy("hour").agg(F.sum("event_count").alias("events")).select(F.date_format("hour", "yyyy-MM-dd-HH").alias("archive"), x.lag_seconds(now_s, F.col("hour")).alias("lag_s"), "events")
    return health.health_points("pipeline.lag_seconds", lag, "archive", "lag_s").unionByName(health.health_points("pipeline.events", lag, "archive", "events"))
