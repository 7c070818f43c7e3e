"""Aggregations over event archives.  ``events``: repo_name, type, hour and more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as x


def kept(types: list[str] | None = None) -> Column:
    return F.coalesce(F.col("type").isin(types or x.EVENT_TYPES) & (F.col("repo_name") != ""), F.lit(False))


def kept_counts(events: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Kept events by type and discarded ones, for each hour."""
    return events.groupBy("hour", "type").agg(F.count_if(kept(types)).alias("kept"), F.count_if(~kept(types)).alias("discarded"))


def rollup_of(cells: DataFrame) -> DataFrame:
    """Hour rollup of counts ``n`` by repository, hour and type."""
    return cells.groupBy("repo_name", "hour").agg(F.sum("n").alias("event_count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("per_type"))


def hour_rollup(events: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Events of each repository and hour, in all and by type (a map)."""
    return rollup_of(events.filter(kept(types)).groupBy("repo_name", "hour", "type").agg(F.count(F.lit(1)).alias("n")))


def cells_with_discarded(events: DataFrame, keep: Column) -> DataFrame:
    """Counts by repository, hour and type; what isn't kept counts under a null repository, in the same pass."""
    named = events.select(F.when(keep, F.col("repo_name")).alias("repo_name"), "hour", F.when(keep, F.col("type")).alias("type"))
    return named.groupBy("repo_name", "hour", "type").agg(F.count(F.lit(1)).alias("n"))


def hour_counts(events: DataFrame, types: list[str] | None = None) -> DataFrame:
    return events.filter(kept(types)).groupBy("repo_name", "hour").agg(F.count(F.lit(1)).alias("event_count"))


def in_window(frame: DataFrame, edge: Column, hours: int) -> DataFrame:
    """Hours of a window that ends at ``edge``, which is the same for all repositories."""
    return frame.filter((F.col("hour") >= edge - F.make_dt_interval(hours=F.lit(hours))) & (F.col("hour") < edge))


def window_totals(rollup: DataFrame, edge: Column, hours: int = 24) -> DataFrame:
    """Total and busiest hour of each repository in the window."""
    return in_window(rollup, edge, hours).groupBy("repo_name").agg(F.sum("event_count").alias("total"), F.max("event_count").alias("peak"))


def window_types(rollup: DataFrame, edge: Column, hours: int = 24) -> DataFrame:
    """Events by type of each repository in the window, summed over the hours' maps."""
    cells = in_window(rollup, edge, hours).select("repo_name", F.explode("per_type").alias("type", "n"))
    return cells.groupBy("repo_name", "type").agg(F.sum("n").alias("n"))


def dominant_type(by_type: DataFrame) -> DataFrame:
    """Most frequent type of each repository; the smallest name on a tie.  Combined before the shuffle."""
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("type")))
    return by_type.groupBy("repo_name").agg(best["type"].alias("dominant_type"))


def active(totals: DataFrame, floor: int = 10) -> DataFrame:
    return totals.filter(F.col("total") >= floor)


def top_active(totals: DataFrame, n: int) -> DataFrame:
    """Most active repositories; all of them if n is not positive."""
    ranked = totals.orderBy(F.desc("total"), "repo_name")
    return ranked.limit(n) if n > 0 else ranked


def hour_series(rollup: DataFrame, edge: Column, hours: int = 24) -> DataFrame:
    """Counts of all hours of the window, oldest first, zeros filled in."""
    start = F.unix_timestamp(edge) - hours * 3600
    slot = ((F.unix_timestamp("hour") - start) / 3600).cast("int")
    held = in_window(rollup, edge, hours).select("repo_name", slot.alias("slot"), "event_count")
    counts = F.map_from_entries(F.collect_list(F.struct("slot", "event_count")))
    series = F.transform(F.sequence(F.lit(0), F.lit(hours - 1)), lambda i: F.coalesce(F.try_element_at("counts", i), F.lit(0)))
    return held.groupBy("repo_name").agg(counts.alias("counts")).select("repo_name", series.alias("hour_counts"))


def sliding_totals(hourly: DataFrame, hours: int = 24) -> DataFrame:
    """Running total of the last hours at each active hour."""
    w = Window.partitionBy("repo_name").orderBy(F.unix_timestamp("hour")).rangeBetween(-(hours - 1) * 3600, 0)
    return hourly.withColumn("window_total", F.sum("event_count").over(w))


def repo_metrics(events: DataFrame, repos: DataFrame, window_hours: int) -> DataFrame:
    """Metrics of requested repositories from events; one without events has zeros.

    Requested names are few against the events, so events are reduced by a semi join
    before they are aggregated; Spark broadcasts the names if they are small.
    """
    wanted = events.join(repos.select("repo_name").distinct(), "repo_name", "left_semi")
    kind = (
        F.when(F.col("type") == "WatchEvent", "star").when(F.col("type") == "ForkEvent", "fork")
        .when((F.col("type") == "PullRequestEvent") & (F.col("action") == "closed") & F.col("merged"), "pr").when((F.col("type") == "IssuesEvent") & (F.col("action") == "opened"), "issue")
    )
    who = F.when(F.col("type").isin("WatchEvent", "ForkEvent"), F.col("actor_login")).otherwise(F.col("number").cast("string"))
    # each different value is one row first, so distinct counts need no copies of the events
    once = wanted.select("repo_name", kind.alias("kind"), who.alias("who")).filter("kind IS NOT NULL").groupBy("repo_name", "kind", "who").agg(F.count(F.lit(1)).alias("n"))

    def times(name: str):
        return F.coalesce(F.sum(F.when(F.col("kind") == name, F.col("n"))), F.lit(0))

    def different(name: str):
        return F.count(F.when(F.col("kind") == name, F.col("who")))

    found = once.groupBy("repo_name").agg(
        times("star").alias("stars"), times("fork").alias("forks"), different("pr").alias("merged_prs"), different("issue").alias("new_issues"),
        different("star").alias("starrers"), different("fork").alias("forkers"),
    )
    numbers = ["stars", "forks", "merged_prs", "new_issues", "starrers", "forkers"]
    out = repos.select("repo_name").distinct().join(found, "repo_name", "left").fillna(0, numbers)
    days = F.lit(max(window_hours / 24.0, 1 / 24.0))
    return out.withColumns({f"{k}_per_day": x.double(F.col(k)) / days for k in ("stars", "forks", "merged_prs", "new_issues")})


def release_dates(events: DataFrame) -> DataFrame:
    """Publication times of each repository, in order and with repeats."""
    published = events.filter((F.col("type") == "ReleaseEvent") & (F.col("action") == "published"))
    return published.groupBy("repo_name").agg(F.sort_array(F.collect_list("created_at")).alias("release_dates"))


def latest_releases(events: DataFrame, n: int = 10) -> DataFrame:
    """The newest publication times of each repository, newest first.  Cut before the shuffle, so a busy one costs no more."""
    published = events.filter((F.col("type") == "ReleaseEvent") & (F.col("action") == "published")).select("repo_name", "created_at")
    nth = F.row_number().over(Window.partitionBy("repo_name").orderBy(F.desc("created_at")))
    top = published.withColumn("nth", nth).filter(F.col("nth") <= n)
    return top.groupBy("repo_name").agg(F.sort_array(F.collect_list("created_at"), asc=False).alias("release_dates"))


def release_cadence(events: DataFrame, edge: Column, days: int = 90) -> DataFrame:
    """Releases a month over the last days; a repository without any in that time has 0."""
    published = events.filter((F.col("type") == "ReleaseEvent") & (F.col("action") == "published"))
    recent = (F.col("created_at") <= edge) & (F.col("created_at") > edge - F.make_dt_interval(days=F.lit(days)))
    return published.groupBy("repo_name").agg((x.double(F.count_if(recent)) / F.lit(days / 30.0)).alias("cadence"))


def requested_share(events: DataFrame, repos: DataFrame) -> DataFrame:
    """How many events belong to requested repositories, and how many don't."""
    known = repos.select("repo_name").distinct().withColumn("known", F.lit(True))
    return events.join(known, "repo_name", "left").agg(F.count_if(F.col("known")).alias("kept"), F.count_if(F.col("known").isNull()).alias("discarded"))


def actor_sketches(events: DataFrame, lg_k: int = 12) -> DataFrame:
    """HyperLogLog sketches of those who star and fork, for each repository and hour."""
    def sketch(kind: str, name: str) -> Column:
        return F.hll_sketch_agg(F.when(F.col("type") == kind, F.col("actor_login")), lg_k).alias(name)

    return events.groupBy("repo_name", "hour").agg(sketch("WatchEvent", "starrers"), sketch("ForkEvent", "forkers"))


def distinct_actors(sketches: DataFrame) -> DataFrame:
    """Distinct starrers and forkers of each repository over any hours: sketches are united, events aren't read again."""
    return sketches.groupBy("repo_name").agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in ("starrers", "forkers")])
