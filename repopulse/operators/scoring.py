"""Growth scores over snapshots, normalisation and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..sources.tables import written


def with_previous(snapshots: DataFrame) -> DataFrame:
    """Each snapshot with the one before; ``day`` is in seconds."""
    w = Window.partitionBy("full_name").orderBy("day")
    out = snapshots
    for k in ("stars", "forks", "contributors"):
        out = out.withColumn(f"{k}_prev", F.coalesce(F.lag(k).over(w), F.lit(0)))
    days = x.double(F.col("day") - F.lag("day").over(w)) / F.lit(float(x.DAY))
    out = out.withColumn("days", F.coalesce(days, F.lit(0.0)))
    out = out.withColumn("star_velocity", x.rate(F.col("stars"), F.col("stars_prev"), F.col("days")))
    return out.withColumn("star_velocity_prev", F.coalesce(F.lag("star_velocity").over(w), F.lit(0.0)))


def velocities(rows: DataFrame) -> DataFrame:
    """Velocities and raw score of rows with previous values, days, cadence and weekly counts."""
    out = rows.withColumns({
        "star_velocity": x.rate(F.col("stars"), F.col("stars_prev"), F.col("days")),
        "fork_velocity": x.rate(F.col("forks"), F.col("forks_prev"), F.col("days")),
        "contributor_growth": x.rate(F.col("contributors"), F.col("contributors_prev"), F.col("days")),
        "pr_velocity": x.weekly(F.col("merged_prs_7d")),
        "issue_velocity": x.weekly(F.col("new_issues_7d")),
    })
    return out.withColumn("star_acceleration", F.col("star_velocity") - F.col("star_velocity_prev")).withColumn("raw_score", x.raw_score())


def latest(rows: DataFrame, key: str = "full_name", by: str = "day") -> DataFrame:
    """Last row of each key, as a combined aggregate rather than a sort."""
    return rows.groupBy(key).agg(F.max(F.struct(by, *[c for c in rows.columns if c not in (key, by)])).alias("r")).select(key, "r.*")


def min_max(rows: DataFrame, score: str, within: list[str] | None = None, into: str = "normalized") -> DataFrame:
    """Scores scaled to 0-100 over all rows or within groups; 50 for a single row or equal scores.

    The bounds are one small aggregate that is joined back, so no group meets in one task.
    """
    within = within or []
    bounds = rows.groupBy(*within).agg(F.min(score).alias("_low"), F.max(score).alias("_high"), F.count(F.lit(1)).alias("_n"))
    joined = rows.join(bounds, within) if within else rows.crossJoin(F.broadcast(bounds))  # without groups it is one row
    span = F.col("_high") - F.col("_low")
    scaled = x.two_decimals((F.col(score) - F.col("_low")) / span * F.lit(100.0))
    return joined.withColumn(into, F.when((F.col("_n") == 1) | (span == 0), F.lit(50.0)).otherwise(scaled)).drop("_low", "_high", "_n")


def global_rank(rows: DataFrame, *order: Column, into: str = "rank") -> DataFrame:
    """Position of each row in a total order, from 0, without a single-partition window.

    Rows are range-partitioned by the order and written once with the number of their
    range, so that it stays the same; the sizes of the ranges, one row each, give the
    offset of every range, and a window inside a range does the rest.
    """
    spread = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    ranked = spread.withColumn("_in", inside).join(offsets, "_part")
    return ranked.withColumn(into, (F.col("_before") + F.col("_in")).cast("long")).drop("_part", "_in", "_before")


def percentile(rows: DataFrame, score: str, key: str = "full_name", into: str = "percentile") -> DataFrame:
    """Rank by ascending score over n - 1, times 100; ties are ordered by name; 50 for a single row."""
    ranked = global_rank(rows, F.col(score), F.col(key), into="_rank").crossJoin(F.broadcast(rows.agg((F.count(F.lit(1)) - 1).alias("_last"))))
    value = x.two_decimals(x.double(F.col("_rank")) / x.double(F.col("_last")) * F.lit(100.0))
    return ranked.withColumn(into, F.when(F.col("_last") == 0, F.lit(50.0)).otherwise(value)).drop("_rank", "_last")


def top(rows: DataFrame, n: int, score: str = "normalized", key: str = "full_name") -> DataFrame:
    return rows.orderBy(F.desc(score), key).limit(n)


def release_history(rows: DataFrame, newest: str = "latest_release_at", dates: str = "release_dates", known: str = "release_known_at", keep: int = 10) -> DataFrame:
    """Puts a newly seen release in front of the list and keeps the newest ones."""
    fresh = F.col(newest).isNotNull() & ~F.col(newest).eqNullSafe(F.col(known))
    held = F.coalesce(F.col(dates), F.array().cast("array<timestamp>"))
    return rows.withColumn(dates, F.slice(F.when(fresh, F.concat(F.array(newest), held)).otherwise(held), 1, keep))
