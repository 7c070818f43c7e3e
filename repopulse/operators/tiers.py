"""Refresh tiers: rank, interval, due time and order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as x
from .scoring import global_rank


def assign(repos: DataFrame, now_s: int, hot: int = 500, warm: int = 2000, new_hours: int = 48) -> DataFrame:
    """Rank by growth score, tier, interval, due time.  repos: full_name, growth_score, first_seen_s, last_collected_s.

    Only the first ``warm`` ranks matter for the tier, but the due order needs them all.
    """
    rows = global_rank(repos, F.desc("growth_score"), F.col("full_name"))
    rows = rows.withColumn("tier", x.tier(F.col("rank"), F.col("first_seen_s"), now_s, hot, warm, new_hours))
    due = F.col("last_collected_s") + x.by_tier(F.col("tier"), x.TIER_HOURS) * 3600
    return rows.withColumns({"interval_s": x.by_tier(F.col("tier"), x.TIER_HOURS) * 3600, "due_s": due, "is_due": F.coalesce(due <= now_s, F.lit(True))})


def due(assigned: DataFrame) -> DataFrame:
    """Due rows in order: new, hot, warm, cold; inside a tier by rank."""
    return assigned.filter("is_due").orderBy(x.by_tier(F.col("tier"), x.TIER_ORDER), "rank")


def histogram(assigned: DataFrame) -> DataFrame:
    """Rows of each tier, zero where there are none."""
    spine = assigned.sparkSession.createDataFrame([(k,) for k in x.TIER_ORDER], "tier string")
    return spine.join(assigned.groupBy("tier").agg(F.count(F.lit(1)).alias("n")), "tier", "left").fillna(0, ["n"])
