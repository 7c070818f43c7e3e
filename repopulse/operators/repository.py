"""Queries and maintenance of the repos table, its taxonomy and the tracked list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..functions import taxonomy
from ..sources.tables import update_where

REFUSED = "backfill_legacy_other"


def needs_classification() -> Column:
    late = F.col("status").isin("needs_reclassify", "needs_review") | ((F.col("status") == "pending") & (F.col("classified_at") == ""))
    return (F.col("excluded") == 0) & (F.col("force_category") == "") & ((F.col("primary_category") == "") | late)


def classified() -> Column:
    return (F.col("primary_category") != "") & (F.col("status") == "active") & (F.col("force_category") == "") & (F.col("excluded") == 0)


def drift_candidates(repos: DataFrame) -> DataFrame:
    rows = repos.filter((F.col("primary_subcategory") == "other") & (F.col("is_curated_list") == 0) & (F.col("status") == "active"))
    return rows.select("full_name", "primary_category", F.col("category_confidence").alias("confidence"))


def status_counts(repos: DataFrame) -> DataFrame:
    return repos.filter("excluded = 0").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def pending_buckets(repos: DataFrame) -> DataFrame:
    """Pending rows by (excluded, forced); always four rows."""
    spine = repos.sparkSession.createDataFrame([(a, b) for a in (False, True) for b in (False, True)], "is_excluded boolean, forced boolean")
    rows = repos.filter("status = 'pending'").groupBy((F.col("excluded") != 0).alias("is_excluded"), (F.col("force_category") != "").alias("forced"))
    return spine.join(rows.agg(F.count(F.lit(1)).alias("n")), ["is_excluded", "forced"], "left").fillna(0, ["n"])


def scalar_counts(repos: DataFrame) -> DataFrame:
    live = F.col("excluded") == 0
    return repos.agg(
        F.count(F.lit(1)).alias("repos"), F.count_if(live & (F.col("status") == "needs_reclassify")).alias("needs_reclassify"),
        F.count_if(live & (F.col("status") == "active") & (F.col("is_curated_list") == 0)).alias("active_not_curated"),
        F.coalesce(F.max(F.nullif("classified_at", F.lit(""))), F.lit("")).alias("last_classified_at"),
    )


def drainable() -> Column:
    return (
        (F.col("excluded") == 0) & (F.col("status") == "needs_reclassify") & (F.col("primary_category") != "") & (F.col("primary_subcategory") != "")
        & (F.col("primary_category") != "other") & (F.col("needs_review") == 0)
    )


def drain(repos: DataFrame, limit: int = 0) -> DataFrame:
    """Sets drainable rows active; with a limit, the lowest ids only."""
    if limit <= 0:
        return update_where(repos, drainable(), {"status": F.lit("active")})
    chosen = repos.filter(drainable()).orderBy("id").limit(limit).select("id").withColumn("_hit", F.lit(True))
    return update_where(repos.join(chosen, "id", "left"), F.col("_hit"), {"status": F.lit("active")}).drop("_hit")


def drain_report(repos: DataFrame, limit: int = 0) -> DataFrame:
    """Counts of a drain, in one pass."""
    waiting = (F.col("excluded") == 0) & (F.col("status") == "needs_reclassify")
    sink = waiting & (F.col("primary_category") == "other") & (F.col("needs_review") == 1)
    counts = repos.agg(F.count_if(waiting).alias("examined"), F.count_if(sink).alias("held_in_sink"), F.count_if(drainable()).alias("_all"))
    counts = counts.withColumn("drained", F.least("_all", F.lit(limit).cast("long")) if limit > 0 else F.col("_all"))
    rest = F.greatest(F.lit(0).cast("long"), F.col("examined") - F.col("drained") - F.col("held_in_sink"))
    return counts.withColumn("held_other", rest).drop("_all")


def drain_by_category(repos: DataFrame) -> DataFrame:
    counts = repos.filter(drainable()).groupBy(F.col("primary_category").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "category")


def backfill(repos: DataFrame) -> DataFrame:
    """Maps older flat names to pairs where there is no subcategory yet; a second run changes nothing."""
    open_ = F.col("primary_subcategory") == ""
    old = F.col("primary_category")
    category, sub = taxonomy.roll_up(old)
    unknown = open_ & old.isin("other", "")
    return repos.withColumns({
        "primary_category_legacy": F.when(open_, old).otherwise(F.col("primary_category_legacy")),
        "primary_category": F.when(open_, category).otherwise(old),
        "primary_subcategory": F.when(open_, sub).otherwise(F.col("primary_subcategory")),
        "needs_review": F.when(unknown, 1).otherwise(F.col("needs_review")),
        "classification_refusal_reason": F.when(unknown, REFUSED).otherwise(""),
    })


def is_orphan() -> Column:
    return (F.col("excluded") == 0) & ((F.col("primary_category") == "") | (F.col("primary_subcategory") == ""))


def orphan_guard(repos: DataFrame) -> DataFrame:
    """The number of live rows without a pair, as a check that fails the job if it isn't zero."""
    counted = repos.agg(F.count_if(is_orphan()).alias("orphans"))
    guard = F.when(F.col("orphans") > 0, F.raise_error(F.concat(F.lit("rows without a category pair: "), F.col("orphans").cast("string"))))
    return counted.withColumn("orphans", F.coalesce(guard.cast("long"), F.col("orphans")))


def changed_hashes(repos: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows whose readme hash changed get the new hash and go to be classified again; fresh: full_name, hash."""
    rows = repos.join(fresh.select("full_name", F.col("hash").alias("_new")), "full_name", "left")
    changed = classified() & (F.col("readme_hash") != "") & F.col("_new").isNotNull() & (F.col("readme_hash") != F.col("_new"))
    hit = F.coalesce(changed, F.lit(False))
    return rows.withColumns({"status": F.when(hit, "needs_reclassify").otherwise(F.col("status")), "readme_hash": F.when(hit, F.col("_new")).otherwise(F.col("readme_hash"))}).drop("_new")


def store_classification(repos: DataFrame, results: DataFrame, least: float) -> DataFrame:
    """Writes category, confidence and status of classified rows; results: full_name, category, confidence."""
    rows = repos.join(results.select("full_name", F.col("category").alias("_c"), F.col("confidence").alias("_p")), "full_name", "left")
    hit = F.col("_c").isNotNull()
    return rows.withColumns({
        "primary_category": F.when(hit, F.col("_c")).otherwise(F.col("primary_category")),
        "category_confidence": F.when(hit, F.col("_p")).otherwise(F.col("category_confidence")),
        "status": F.when(hit, x.status_of(F.col("_p"), least)).otherwise(F.col("status")),
    }).drop("_c", "_p")


def merge_tracked(tracked: DataFrame) -> DataFrame:
    """Entries that differ in case become one: first spelling, union of categories, 'default' without any."""
    names = F.filter(F.transform(F.split("categories", ";"), lambda c: F.trim(c)), lambda c: c != "")
    rows = tracked.select("full_name", "pos", names.alias("names"))
    merged = rows.groupBy(F.lower("full_name").alias("key")).agg(
        F.min_by("full_name", "pos").alias("full_name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names")
    )
    return merged.select("full_name", F.when(F.size("names") == 0, F.array(F.lit("default"))).otherwise(F.col("names")).alias("categories"))
