"""The discovery funnel: candidates from several sources to auto-tracked repositories.

Candidates: source, step_ord, pos, full_name, owner, name, language, topics_text, stars,
forks, created_s, updated_s, pushed_s.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as x
from .scoring import min_max

SEARCH_LIMIT = 100


def by_topic(candidates: DataFrame, topics: DataFrame, min_stars: int, created_after_s: int) -> DataFrame:
    """Best 100 by stars for each topic; topics(topic)."""
    found = candidates.withColumn("topic", F.explode(F.array_distinct(F.split("topics_text", " ")))).join(topics, "topic")
    found = found.filter((F.col("stars") >= min_stars) & (F.col("created_s") >= created_after_s))
    return _first(found, "topic", F.desc("stars"))


def by_owner(candidates: DataFrame, owners: DataFrame, min_stars: int, created_after_s: int) -> DataFrame:
    """Repositories of organisations with enough stars; owners(owner, min_stars), 0 for the general bound."""
    wanted = owners.select("owner", F.coalesce(F.nullif("min_stars", F.lit(0)), F.lit(min_stars)).alias("bound"))
    found = candidates.join(wanted, "owner").filter((F.col("stars") >= F.col("bound")) & (F.col("created_s") >= created_after_s))
    return _first(found.drop("bound"), "owner", F.desc("stars"))


def by_language(candidates: DataFrame, languages: DataFrame, windows: list[int], min_stars: int, now_s: int) -> DataFrame:
    """Last updated 100 for each language and push window; languages(language)."""
    found = candidates.join(languages, "language").filter(F.col("stars") >= min_stars)
    found = found.withColumn("push_days", F.explode(F.array(*[F.lit(d) for d in windows])))
    found = found.filter(F.col("pushed_s") >= F.lit(now_s) - F.col("push_days") * x.DAY)
    found = found.withColumn("step", F.concat(F.lower("language"), F.lit("/pushed-"), F.col("push_days").cast("string"), F.lit("d")))
    return _first(found, "step", F.desc("updated_s"))


#: Order of the sources in a search plan.
STEPS = {"topic": 1, "org": 2, "language": 3, "events": 4}


def step_label(source: Column, topic: Column, owner: Column, language: Column, days: int) -> Column:
    """Name of a search step: what its source is asked for."""
    pushed = F.concat(F.lower(language), F.lit(f"/pushed-{days}d"))
    return F.when(source == "topic", topic).when(source == "org", owner).when(source == "language", pushed).otherwise(source)


def search_plan(rows: DataFrame) -> DataFrame:
    """Steps with their source's place in the plan and the rows that they found; rows: source, label."""
    place = F.create_map(*[F.lit(v) for kv in STEPS.items() for v in kv])
    return rows.groupBy("source", "label").agg(F.count(F.lit(1)).alias("found")).withColumn("step_ord", place[F.col("source")])


def _first(found: DataFrame, group: str, order) -> DataFrame:
    """The search limit; Spark cuts each partition to it before the shuffle."""
    w = Window.partitionBy(group).orderBy(order, "full_name")
    return found.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= SEARCH_LIMIT)


def excluded_names(names: DataFrame, exclusions: DataFrame, key: str = "full_name") -> DataFrame:
    """Names that a pattern matches (case-sensitive dialect): one equi-join on name, owner, repository or all."""
    def keyed(*keys):
        return F.explode(F.filter(F.array(*[F.when(ok, F.struct(F.lit(kind).alias("kind"), k.alias("k"))) for kind, k, ok in keys]), lambda e: e.isNotNull())).alias("_e")

    c, p, star = F.col(key), F.col("pattern"), F.lit("*")
    fit = x.well_formed(c)
    n = names.select(key).distinct().select(key, keyed(("name", c, F.lit(True)), ("owner", x.owner_of(c), fit), ("repo", x.name_of(c), fit), ("all", F.lit(""), fit)))
    owner, name, ok = x.owner_of(p), x.name_of(p), x.well_formed(p)
    e = exclusions.select("pattern").distinct().select(keyed(
        ("name", p, F.lit(True)), ("owner", owner, ok & (name == star) & (owner != star)), ("repo", name, ok & (owner == star) & (name != star)), ("all", F.lit(""), p == "*/*"),
    ))
    return n.join(e, "_e", "left_semi").select(key).distinct()


def excluded_any_case(names: DataFrame, exclusions: DataFrame, key: str = "full_name") -> DataFrame:
    """Names that a pattern matches in the list dialect: equal, or by owner."""
    n = names.select(key, F.lower(key).alias("_low"), x.owner_of(F.lower(key)).alias("_owner")).distinct()
    p = exclusions.select(F.lower("pattern").alias("p")).distinct()
    owners = p.filter(F.col("p").rlike(r"^[^/*]+/\*$")).select(x.owner_of(F.col("p")).alias("po"))
    exact = n.join(p, n["_low"] == p["p"], "left_semi").select(key)
    return exact.union(n.join(owners, n["_owner"] == owners["po"], "left_semi").select(key)).distinct()


def flagged(candidates: DataFrame, tracked: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Candidates with the flags already_tracked and is_excluded."""
    known = tracked.select("full_name").distinct().withColumn("already_tracked", F.lit(True))
    banned = excluded_names(candidates, exclusions).withColumn("is_excluded", F.lit(True))
    out = candidates.join(known, "full_name", "left").join(banned, "full_name", "left")
    return out.fillna(False, ["already_tracked", "is_excluded"])


def scored(candidates: DataFrame, now_s: int) -> DataFrame:
    """Estimated growth score of search results: forks start from 0, a week has passed."""
    velocity = x.estimated_velocity(F.col("stars"), F.col("created_s"), F.col("updated_s"), now_s)
    fork = x.double(F.col("forks")) / F.lit(7.0)
    score = velocity * F.lit(x.WEIGHTS["star_velocity"]) + velocity * F.lit(x.WEIGHTS["star_acceleration"]) + fork * F.lit(x.WEIGHTS["fork_velocity"])
    return candidates.withColumns({"star_velocity": velocity, "fork_velocity": fork, "raw_score": score})


def discover(candidates: DataFrame, tracked: DataFrame, exclusions: DataFrame, now_s: int, min_stars: int = 50, max_age_days: int = 365, threshold: float = 50.0) -> DataFrame:
    """Flags, gates, scores and normalises candidates source by source, and marks what to track."""
    rows = flagged(candidates, tracked, exclusions).filter(x.passes_gates(F.col("stars"), F.col("created_s"), now_s, min_stars, max_age_days))
    rows = min_max(scored(rows, now_s), "raw_score", ["source"])
    auto = ~F.col("already_tracked") & ~F.col("is_excluded") & (F.col("normalized") >= F.lit(threshold))
    return rows.withColumn("auto_track", auto)


def first_source(rows: DataFrame, key: str = "full_name") -> DataFrame:
    """One row of each repository: the earliest source, then position.  A combined minimum, not a sort."""
    rest = [c for c in rows.columns if c not in (key, "step_ord", "pos")]
    best = F.min_by(F.struct("step_ord", "pos", *rest), F.struct("step_ord", "pos"))
    return rows.groupBy(key).agg(best.alias("r")).select(key, "r.*")


def source_counters(rows: DataFrame, min_stars: int, max_age_days: int, now_s: int) -> DataFrame:
    """Counters of each source over flagged candidates."""
    ok = x.passes_gates(F.col("stars"), F.col("created_s"), now_s, min_stars, max_age_days)
    fresh = ok & ~F.col("already_tracked") & ~F.col("is_excluded")
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("total_found"), F.count_if(ok).alias("after_filters"), F.count_if(fresh).alias("new_repos"),
        F.count_if(F.col("already_tracked")).alias("tracked"), F.count_if(F.col("is_excluded")).alias("excluded"),
    )


def prefilter(candidates: DataFrame, star_obs: DataFrame, gate: int, ttl_s: int, now_s: int) -> DataFrame:
    """Drops candidates whose star count was seen lately and is below the gate; unknown or old counts pass."""
    seen = star_obs.select("full_name", F.col("stars").alias("_seen"), "observed_s")
    age = F.lit(now_s) - F.col("observed_s")
    low = F.coalesce((age >= 0) & (age < ttl_s) & (F.col("_seen") < gate), F.lit(False))
    return candidates.join(seen, "full_name", "left").filter(~low).drop("_seen", "observed_s")


def cap_running(rows: DataFrame, cap: int, order: list[str]) -> DataFrame:
    """Rows in order until their number reaches the cap; a top-k, so no global window is needed."""
    return rows.orderBy(*order).limit(cap)


def from_events(
    totals: DataFrame, tracked: DataFrame, exclusions: DataFrame, metadata: DataFrame, star_obs: DataFrame, now_s: int,
    floor: int = 10, top_n: int = 500, star_gate: int = 0, ttl_s: int = 7 * x.DAY, max_age_days: int = 365, cap: int = 5000,
) -> DataFrame:
    """Candidates from window totals: known and excluded names are dropped, cheap filters come before the metadata join."""
    rows = totals.filter(F.col("total") >= floor).orderBy(F.desc("total"), "repo_name").limit(top_n).withColumnRenamed("repo_name", "full_name")
    rows = rows.filter(x.well_formed(F.col("full_name"))).join(tracked.select("full_name"), "full_name", "left_anti")
    rows = rows.join(excluded_names(rows, exclusions), "full_name", "left_anti")
    rows = prefilter(rows, star_obs, star_gate, ttl_s, now_s) if star_gate else rows
    rows = rows.join(metadata.select("full_name", "stars", "updated_s"), "full_name")
    rows = rows.filter(F.col("stars") >= star_gate) if star_gate else rows
    rows = rows.filter(F.col("updated_s").isNull() | (F.lit(now_s) - F.col("updated_s") <= max_age_days * x.DAY))
    rows = cap_running(rows, cap, [F.desc("total"), F.col("full_name")]).withColumn("raw_score", x.double(F.col("total")))
    return min_max(rows, "raw_score")
