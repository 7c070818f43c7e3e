"""Column functions: predicates, parsing, scores and labels.  No Python runs on executors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
# Event types kept by default, and the score's weights in the order of its terms.
EVENT_TYPES = ["WatchEvent", "ForkEvent", "PushEvent", "PullRequestEvent"]
WEIGHTS = {
    "star_velocity": 2.0, "star_acceleration": 3.0, "fork_velocity": 1.5, "release_cadence": 1.0,
    "contributor_growth": 1.5, "pr_velocity": 1.0, "issue_velocity": 0.5,
}


def double(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def two_decimals(x: Column) -> Column:
    """Rounds half up, as floor(100 x + 0.5) / 100."""
    return F.floor(x * F.lit(100.0) + F.lit(0.5)).cast("double") / F.lit(100.0)


# names

def well_formed(name: Column) -> Column:
    """Exactly one slash with something on both sides."""
    return name.rlike(r"^[^/]+/[^/]+$")


def owner_of(name: Column) -> Column:
    return F.split_part(name, F.lit("/"), F.lit(1))


def name_of(name: Column) -> Column:
    return F.split_part(name, F.lit("/"), F.lit(2))


def parse_repo_id(text: Column) -> Column:
    """owner/repo of an identifier or of a github.com address; null if it is neither."""
    bare = F.regexp_replace(F.trim(text), r"(?i)^(?:https?://)?(?:www\.)?github\.com/", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"/+$", ""), r"\.git$", "")
    bare = F.regexp_extract(bare, r"^([A-Za-z0-9_.\-]+/[A-Za-z0-9_.\-]+)$", 1)
    return F.when(bare != "", bare)


def matches_any_case(name: Column, pattern: Column) -> Column:
    """List dialect: equal or ``owner/*``, letters A-Z in either case."""
    low, want = F.lower(name), F.lower(pattern)
    return (low == want) | (want.endswith("/*") & (owner_of(want) == owner_of(low)) & ~owner_of(want).isin("*", ""))


def matches_case(name: Column, pattern: Column) -> Column:
    """Discovery dialect: each half is equal or ``*``; both need exactly one slash to match by halves."""
    halves = well_formed(name) & well_formed(pattern)
    left = (owner_of(pattern) == "*") | (owner_of(pattern) == owner_of(name))
    right = (name_of(pattern) == "*") | (name_of(pattern) == name_of(name))
    return (name == pattern) | halves & left & right


def valid_pattern(pattern: Column) -> Column:
    """Patterns that an exclusion list takes."""
    p = F.trim(pattern)
    name = r"[A-Za-z0-9_.][A-Za-z0-9_.\-]*"
    return (p != "") & ~p.contains("..") & ~p.rlike(r"^[./~]") & p.rlike(rf"^{name}/({name}|\*)$")


# time

def archive_hour(name: Column) -> Column:
    """Hour of an archive name YYYY-MM-DD-HH[.json.gz]; null if it isn't one."""
    return F.try_to_timestamp(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2}-\d{2})(?:\.json\.gz)?$", 1), F.lit("yyyy-MM-dd-HH"))


def archive_name(hour: Column) -> Column:
    return F.date_format(hour, "yyyy-MM-dd-HH")


def lag_seconds(now_s: int, hour: Column) -> Column:
    return F.lit(now_s).cast("long") - F.unix_timestamp(hour)


def archive_ready(now_s: int, hour: Column) -> Column:
    """An archive is complete 30 minutes after its hour ended."""
    return lag_seconds(now_s, hour) >= 5400


# growth

def rate(now: Column, before: Column, days: Column) -> Column:
    """Change per day; 0 if no time has passed."""
    return F.when(days > 0, double(now - before) / double(days)).otherwise(F.lit(0.0))


def weekly(count: Column) -> Column:
    return double(count) / F.lit(7.0)


def release_cadence(dates: Column, now: Column) -> Column:
    """Releases in the 90 days up to now, per 30 days."""
    recent = F.filter(dates, lambda d: (d <= now) & (d > now - F.expr("INTERVAL 90 DAYS")))
    return F.coalesce(F.size(recent), F.lit(0)).cast("double") / F.lit(3.0)


def raw_score(weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted sum over the columns named in the weights, in their order."""
    terms = [F.col(k) * F.lit(w) for k, w in weights.items()]
    total = terms[0]
    for x in terms[1:]:
        total = total + x
    return total


def estimated_velocity(stars: Column, created_s: Column, updated_s: Column, now_s: int) -> Column:
    """Stars per day of a search result, from its mean rate if it was updated within a week."""
    age = double(F.lit(now_s) - created_s) / F.lit(float(DAY))
    mean = F.when(age > 0, double(stars) / age).otherwise(F.lit(0.0))
    before = F.greatest(F.lit(0).cast("long"), (double(stars) - mean * F.lit(7.0)).cast("long"))
    recent = (F.lit(now_s) - updated_s) < 7 * DAY
    return double(stars - F.when(recent & created_s.isNotNull() & (age > 0), before).otherwise(F.lit(0).cast("long"))) / F.lit(7.0)


def passes_gates(stars: Column, created_s: Column, now_s: int, min_stars: int, max_age_days: int) -> Column:
    """Enough stars, and young enough unless the age is unknown or the limit is 0."""
    young = created_s.isNull() | (F.lit(now_s) - created_s <= max_age_days * DAY) if max_age_days else F.lit(True)
    return (stars >= min_stars) & young


def trend(velocity: Column) -> Column:
    return F.when(velocity > 0, "rising").when(velocity < 0, "declining").otherwise("stable")


# tiers

TIER_HOURS = {"new": 1, "hot": 1, "warm": 4, "cold": 12}
TIER_ORDER = {"new": 0, "hot": 1, "warm": 2, "cold": 3}


def tier(rank: Column, first_seen_s: Column, now_s: int, hot: int = 500, warm: int = 2000, new_hours: int = 48) -> Column:
    by_rank = F.when(rank < hot, "hot").when(rank < warm, "warm").otherwise("cold")
    return F.when(F.lit(now_s) - first_seen_s < new_hours * 3600, "new").otherwise(by_rank)


def by_tier(tier_name: Column, table: dict[str, int]) -> Column:
    out = F.lit(None).cast("long")
    for name, value in table.items():
        out = F.when(tier_name == name, F.lit(value).cast("long")).otherwise(out)
    return out


# classification

def content_hash(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.sha2(text, 256))


def shortened(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars) if chars > 0 else text


def skip_classification(stored: Column, fresh: Column, category: Column) -> Column:
    return (stored != "") & (stored == fresh) & (category != "")


def status_of(confidence: Column, least: float) -> Column:
    return F.when(confidence < F.lit(least), "needs_review").otherwise("active")


def parse_reply(raw: Column, categories: list[str]) -> Column:
    """Struct (category, confidence, reasoning) of a classifier's reply."""
    # a reply that isn't an object parses to a struct of nulls, so the marker field tells
    reply = F.from_json(F.trim(raw), "category string, confidence double, reasoning string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    bad = reply.isNull() | reply["_bad"].isNotNull()
    name = F.lower(F.trim(F.coalesce(reply["category"], F.lit(""))))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(reply["confidence"], F.lit(0.0))))
    return F.struct(
        F.when(bad, "other").when(name.isin(categories), name).otherwise("other").alias("category"),
        F.when(bad, F.lit(0.0)).otherwise(confidence).alias("confidence"),
        F.when(bad, "invalid JSON from LLM").otherwise(F.coalesce(reply["reasoning"], F.lit(""))).alias("reasoning"),
    )


def rendered(template: str, fields: dict[str, Column]) -> Column:
    """A template with ``{field}`` marks filled in; marks without a field stay."""
    parts = re.split(r"(\{\w+\})", template)
    return F.concat(*[fields[p[1:-1]] if p[:1] == "{" and p[1:-1] in fields else F.lit(p) for p in parts if p])


def slug(tokens: Column) -> Column:
    """Subcategory name of a cluster's tokens."""
    parts = F.transform(tokens, lambda x: F.replace(F.lower(F.trim(x)), F.lit(" "), F.lit("-")))
    return F.when(F.size(tokens) == 0, "unknown").otherwise(F.array_join(parts, "-"))


# gates

def pause_reason(queue: Column, limit_pct: Column, daily: Column, max_queue: int = 1000, max_pct: float = 80.0, max_daily: int = 5000) -> Column:
    """First gate that trips, '' if none; a signal that is missing never trips."""
    return (
        F.when(F.coalesce(queue >= max_queue, F.lit(False)), "queue_depth")
        .when(F.coalesce(limit_pct >= F.lit(max_pct), F.lit(False)), "rate_limit")
        .when(F.coalesce(daily >= max_daily, F.lit(False)), "daily_cap")
        .otherwise("")
    )


def cap_state(count: Column, warn: int = 4000, hard: int = 5000) -> Column:
    return F.when(count >= hard, "hard").when(count >= warn, "warn").otherwise("ok")


def falls_back(enabled: Column, limit: Column, remaining: Column, threshold: float = 0.25) -> Column:
    """Whether too little of an API budget is left; an invalid threshold reads as a quarter."""
    share = threshold if 0 < threshold < 1 else 0.25
    return enabled & (limit != 0) & (double(remaining) / double(limit) < F.lit(share))


def used_ratio(limit: Column, remaining: Column) -> Column:
    return F.when(limit != 0, F.greatest(F.lit(0.0), F.lit(1.0) - double(remaining) / double(limit)))


def reset_seconds(reset_s: Column, now_s: int) -> Column:
    """Seconds until a budget is full again, none below 0."""
    return F.greatest(F.lit(0), reset_s - F.lit(now_s))


def listing_status(tracked: Column, excluded: Column, auto: Column) -> Column:
    return F.when(tracked, "tracked").when(excluded, "excluded").when(auto, "auto-track").otherwise("new")


def cut_text(text: Column, width: int = 30) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)


def lag_level(seconds: Column, warning: int = 3600, critical: int = 14400) -> Column:
    return F.when(seconds >= critical, "critical").when(seconds >= warning, "warning").otherwise("ok")
