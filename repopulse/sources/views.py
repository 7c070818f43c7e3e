"""Domain tables over the star-schema test tables.

The SQL text is shared by Spark and by the oracle, so both read the same rows.  Three
macros differ between the dialects: ``EPOCH(ts)`` seconds since 1970, ``TS(seconds)``
and ``JSON(text, key)``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")

#: The clock of all queries: 2024-01-31 00:00:00 UTC.
NOW = 1_706_659_200
DAY = 86_400

_F = "CAST({} AS DOUBLE)".format
_S = "CAST({} AS VARCHAR(20))".format

VIEWS = {
    "repo_events": f"""
SELECT event_id, CAST(ts AS TIMESTAMP) AS created_at, EPOCH(ts) AS created_s, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour,
  concat('org', {_S("user_id % 7")}, '/repo', {_S("user_id")}) AS repo_name,
  CASE event_type WHEN 'view' THEN 'WatchEvent' WHEN 'signup' THEN 'ForkEvent' WHEN 'click' THEN 'PushEvent'
    WHEN 'purchase' THEN 'PullRequestEvent' ELSE CASE WHEN event_id % 2 = 0 THEN 'IssuesEvent' ELSE 'ReleaseEvent' END END AS type,
  concat('u', {_S("event_id % 97")}) AS actor_login, CAST(JSON(props, k) AS BIGINT) AS number,
  CASE WHEN event_type = 'purchase' AND value >= 20 THEN 'closed' WHEN event_type = 'error' AND event_id % 2 = 1 THEN 'published' ELSE 'opened' END AS action,
  value >= 40 AS merged
FROM events""",
    "repos": f"""
SELECT p_partkey AS id, concat('org', {_S("p_partkey % 50")}, '/', replace(p_name, ' ', '-'), '-', {_S("p_partkey")}) AS full_name,
  concat('org', {_S("p_partkey % 50")}) AS owner, concat(replace(p_name, ' ', '-'), '-', {_S("p_partkey")}) AS name,
  concat('A ', p_name, ' made for ', lower(p_type), ' use') AS description,
  CASE p_partkey % 5 WHEN 0 THEN 'Go' WHEN 1 THEN 'Rust' WHEN 2 THEN 'Python' WHEN 3 THEN 'C++' ELSE '' END AS language,
  CASE WHEN p_partkey % 5 <> 0 THEN concat(p_name, ' ', split_part(p_name, ' ', 1), '-kit') ELSE p_name END AS topics_text,
  CAST((p_partkey * 37) % 5000 AS BIGINT) AS stars, CAST((p_partkey * 31) % 4700 AS BIGINT) AS stars_prev,
  CAST((p_partkey * 11) % 900 AS BIGINT) AS forks, CAST(p_partkey % 120 AS BIGINT) AS contributors, CAST(p_partkey % 90 AS BIGINT) AS contributors_prev,
  {_F("(p_partkey * 7919) % 10007")} / {_F(100)} AS growth_score, {_F("p_partkey % 31")} AS star_velocity,
  CAST(p_partkey % 9 AS BIGINT) AS merged_prs_7d, CAST(p_partkey % 14 AS BIGINT) AS new_issues_7d,
  {NOW} - CAST(p_partkey % 200 AS BIGINT) * 3600 AS first_seen_s,
  CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE {NOW} - CAST(p_partkey % 15 AS BIGINT) * 3600 END AS last_collected_s,
  CASE p_partkey % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'needs_reclassify' WHEN 2 THEN 'needs_review' ELSE 'active' END AS status,
  CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS excluded,
  CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'ai-agents' WHEN 2 THEN 'kubernetes' WHEN 3 THEN 'ai' WHEN 4 THEN 'cloud-native' WHEN 5 THEN 'other'
    WHEN 6 THEN 'service-mesh' WHEN 7 THEN 'data' ELSE 'web' END AS primary_category,
  CASE WHEN p_partkey % 9 IN (3, 4, 7, 8) THEN CASE p_partkey % 4 WHEN 0 THEN 'other' WHEN 1 THEN 'agents' WHEN 2 THEN 'kubernetes' ELSE 'databases' END
    WHEN p_partkey % 9 = 1 AND p_partkey % 2 = 0 THEN 'rag' ELSE '' END AS primary_subcategory,
  CASE WHEN p_partkey % 17 = 0 THEN 'kubernetes' ELSE '' END AS force_category, '' AS force_subcategory,
  CASE WHEN p_partkey % 6 = 0 THEN 'rag' ELSE '' END AS primary_category_legacy,
  {_F("p_partkey % 101")} / {_F(100)} AS category_confidence,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('h', {_S("p_partkey % 10")}) END AS readme_hash,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('2024-01-', lpad({_S("p_partkey % 28 + 1")}, 2, '0'), 'T00:00:00Z') END AS classified_at,
  CASE WHEN p_partkey % 9 = 5 AND p_partkey % 2 = 0 THEN 1 ELSE 0 END AS needs_review, CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS is_curated_list
FROM part""",
    "candidates": f"""
SELECT source, step_ord, id AS pos, full_name, owner, name, description, language, topics_text, stars, forks,
  CASE WHEN id % 19 = 0 THEN NULL ELSE {NOW} - CAST(id % 400 AS BIGINT) * {DAY} END AS created_s,
  {NOW} - CAST(id % 14 AS BIGINT) * {DAY} - 3600 AS updated_s, {NOW} - CAST(id % 20 AS BIGINT) * {DAY} AS pushed_s
FROM (SELECT 'topic' AS source, 1 AS step_ord, repos.* FROM repos WHERE id % 2 = 0
  UNION ALL SELECT 'org' AS source, 2 AS step_ord, repos.* FROM repos WHERE id % 3 = 0
  UNION ALL SELECT 'language' AS source, 3 AS step_ord, repos.* FROM repos WHERE id % 5 = 0) AS found""",
    "tracked": """
SELECT full_name, id AS pos, CASE WHEN id % 2 = 0 THEN 'infra;tools' ELSE '' END AS categories FROM repos WHERE id % 11 = 0
UNION ALL SELECT upper(full_name) AS full_name, id + 1000000000 AS pos, 'cloud' AS categories FROM repos WHERE id % 33 = 0""",
    "exclusions": f"""
SELECT full_name AS pattern FROM repos WHERE id % 97 = 5
UNION ALL SELECT concat('org', {_S("n_nationkey")}, '/*') AS pattern FROM nation WHERE n_nationkey % 8 = 0
UNION ALL SELECT concat('*/', name) AS pattern FROM repos WHERE id % 211 = 7
UNION ALL SELECT concat('ORG', {_S("n_nationkey")}, '/*') AS pattern FROM nation WHERE n_nationkey % 8 = 3
UNION ALL SELECT concat('../', n_name) AS pattern FROM nation WHERE n_nationkey % 8 = 5""",
    "star_obs": f"SELECT full_name, CAST(id % 150 AS BIGINT) AS stars, {NOW} - CAST(id % 12 AS BIGINT) * {DAY} AS observed_s FROM repos WHERE id % 3 <> 1",
    "snapshots": """
SELECT repo_name AS full_name, day,
  CAST(sum(stars) OVER w AS BIGINT) AS stars, CAST(sum(forks) OVER w AS BIGINT) AS forks, CAST(sum(actors) OVER w AS BIGINT) AS contributors,
  CAST(sum(prs) OVER w7 AS BIGINT) AS merged_prs_7d, CAST(sum(issues) OVER w7 AS BIGINT) AS new_issues_7d, CAST(sum(releases) OVER w AS BIGINT) AS releases
FROM (SELECT repo_name, created_s - created_s % 86400 AS day, sum(CASE WHEN type = 'WatchEvent' THEN 1 ELSE 0 END) AS stars,
    sum(CASE WHEN type = 'ForkEvent' THEN 1 ELSE 0 END) AS forks, count(DISTINCT actor_login) AS actors,
    sum(CASE WHEN type = 'PullRequestEvent' AND action = 'closed' AND merged THEN 1 ELSE 0 END) AS prs,
    sum(CASE WHEN type = 'IssuesEvent' THEN 1 ELSE 0 END) AS issues, sum(CASE WHEN type = 'ReleaseEvent' THEN 1 ELSE 0 END) AS releases
  FROM repo_events GROUP BY 1, 2) AS daily
WINDOW w AS (PARTITION BY repo_name ORDER BY day), w7 AS (PARTITION BY repo_name ORDER BY day RANGE BETWEEN 518400 PRECEDING AND CURRENT ROW)""",
    "gate_log": f"""
SELECT hour_s, CASE WHEN hour_s / 3600 % 11 = 0 THEN NULL ELSE n * 60 END AS queue_depth,
  CASE WHEN hour_s / 3600 % 13 = 0 THEN NULL ELSE CAST(worth % 100 AS DOUBLE) END AS rate_limit_pct, n AS emitted
FROM (SELECT EPOCH(date_trunc('hour', ts)) AS hour_s, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS worth FROM events GROUP BY 1) AS hourly""",
    "readmes": "SELECT doc_id AS id, coalesce(text, '') AS content FROM documents",
    "responses": f"""
SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN concat('{{"category": " Kubernetes ", "confidence": ', {_S("quality")}, '.7, "reasoning": "r"}}')
  WHEN 1 THEN 'not json' WHEN 2 THEN '{{"category": "pizza", "confidence": 0.4, "reasoning": "x"}}' WHEN 3 THEN '{{"category": "rag", "confidence": -1, "reasoning": ""}}'
  ELSE concat('{{"category": "testing", "confidence": 0.', {_S("doc_id % 9")}, ', "reasoning": "t"}}') END AS raw
FROM labels""",
}
_NEEDS = {name: [x for x in VIEWS if re.search(rf"\b(?:FROM|JOIN) {x}\b", sql)] for name, sql in VIEWS.items()}


def _macros(sql: str, spark: bool) -> str:
    for name, here, there in (
        ("EPOCH", r"unix_timestamp(CAST(\1 AS TIMESTAMP))", r"CAST(floor(epoch(\1)) AS BIGINT)"),
        ("TS", r"timestamp_seconds(\1)", r"make_timestamp(CAST(\1 AS BIGINT) * 1000000)"),
        ("JSON", r"get_json_object(\1)", r"json_extract_string(\1)"),
    ):
        pattern = rf"\b{name}\(((?:[^()]|\([^()]*\))*)\)"
        if name == "JSON":
            sql = re.sub(r"\bJSON\((\w+), (\w+)\)", (r"get_json_object(\1, '$.\2')" if spark else r"json_extract_string(\1, '$.\2')"), sql)
        else:
            sql = re.sub(pattern, here if spark else there, sql)
    return sql.replace("hour_s / 3600 %", "CAST(hour_s / 3600 AS BIGINT) %")


def _ordered(names: list[str]) -> list[str]:
    out: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS[name]:
            add(x)
        if name not in out:
            out.append(name)

    for name in names:
        add(name)
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table as a DataFrame; nothing is registered in the session."""
    names = _ordered([name])
    used = [t for t in BASE if any(re.search(rf"\b(?:FROM|JOIN) {t}\b", VIEWS[n]) for n in names)]
    ctes = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in used]
    ctes += [f"{n} AS ({_macros(VIEWS[n], True)})" for n in names]
    return spark.sql(f"WITH {', '.join(ctes)} SELECT * FROM {name}")


def oracle(sql: str) -> str:
    """Oracle SQL with the domain tables it names in front."""
    names = _ordered([n for n in VIEWS if re.search(rf"\b(?:FROM|JOIN) {n}\b", sql)])
    ctes = ", ".join(f"{n} AS ({_macros(VIEWS[n], False)})" for n in names)
    sql = _macros(sql, False).strip()
    if not ctes:
        return sql
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {sql[15:]}"
    return f"WITH {ctes}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {ctes} {sql}"
