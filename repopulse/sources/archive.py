"""Readers: hourly event archives, state files, search results, nested repository pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as x

MAX_LINE = 8 * 1024 * 1024

EVENT = "type string, repo struct<name:string>, _bad string"
EVENT_WITH_PAYLOAD = "type string, repo struct<name:string>, actor struct<login:string>, created_at string, payload string, _bad string"
PAYLOADS = {
    "PullRequestEvent": "action string, number bigint, pull_request struct<merged:boolean,merged_at:string,state:string>",
    "IssuesEvent": "action string, number bigint",
    "ReleaseEvent": "action string, release struct<published_at:string,tag_name:string>",
}


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of archives (gzip NDJSON, one file an hour) with the hour of their file."""
    return spark.read.text(path).select("value", x.archive_hour(F.col("_metadata.file_name")).alias("hour"))


def parse_events(lines: DataFrame, payloads: bool = False) -> DataFrame:
    """Events of archive lines.  Blank lines vanish; a malformed line, one that is too long,
    one of another shape or one without a repository name has ``ok`` false."""
    value = F.col("value")
    schema = EVENT_WITH_PAYLOAD if payloads else EVENT
    short = F.length(value) <= MAX_LINE
    rows = lines.filter(F.trim(value) != "").withColumn("e", F.from_json(F.when(short, value), schema, {"columnNameOfCorruptRecord": "_bad"}))
    name = F.coalesce(F.col("e.repo.name"), F.lit(""))
    ok = short & F.col("e").isNotNull() & F.col("e._bad").isNull() & (name != "")
    more = []
    if payloads:
        pr, issue, release = (F.when(F.col("e.type") == k, F.from_json("e.payload", s)) for k, s in PAYLOADS.items())
        more = [
            F.col("e.actor.login").alias("actor_login"), x_time(F.col("e.created_at")).alias("created_at"),
            F.coalesce(pr["action"], issue["action"], release["action"]).alias("action"), F.coalesce(pr["number"], issue["number"]).alias("number"),
            F.coalesce(pr["pull_request"]["merged"], F.lit(False)).alias("merged"), x_time(release["release"]["published_at"]).alias("published_at"),
        ]
    return rows.select("hour", F.coalesce(ok, F.lit(False)).alias("ok"), F.col("e.type").alias("type"), name.alias("repo_name"), *more)


def x_time(text):
    """RFC 3339 time, null if it can't be read."""
    return F.try_to_timestamp(text)


def archive_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of the archive files that were read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def hours_to_read(spark: SparkSession, cursor_s: int | None, now_s: int, window_hours: int = 24) -> DataFrame:
    """Hours after the cursor (or of the window without one) whose archives are complete."""
    last = (now_s - 5400) // 3600 * 3600
    first = cursor_s + 3600 if cursor_s is not None else (now_s - window_hours * 3600) // 3600 * 3600
    return spark.range(first, last + 1, 3600).select(F.timestamp_seconds("id").alias("hour"))


def fallback_hours(spark: SparkSession, now_s: int, window_hours: float) -> DataFrame:
    """The current hour and those before it, as many as the window has, one at least."""
    n = max(int(window_hours), 1)
    top = now_s // 3600 * 3600
    return spark.range(0, n).select(F.timestamp_seconds(F.lit(top) - F.col("id") * 3600).alias("hour"))


STATE = (
    "repos map<string,struct<owner:string,name:string,stars:bigint,forks:bigint,contributors:bigint,star_velocity:double,growth_score:double,"
    "last_collected_at:string,recent_release_dates:array<string>>>, star_observations map<string,struct<stars:bigint,observed_at:string>>, "
    "discovery struct<known_repos:map<string,boolean>,topic_scans:map<string,string>,last_scan:string>"
)


def read_state(spark: SparkSession, path: str, one_a_line: bool = False) -> dict[str, DataFrame]:
    """Tables of JSON state: repos (pending), observations, known repositories, topic scans, the last scan (one row).

    A state file is one object; a large state comes as many objects, one a line, which are read in parallel.
    """
    doc = spark.read.schema(STATE).json(path, multiLine=not one_a_line)
    repos = doc.select(F.explode("repos").alias("full_name", "r")).select("full_name", "r.*").withColumn("status", F.lit("pending"))
    seen = doc.select(F.explode("star_observations").alias("full_name", "o")).select("full_name", "o.stars", x_time(F.col("o.observed_at")).alias("observed_at"))
    known = doc.select(F.explode("discovery.known_repos").alias("full_name", "is_known")).filter("is_known").select("full_name")
    scans = doc.select(F.explode("discovery.topic_scans").alias("topic", "at")).select("topic", x_time(F.col("at")).alias("scanned_at"))
    last = doc.agg(F.max(x_time(F.col("discovery.last_scan"))).alias("last_scan"))
    return {"repos": repos, "star_obs": seen, "known": known, "topic_scans": scans, "last_scan": last}


SEARCH = "full_name string, owner struct<login:string>, name string, description string, language string, topics array<string>, stargazers_count bigint, forks_count bigint, created_at string, updated_at string, pushed_at string"


def read_search(spark: SparkSession, path: str) -> DataFrame:
    """Search results; a time that can't be read is null and the row stays."""
    r = spark.read.schema(SEARCH).json(path)
    times = {k: x_time(F.col(k)).alias(k) for k in ("created_at", "updated_at", "pushed_at")}
    return r.select("full_name", F.col("owner.login").alias("owner"), "name", "description", "language", "topics", F.col("stargazers_count").alias("stars"), F.col("forks_count").alias("forks"), *times.values())


NODE = (
    "nameWithOwner string, stargazerCount bigint, forkCount bigint, primaryLanguage struct<name:string>, repositoryTopics struct<nodes:array<struct<topic:struct<name:string>>>>, "
    "issues struct<totalCount:bigint>, pullRequests struct<totalCount:bigint>, mentionableUsers struct<totalCount:bigint>, "
    "recentMergedPRs struct<nodes:array<struct<mergedAt:timestamp,updatedAt:timestamp>>,pageInfo:struct<hasNextPage:boolean>>, "
    "recentIssues struct<nodes:array<struct<createdAt:timestamp>>,pageInfo:struct<hasNextPage:boolean>>, "
    "latestReleases struct<nodes:array<struct<tagName:string,name:string,publishedAt:timestamp,url:string>>>"
)
PAGE = 100


def flat_nodes(nodes: DataFrame) -> DataFrame:
    """Flat metadata of nested repository pages."""
    return nodes.select(
        F.col("nameWithOwner").alias("full_name"), F.col("stargazerCount").alias("stars"), F.col("forkCount").alias("forks"),
        F.coalesce("primaryLanguage.name", F.lit("")).alias("language"), F.coalesce(F.transform("repositoryTopics.nodes", lambda n: n["topic"]["name"]), F.array().cast("array<string>")).alias("topics"),
        F.coalesce("issues.totalCount", F.lit(0)).alias("open_issues"), F.coalesce("pullRequests.totalCount", F.lit(0)).alias("open_prs"), F.coalesce("mentionableUsers.totalCount", F.lit(0)).alias("contributors"),
    )


def nested_activity(nodes: DataFrame, now, page_size: int = PAGE) -> DataFrame:
    """Merged pull requests and new issues of a week from nested pages, and whether a page was cut short.

    A full page with a next one is cut short if its last element is still inside the week;
    pull requests are listed by their update time, issues by creation.
    """
    week = now - F.expr("INTERVAL 7 DAYS")
    prs, issues = F.col("recentMergedPRs.nodes"), F.col("recentIssues.nodes")

    def cut(items, page, time: str):
        tail = F.try_element_at(items, F.lit(-1))[time]
        return F.coalesce((F.size(items) >= page_size) & page["hasNextPage"] & (tail > week), F.lit(False))

    return nodes.select(
        F.col("nameWithOwner").alias("full_name"),
        F.coalesce(F.size(F.filter(prs, lambda p: p["mergedAt"] > week)), F.lit(0)).alias("merged_prs_7d"),
        F.coalesce(F.size(F.filter(issues, lambda i: i["createdAt"] > week)), F.lit(0)).alias("new_issues_7d"),
        (cut(prs, F.col("recentMergedPRs.pageInfo"), "updatedAt") | cut(issues, F.col("recentIssues.pageInfo"), "createdAt")).alias("truncated"),
    )


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
