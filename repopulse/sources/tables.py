"""Tables as versions: written to a shared folder and read back; upserts as joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the cluster's checkpoint folder.

    Where none is set, a temporary folder stands in for it in local mode only: elsewhere
    executors could not read what the driver names.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _own.get("folder") or _own.setdefault("folder", tempfile.mkdtemp(prefix="repopulse-"))
    return f"{folder.rstrip('/')}/repopulse-{context.applicationId}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """Writes a table once and reads it back, which also fixes its rows and cuts its lineage.

    The table stays until ``clear_written``: results that are not read yet may need it.
    """
    path = f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def clear_written(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application, once its results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: The columns of the repos table that readers ask for, in order.
REPO_COLUMNS = (
    "id bigint, full_name string, owner string, name string, language string, stars bigint, stars_prev bigint, forks bigint, open_issues bigint, open_prs bigint, "
    "contributors bigint, contributors_prev bigint, growth_score double, normalized_growth_score double, star_velocity double, star_acceleration double, "
    "pr_velocity double, issue_velocity double, contributor_growth double, merged_prs_7d bigint, new_issues_7d bigint, latest_release string, latest_release_date string, "
    "created_at string, first_seen_at string, last_collected_at string, status string, etag string, last_modified string, primary_category string, category_confidence double, "
    "readme_hash string, classified_at string, model_used string, force_category string, excluded int, primary_subcategory string, primary_category_legacy string, force_subcategory string"
)


def read_repos(spark: SparkSession, path: str) -> DataFrame:
    """The repos table by its fixed columns: others in the files aren't read, missing ones are null."""
    return spark.read.schema(REPO_COLUMNS).parquet(path)


def numbered(frame: DataFrame, *order: str, name: str = "row_no", first: int = 0) -> DataFrame:
    """Numbers rows from ``first`` in an order, without gaps and without one task that sees all rows.

    Ranges of the order are sorted by themselves and written; each range's numbers start behind
    those of the ranges before it (one small row a range).  Rows that are equal in the order get
    neighbouring numbers, in any order.
    """
    place = F.monotonically_increasing_id()
    rows = written(frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place), "numbered")
    rows = rows.withColumn("_range", F.shiftright("_place", 33))
    sizes = sorted((r[0], r[1]) for r in rows.groupBy("_range").count().collect())
    starts, at = [], first
    for part, n in sizes:
        starts.append((part, at))
        at += n
    offsets = frame.sparkSession.createDataFrame(starts, "_range long, _start long")
    out = rows.join(offsets, "_range", "left")
    return out.withColumn(name, F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_range", "_place", "_start")


def merge_upsert(target: DataFrame, source: DataFrame, key: str, update: list[str], insert: dict[str, Column] | None = None) -> DataFrame:
    """Next version of a table: rows of the source replace ``update`` columns of equal keys, others are added.

    ``insert`` has the values of columns that the source lacks, for new rows.
    """
    insert = insert or {}
    t, s = target.alias("t"), source.alias("s")
    is_new, is_hit = F.col(f"t.{key}").isNull(), F.col(f"s.{key}").isNotNull()
    out = []
    for c in target.columns:
        given = F.col(f"s.{c}") if c in source.columns else insert.get(c, F.lit(None))
        if c == key:
            out.append(F.coalesce(f"t.{key}", f"s.{key}").alias(key))
        elif c in update:
            out.append(F.when(is_hit, given).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            out.append(F.when(is_new, given).otherwise(F.col(f"t.{c}")).alias(c))
    return t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer").select(*out)


def update_where(target: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return target.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()})


def delete_keys(target: DataFrame, keys: DataFrame, key: str, any_case: bool = False) -> DataFrame:
    if not any_case:
        return target.join(keys.select(key).distinct(), key, "left_anti")
    gone = keys.select(F.lower(key).alias("_gone")).distinct()
    return target.join(gone, F.lower(target[key]) == gone["_gone"], "left_anti")


def insert_ignore(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Adds keys that are not there yet."""
    return target.select(key).union(source.select(key)).distinct()


def evolve(frame: DataFrame, add: dict[str, Column], drop: list[str] = ()) -> DataFrame:
    """Adds missing columns with defaults and drops retired ones; a second run changes nothing."""
    return frame.drop(*drop).withColumns({k: v for k, v in add.items() if k not in frame.columns})


def with_outcomes(requested: DataFrame, metrics: DataFrame, not_found: DataFrame, key: str = "full_name") -> DataFrame:
    """updated, gone or failed for each requested key."""
    found = metrics.select(key).distinct().withColumn("_found", F.lit(True))
    gone = not_found.select(key).distinct().withColumn("_gone", F.lit(True))
    out = requested.join(found, key, "left").join(gone, key, "left")
    return out.withColumn("outcome", F.when(F.col("_gone"), "gone").when(F.col("_found"), "updated").otherwise("failed")).drop("_found", "_gone")
