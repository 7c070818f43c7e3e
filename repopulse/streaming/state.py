"""Keyed state in buckets: a batch rewrites the buckets that it touches, and no others.

Rows lie in ``data/<version>/bucket=<n>``; a manifest names the version of each bucket.
A batch reads its buckets, writes them under its own version and then puts the next
manifest, which is one small file, so a reader sees a batch wholly or not at all.  A batch
that runs again starts from the manifest before its own and ends in the same state.  Folders
that neither of the last two manifests names are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

BUCKETS = 32


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, folder: str, before: str | None = None) -> tuple[int, dict]:
    """Number and content of the last manifest; of the one before if the last is of version ``before``."""
    found = [n for n in files.names(spark, f"{folder}/manifest") if n.endswith(".json") and not n.startswith(".")]
    for name in reversed(found):
        content = json.loads(files.get(spark, f"{folder}/manifest/{name}"))
        if content["version"] != before:
            return int(name.split(".")[0]), content
    return 0, {"version": "", "buckets": {}}


def current(spark: SparkSession, folder: str, schema: str, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The rows of the state, or of some of its buckets."""
    manifest = _manifest(spark, folder)[1] if manifest is None else manifest
    paths = [f"{folder}/data/{v}/bucket={b}" for b, v in sorted(manifest["buckets"].items()) if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def update(folder: str, version: str, source: DataFrame, key: str, schema: str, merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> list[int]:
    """Merges a batch into the state and returns the buckets that were rewritten.

    merge: (rows of the touched buckets, batch) to their next rows, which keep the key.
    """
    spark = source.sparkSession
    number, manifest = _manifest(spark, folder, version)
    touched = sorted(r[0] for r in source.select(bucket_of(key, buckets)).distinct().collect())
    next_rows = merge(current(spark, folder, schema, manifest, touched), source).withColumn("bucket", bucket_of(key, buckets))
    place = f"{folder}/data/{version}"
    # as many tasks as buckets, so one file each
    next_rows.repartition(max(len(touched), 1), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)
    written = {n.split("=")[1] for n in files.names(spark, place) if n.startswith("bucket=")}
    kept = {b: v for b, v in manifest["buckets"].items() if int(b) not in touched} | dict.fromkeys(written, version)
    files.put(spark, f"{folder}/manifest/{number + 1:010d}.json", json.dumps({"version": version, "buckets": kept}).encode())
    for old in files.names(spark, f"{folder}/manifest"):
        if old.split(".")[0].isdigit() and int(old.split(".")[0]) < number:
            files.delete(spark, f"{folder}/manifest/{old}")
    named = {*kept.values(), *manifest["buckets"].values(), version}
    for old in files.names(spark, f"{folder}/data"):
        if old not in named:
            files.delete(spark, f"{folder}/data/{old}")
    return touched
