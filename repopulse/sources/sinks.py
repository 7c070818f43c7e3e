"""Writers: rollups, lists as JSON and CSV, metric points, audit reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files


def write_rollup(rollup: DataFrame, path: str) -> None:
    """Replaces the hours that are in the frame and leaves others; a replay changes nothing."""
    rows = rollup.withColumn("hour_key", F.date_format("hour", "yyyy-MM-dd-HH"))
    # one file an hour; without this every task would write a file into every hour
    rows.repartition("hour_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour_key").parquet(path)


def write_archives(lines: DataFrame, path: str) -> list[str]:
    """Writes ``value`` lines as one gzip file for each ``archive`` name, and returns the names.

    Spark writes a folder for each; its one file is moved up under the archive's name.
    """
    spark, staged = lines.sparkSession, f"{path}/_staged"
    lines.repartition("archive").write.mode("overwrite").option("compression", "gzip").partitionBy("archive").text(staged)
    found = [n.removeprefix("archive=") for n in files.names(spark, staged) if n.startswith("archive=")]
    for name in found:
        part = next(n for n in files.names(spark, f"{staged}/archive={name}") if n.startswith("part-"))
        files.move(spark, f"{staged}/archive={name}/{part}", f"{path}/{name}.json.gz")
    files.delete(spark, staged)
    return found


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def csv_rows(rows: DataFrame, scores: list[str] = ()) -> DataFrame:
    """Arrays joined by ';', scores with one decimal."""
    out = []
    for f in rows.schema:
        c = F.col(f.name)
        if f.dataType.typeName() == "array":
            c = F.concat_ws(";", c)
        elif f.name in scores:
            c = F.replace(F.format_number(c, 1), F.lit(","), F.lit(""))  # rounds the exact value, as C does
        out.append(c.alias(f.name))
    return rows.select(*out)


def write_csv(rows: DataFrame, path: str, scores: list[str] = ()) -> None:
    csv_rows(rows, scores).write.mode("overwrite").csv(path, header=True)


def write_points(points: DataFrame, path: str) -> None:
    points.write.mode("append").partitionBy("metric").parquet(path)


def report_name(day: str) -> str:
    return f"{day[:7]}.md"


def write_report(lines: DataFrame, path: str) -> None:
    """The lines of a report, in order, as one text file (a report is a page, not data)."""
    lines.orderBy("section", "ord").select("line").coalesce(1).write.mode("overwrite").text(path)
