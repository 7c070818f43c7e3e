"""Structured Streaming jobs: hourly archives, latest state, gates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import exprs as x
from ..operators import events as ev
from ..operators.health import failure_runs
from ..sources import archive, sinks
from . import state


def archive_stream(spark: SparkSession, path: str, files_per_batch: int = 24) -> DataFrame:
    """Lines of hourly archives as they arrive.

    A damaged file fails its batch, so that nothing of an hour is lost unseen; the ledger
    of failed runs tells when to skip it (``without_poison``).
    """
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path)
    return lines.select("value", x.archive_hour(F.col("_metadata.file_name")).alias("hour"))


def without_poison(lines: DataFrame, ledger: DataFrame, limit: int = 5) -> DataFrame:
    """Lines without those of archives that have failed ``limit`` runs in a row.  ledger: hour, run, ok."""
    poison = failure_runs(ledger.withColumnRenamed("hour", "archive"), limit).filter("skipped").select(F.col("archive").alias("hour"))
    return lines.join(poison, "hour", "left_anti")


def ingest(lines: DataFrame, rollup_path: str, checkpoint: str, now_s: int | None = None, types: list[str] | None = None, ledger: DataFrame | None = None) -> StreamingQuery:
    """Writes the hour rollup of new archives and stops when there are none.

    The checkpoint moves on only after a batch is written.  Hours are whole files, so a
    replayed or late hour replaces its partition, and an hour is never added twice.  With
    a ledger (hour, run, ok), archives that have failed too often are left out.
    """
    def write(batch: DataFrame, _: int) -> None:
        batch = batch if ledger is None else without_poison(batch, ledger)
        parsed = archive.parse_events(batch).filter("ok AND hour IS NOT NULL")
        if now_s is not None:
            parsed = parsed.filter(x.archive_ready(now_s, F.col("hour")))
        sinks.write_rollup(ev.hour_rollup(parsed, types), rollup_path)

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(counts: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes the changed rows of a windowed count, batch by batch; ``latest_counts`` reads them.

    A batch that runs again replaces its own folder.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, folder: str, keys: list[str], value: str) -> DataFrame:
    """The last value of each key that a windowed count has written."""
    rows = spark.read.parquet(folder)
    return rows.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def tumbling_counts(events: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Events of each repository and type an hour; rows later than the delay are dropped."""
    rows = events.withWatermark("created_at", delay)
    return rows.groupBy(F.window("created_at", "1 hour"), "repo_name", "type").agg(F.count(F.lit(1)).alias("n"))


def hourly_counts(events: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Events of each repository an hour: the state that sliding totals need, a row for each repository and hour."""
    rows = events.withWatermark("created_at", delay)
    return rows.groupBy(F.window("created_at", "1 hour"), "repo_name").agg(F.count(F.lit(1)).alias("n"))


def sliding_totals(hourly: DataFrame, hours: int = 24) -> DataFrame:
    """Totals of the last hours at every full hour that has any.  hourly: repo_name, hour_s, n.

    Only hourly rows are spread over the windows that they are in, not events.
    """
    edges = F.sequence(F.col("hour_s") + 3600, F.col("hour_s") + hours * 3600, F.lit(3600))
    return hourly.select("repo_name", F.explode(edges).alias("edge_s"), "n").groupBy("repo_name", "edge_s").agg(F.sum("n").alias("total"))


def retained(rollup: DataFrame, edge_s: int, hours: int = 24) -> DataFrame:
    """Hours of a rollup that are still inside the window."""
    return rollup.filter(F.unix_timestamp("hour") >= edge_s - hours * 3600)


def state_schema(columns: list[str]) -> str:
    """Rows of the latest state: long columns with the values before them."""
    return ", ".join(["full_name string", "collected_at long", *(f"{c} long" for c in columns), *(f"{c}_prev long" for c in columns)])


def as_of_merge(columns: list[str]):
    """A merge of snapshots by their own time: those not newer than what stands change nothing.

    Of several new snapshots the last stands, with the one before it (or what stood) as previous values;
    among snapshots of one time the largest values count, so the order of arrival doesn't matter.
    """
    def merge(standing: DataFrame, batch: DataFrame) -> DataFrame:
        rows = batch.groupBy("full_name", "collected_at").agg(F.max(F.struct(*columns)).alias("r"))
        was = standing.select("full_name", F.col("collected_at").alias("_at"), F.struct("collected_at", *columns, *[f"{c}_prev" for c in columns]).alias("_was"))
        new = rows.join(was.select("full_name", "_at"), "full_name", "left").filter("_at IS NULL OR collected_at > _at")
        w = Window.partitionBy("full_name").orderBy(F.desc("collected_at"))
        last = new.withColumn("_n", F.row_number().over(w)).filter("_n <= 2").groupBy("full_name").agg(
            F.max(F.when(F.col("_n") == 1, F.struct("collected_at", "r"))).alias("_last"), F.max(F.when(F.col("_n") == 2, F.col("r"))).alias("_second")
        )
        both = was.join(last, "full_name", "full_outer")
        value = [F.coalesce(F.col(f"_last.r.{c}"), F.col(f"_was.{c}")).alias(c) for c in columns]
        before = lambda c: F.coalesce(F.col(f"_second.{c}"), F.col(f"_was.{c}"), F.lit(0).cast("long"))
        previous = [F.when(F.col("_last").isNull(), F.col(f"_was.{c}_prev")).otherwise(before(c)).alias(f"{c}_prev") for c in columns]
        return both.select("full_name", F.coalesce("_last.collected_at", "_was.collected_at").alias("collected_at"), *value, *previous)

    return merge


def upsert_state(snapshots: DataFrame, folder: str, checkpoint: str, columns: list[str]) -> StreamingQuery:
    """Keeps the latest snapshot of each repository with the values before it (``latest_state``).

    Snapshots are ordered by ``collected_at``, not by arrival; a batch rewrites the buckets of its repositories only.
    """
    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("full_name", "collected_at", *columns).persist()
        state.update(folder, f"batch-{number}", rows, "full_name", state_schema(columns), as_of_merge(columns))
        rows.unpersist()

    return snapshots.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    return state.current(spark, folder, state_schema(columns))


GATE_OUT = "source string, hour_s long, event string, reason string, paused_s long"
GATE_STATE = "reason string, since_s long"


def gate_stream(signals: DataFrame) -> DataFrame:
    """Pause and resume events of each source from its signals: source, hour_s, queue_depth, rate_limit_pct, rolling.

    A change of reason while paused is an event of its own and keeps the start of the pause.
    """
    rows = signals.withColumn("reason", x.pause_reason(F.col("queue_depth"), F.col("rate_limit_pct"), F.col("rolling")))
    return rows.select("source", "hour_s", "reason").groupBy("source").applyInPandasWithState(_gate, GATE_OUT, GATE_STATE, "append", GroupStateTimeout.NoTimeout)


def _gate(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    reason, since = state.get if state.exists else ("", 0)
    rows = pd.concat(list(frames)).sort_values("hour_s")
    out = []
    for at, now in zip(rows["hour_s"].tolist(), rows["reason"].tolist(), strict=True):
        if now and now != reason:
            since = since if reason else at
            out.append((key[0], at, "pause", now, at - since))
        elif reason and not now:
            out.append((key[0], at, "resume", reason, at - since))
        reason = now
    state.update((reason, since))
    yield pd.DataFrame(out, columns=["source", "hour_s", "event", "reason", "paused_s"])

