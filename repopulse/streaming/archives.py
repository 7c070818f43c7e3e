"""Hourly archives by a run ledger: admission before reading, outcomes per archive, a bounded window.

A cycle first looks again at archives that failed or were not complete, then at new files,
whose names arrive as a stream (their content isn't opened for that).  Each archive gets one ledger
row a cycle with an outcome:

  ok       read and written; failures before it don't count any more
  failed   damaged or unreadable; tried again in the next cycle
  skipped  failed for the ``limit``-th time in a row, or not named like an archive; never opened again
  late     older than the window behind the newest hour that earlier batches have written; dropped
  waiting  its hour isn't complete yet

Archives are read together.  Only if that fails, each one is unpacked by itself, and the good
ones are read again, so a damaged archive costs its own hour and no other.  The store holds hour
partitions of the window (older ones are deleted), window totals in buckets, to which a batch
adds new hours and from which it takes replaced and expired ones, and the ledger.  What a batch
changes in the totals is written before anything is replaced, under the batch's name, so a
batch that breaks off and runs again adds nothing twice.

A file is one whole hour; a file that comes again replaces its hour.
"""

from __future__ import annotations

import calendar
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..operators import events as ev
from ..sources import archive, files, sinks
from . import state

LEDGER = (
    "archive string, path string, hour_s long, outcome string, failures long, error string, kept long, discarded long, by_type map<string,bigint>, "
    "bytes long, lag_s long, took_ms long, cycle long, batch string"
)
TOTALS = "repo_name string, total long"
_ROLLUP = "repo_name string, hour timestamp, event_count long, per_type map<string,bigint>, hour_key string"
HOUR = 3600


@dataclass
class Hooks:
    """What a caller wants to hear, in the order of a batch; each is called once an archive.

    events(archive, kept by type, discarded), lag(archive, seconds), error(archive, failures, message).
    """

    events: list[Callable[[str, dict[str, int], int], None]] = field(default_factory=list)
    lag: list[Callable[[str, int], None]] = field(default_factory=list)
    error: list[Callable[[str, int, str], None]] = field(default_factory=list)


@dataclass(frozen=True)
class Ingest:
    """A store and the rules of its cycles."""

    spark: SparkSession
    store: str
    window_hours: int = 24
    types: tuple[str, ...] | None = None
    limit: int = 5
    files_per_batch: int = 24
    hooks: Hooks = field(default_factory=Hooks)

    @property
    def rollup_path(self) -> str:
        return f"{self.store}/rollup"

    @property
    def ledger_path(self) -> str:
        return f"{self.store}/ledger"

    def ledger(self) -> DataFrame:
        read = self.spark.read.schema(LEDGER)
        return read.parquet(f"{self.ledger_path}/*") if files.names(self.spark, self.ledger_path) else self.spark.createDataFrame([], LEDGER)

    def rollup(self) -> DataFrame:
        """Hours of the window: repo_name, hour, event_count, per_type, hour_key."""
        read = self.spark.read.schema(_ROLLUP)
        return read.parquet(self.rollup_path) if files.exists(self.spark, self.rollup_path) else self.spark.createDataFrame([], _ROLLUP)

    def totals(self) -> DataFrame:
        return state.current(self.spark, f"{self.store}/totals", TOTALS)

    def latest(self) -> DataFrame:
        """The last ledger row of each archive."""
        order = F.struct("cycle", "batch")
        return self.ledger().groupBy("archive").agg(F.max_by(F.struct(*[c.split()[0] for c in LEDGER.split(", ")]), order).alias("r")).select("r.*")

    def newest_hour(self) -> int | None:
        return self.ledger().filter("outcome = 'ok'").agg(F.max("hour_s")).first()[0]

    def run_cycle(self, folder: str, now_s: int, pattern: str = "*.json.gz") -> int:
        """Works on everything that waits and returns the number of the cycle."""
        cycle = (self.ledger().agg(F.max("cycle")).first()[0] or 0) + 1
        again = self.latest().filter("outcome IN ('failed', 'waiting')").select("path", "bytes", "failures").orderBy("path").collect()
        for i in range(0, len(again), self.files_per_batch):
            self._batch([tuple(r) for r in again[i : i + self.files_per_batch]], f"again-{cycle:06d}-{i:06d}", cycle, now_s)
        found = self.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", self.files_per_batch)
        names = found.load(folder).select("path", "length")

        def write(batch: DataFrame, number: int) -> None:
            self._batch([(r[0], r[1], 0) for r in batch.orderBy("path").collect()], f"new-{number:06d}", cycle, now_s)

        names.writeStream.foreachBatch(write).option("checkpointLocation", f"{self.store}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return cycle

    def _batch(self, found: list[tuple[str, int, int]], name: str, cycle: int, now_s: int) -> None:
        """One batch of archive files (path, bytes, failures so far): at most ``files_per_batch``."""
        start = time.monotonic()
        newest = self.newest_hour()
        rows = {p: self._admitted(p, size, failures, newest, now_s) for p, size, failures in found}
        counts: dict[int, dict] = {}
        while hours := {p: r["hour_s"] for p, r in rows.items() if r["outcome"] == "ok"}:
            try:
                counts = self._write(hours, name, max([*hours.values(), *([] if newest is None else [newest])]))
                break
            except (PySparkException, Py4JJavaError):
                if not self._blame(rows, list(hours)):
                    raise  # none of them is damaged
        took = int((time.monotonic() - start) * 1000)
        for r in rows.values():
            if r["outcome"] == "ok":
                r |= {"failures": 0, "took_ms": took, **counts[r["hour_s"]]}
        ordered = [(r["archive"], p, *(r.get(c.split()[0]) for c in LEDGER.split(", ")[2:-2]), cycle, name) for p, r in rows.items()]
        self.spark.createDataFrame(ordered, LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{self.ledger_path}/{name}")
        self._tell(rows.values())

    def _admitted(self, path: str, size: int, failures: int, newest: int | None, now_s: int) -> dict:
        """The ledger row of a file before it is read; ``ok`` means that it may be."""
        archive_name = path.rsplit("/", 1)[1].split(".")[0]
        hour = hour_s(archive_name)
        row = {"archive": archive_name, "hour_s": hour, "bytes": size, "failures": failures, "outcome": "ok", "error": None}
        if hour is None:
            return row | {"outcome": "skipped", "error": "not an archive's name"}
        row["lag_s"] = now_s - hour
        if row["lag_s"] < HOUR + HOUR // 2:
            return row | {"outcome": "waiting"}
        if newest is not None and hour <= newest - self.window_hours * HOUR:
            return row | {"outcome": "late"}
        return row

    def _blame(self, rows: dict[str, dict], paths: list[str]) -> bool:
        """Notes the failure of each damaged file; whether there is one."""
        errors = damaged(self.spark, paths).collect()
        for path, error in errors:
            row = rows[path]
            row["failures"] += 1
            row |= {"outcome": "skipped" if row["failures"] >= self.limit else "failed", "error": error}
        return bool(errors)

    def _cells(self, staged: str) -> DataFrame:
        return self.spark.read.schema("repo_name string, hour timestamp, type string, n long").parquet(f"{staged}/cells")

    def _lines(self, paths: list[str]) -> DataFrame:
        return archive.read_lines(self.spark, paths)

    def _write(self, hours: dict[str, int], name: str, newest: int) -> dict[int, dict]:
        """Writes the hours of some files and what they change; kept and discarded events of each hour."""
        wanted = sorted(set(hours.values()))
        name = f"{name}-{zlib.crc32(chr(10).join(sorted(hours)).encode()):08x}"  # the same files again, or another batch
        kept = F.col("ok") & ev.kept(list(self.types) if self.types else None)
        staged = f"{self.store}/staged/{name}"
        if not files.exists(self.spark, f"{staged}/delta/_SUCCESS"):
            cells = ev.cells_with_discarded(archive.parse_events(self._lines(list(hours))), kept)
            cells.write.mode("overwrite").parquet(f"{staged}/cells")
            fresh = ev.rollup_of(self._cells(staged).filter("repo_name IS NOT NULL"))
            self._delta(fresh, wanted, newest).write.mode("overwrite").parquet(f"{staged}/delta")
        cells, delta = self._cells(staged), self.spark.read.parquet(f"{staged}/delta")
        state.update(f"{self.store}/totals", name, delta, "repo_name", TOTALS, _added)
        edge = newest - self.window_hours * HOUR
        inside = cells.filter("repo_name IS NOT NULL").filter(F.unix_timestamp("hour") > edge)
        sinks.write_rollup(ev.rollup_of(inside), self.rollup_path)
        counts = {h: {"kept": 0, "discarded": 0, "by_type": {}} for h in wanted}
        # a row for each hour of the batch and type
        for h, kind, n, gone in cells.groupBy(F.unix_timestamp("hour"), "type").agg(F.sum(F.when(F.col("repo_name").isNotNull(), F.col("n"))), F.sum(F.when(F.col("repo_name").isNull(), F.col("n")))).collect():
            if n:
                counts[h]["by_type"][kind] = n
                counts[h]["kept"] += n
            counts[h]["discarded"] += gone or 0
        self._evict(edge, [h for h in wanted if not counts[h]["kept"]])
        files.delete(self.spark, staged)
        return counts

    def _delta(self, fresh: DataFrame, wanted: list[int], newest: int) -> DataFrame:
        """Change of each repository's window total: new hours, less the hours that they replace and those that expire."""
        edge = newest - self.window_hours * HOUR
        hour = F.unix_timestamp("hour")
        gone = self.rollup().filter((hour <= edge) | hour.isin(wanted)).select("repo_name", (-F.col("event_count")).alias("n"))
        new = fresh.filter(hour > edge).select("repo_name", F.col("event_count").alias("n"))
        return new.unionByName(gone).groupBy("repo_name").agg(F.sum("n").alias("total")).filter("total <> 0")

    def _evict(self, edge: int, empty: list[int]) -> None:
        """Deletes hours that have left the window, and hours whose archive has no events any more."""
        for key in files.names(self.spark, self.rollup_path):
            hour = hour_s(key.removeprefix("hour_key="))
            if hour is not None and (hour <= edge or hour in empty):
                files.delete(self.spark, f"{self.rollup_path}/{key}")

    def _tell(self, rows) -> None:
        for r in rows:
            if r["outcome"] == "ok":
                for hook in self.hooks.events:
                    hook(r["archive"], r["by_type"], r["discarded"])
            if r.get("lag_s") is not None:
                for hook in self.hooks.lag:
                    hook(r["archive"], r["lag_s"])
            if r.get("error"):
                for hook in self.hooks.error:
                    hook(r["archive"], r["failures"], r["error"])


def hour_s(name: str) -> int | None:
    """Hour of an archive's name in seconds; None of any other name."""
    try:
        return calendar.timegm(time.strptime(name, "%Y-%m-%d-%H")) if len(name) == 13 else None
    except ValueError:
        return None


def _added(standing: DataFrame, delta: DataFrame) -> DataFrame:
    """Totals with a change; repositories that have decayed to zero leave."""
    return standing.unionByName(delta).groupBy("repo_name").agg(F.sum("total").alias("total")).filter("total <> 0")


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path and error of each gzip file that doesn't unpack to its end."""
    for batch in batches:
        bad = []
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if error := _gzip_error(memoryview(data.as_buffer())):
                bad.append((path, error))
        yield pa.RecordBatch.from_arrays([pa.array([b[i] for b in bad], pa.string()) for i in range(2)], ["path", "error"])


def _gzip_error(data: memoryview) -> str | None:
    """What is wrong with gzip members one after the other; they are unpacked piece by piece and not kept."""
    at = 0
    try:
        while at < len(data):
            unpack = zlib.decompressobj(wbits=31)
            while at < len(data) and not unpack.eof:
                piece = data[at : at + (1 << 16)]
                unpack.decompress(piece)
                at += len(piece) - len(unpack.unused_data)
            if not unpack.eof:
                return "truncated"
        return None if len(data) else "empty"
    except zlib.error as e:
        return str(e)


def damaged(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and error of damaged gzip files, each checked by itself."""
    content = spark.read.format("binaryFile").load(paths).select("path", "content").repartition(len(paths))
    return content.mapInArrow(_check, "path string, error string")
