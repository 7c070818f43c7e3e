"""Streaming jobs over archives that are cut from the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import exprs as x
from ..operators import health
from ..sources import archive, files, sinks
from ..sources.tables import shared_folder
from ..sources.views import NOW
from ..streaming import archives, caps, ingest
from .discovery_queries import _GATES
from .event_queries import _HOURLY, _KEPT
from .registry import query


def _folder(t):
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def _streamed(t, runs=("true",), ledger=None):
    """Streams the events as archive lines, those of each condition in a run of its own.  Each
    line also names its hour, in place of a file for each hour, whose listing would take
    longer than the job."""
    folder = _folder(t)
    line = F.to_json(F.struct("type", F.struct(F.col("repo_name").alias("name")).alias("repo"), F.date_format("hour", "yyyy-MM-dd-HH").alias("archive")))
    hour = x.archive_hour(F.get_json_object("value", "$.archive"))
    for run in runs:
        t.repo_events.filter(run).select(line.alias("value")).write.mode("append").text(f"{folder}/archives")
        lines = t.spark.readStream.format("text").load(f"{folder}/archives").select("value", hour.alias("hour"))
        ingest.ingest(lines, f"{folder}/rollup", f"{folder}/checkpoint", now_s=NOW, ledger=ledger).awaitTermination()
    return t.spark.read.parquet(f"{folder}/rollup")


def _counted(t, count, keys, value):
    """Streams the events table through a windowed count."""
    folder = _folder(t)
    t.repo_events.select("repo_name", "type", "created_at").write.parquet(f"{folder}/events")
    rows = t.spark.readStream.schema("repo_name string, type string, created_at timestamp").parquet(f"{folder}/events")
    ingest.counted(count(rows), f"{folder}/counts", f"{folder}/checkpoint").awaitTermination()
    return ingest.latest_counts(t.spark, f"{folder}/counts", keys, value)


@query("r1_streamed_rollup", f"SELECT * FROM ({_HOURLY}) WHERE hour_s <= {{NOW}} - 5400")
def _(t):
    return _streamed(t).select("repo_name", F.unix_timestamp("hour").alias("hour_s"), "event_count")


@query("r2_tumbling_counts", "SELECT repo_name, type, EPOCH(hour) AS hour_s, count(*) AS n FROM repo_events GROUP BY 1, 2, 3")
def _(t):
    return _counted(t, ingest.tumbling_counts, ["window", "repo_name", "type"], "n").select("repo_name", "type", F.unix_timestamp("window.start").alias("hour_s"), "n")


@query("r3_sliding_counts", """WITH h AS (SELECT repo_name, EPOCH(hour) AS hour_s, count(*) AS n FROM repo_events GROUP BY 1, 2), w AS (SELECT repo_name, hour_s + 3600 * unnest(generate_series(1, 24)) AS edge_s, n FROM h)
SELECT repo_name, edge_s, CAST(sum(n) AS BIGINT) AS total FROM w GROUP BY 1, 2""")
def _(t):
    hourly = _counted(t, ingest.hourly_counts, ["window", "repo_name"], "n").select("repo_name", F.unix_timestamp("window.start").alias("hour_s"), "n")
    return ingest.sliding_totals(hourly)


@query("r4_late_hours", f"SELECT * FROM ({_HOURLY}) WHERE hour_s <= {{NOW}} - 5400")
def _(t):
    odd = "CAST(unix_timestamp(hour) / 3600 AS BIGINT) % 2 = 1"
    return _streamed(t, (odd, f"NOT {odd}")).select("repo_name", F.unix_timestamp("hour").alias("hour_s"), "event_count")


@query("r5_replayed_hours", f"SELECT * FROM ({_HOURLY}) WHERE hour_s <= {{NOW}} - 5400")
def _(t):
    return _streamed(t, ("true", "true")).select("repo_name", F.unix_timestamp("hour").alias("hour_s"), "event_count")


@query("r9_gate_events", f"""{_GATES}, w AS (SELECT hour_s, reason, coalesce(lag(reason) OVER (ORDER BY hour_s), '') AS was FROM st),
s AS (SELECT *, max(CASE WHEN reason <> '' AND was = '' THEN hour_s END) OVER (ORDER BY hour_s) AS since FROM w)
SELECT hour_s, CASE WHEN reason = '' THEN 'resume' ELSE 'pause' END AS event, CASE WHEN reason = '' THEN was ELSE reason END AS reason, hour_s - since AS paused_s FROM s WHERE reason <> was""")
def _(t):
    folder = _folder(t)
    signals = health.rolling_emissions(t.gate_log).select(F.lit("archive").alias("source"), "hour_s", "queue_depth", "rate_limit_pct", "rolling")
    signals.write.parquet(f"{folder}/signals")
    rows = t.spark.readStream.schema(signals.schema).parquet(f"{folder}/signals")
    job = ingest.gate_stream(rows).writeStream.format("parquet").option("path", f"{folder}/events").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    return t.spark.read.parquet(f"{folder}/events").select("hour_s", "event", "reason", "paused_s")


@query("r9_gates_by_source", f"""{_GATES}, two AS (SELECT CASE WHEN hour_s // 3600 % 3 = 0 THEN 'search' ELSE 'archive' END AS source, * FROM st), w AS (SELECT source, hour_s, reason, coalesce(lag(reason) OVER (PARTITION BY source ORDER BY hour_s), '') AS was FROM two),
s AS (SELECT *, max(CASE WHEN reason <> '' AND was = '' THEN hour_s END) OVER (PARTITION BY source ORDER BY hour_s) AS since FROM w)
SELECT source, hour_s, CASE WHEN reason = '' THEN 'resume' ELSE 'pause' END AS event, CASE WHEN reason = '' THEN was ELSE reason END AS reason, hour_s - since AS paused_s FROM s WHERE reason <> was""")
def _(t):
    """Gates of two sources, whose signals come in three batches; a pause goes on from batch to batch."""
    folder = _folder(t)
    source = F.when(F.floor(F.col("hour_s") / 3600) % 3 == 0, "search").otherwise("archive")
    signals = health.rolling_emissions(t.gate_log).select(source.alias("source"), "hour_s", "queue_depth", "rate_limit_pct", "rolling")
    day = F.floor((F.col("hour_s") - (NOW - 30 * x.DAY)) / x.DAY)
    for part in (day < 9, (day >= 9) & (day < 21), day >= 21):
        signals.filter(part).coalesce(1).write.mode("append").parquet(f"{folder}/signals")
        rows = t.spark.readStream.schema(signals.schema).parquet(f"{folder}/signals")
        ingest.gate_stream(rows).writeStream.format("parquet").option("path", f"{folder}/events").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/events").select("source", "hour_s", "event", "reason", "paused_s")


@query("r11_latest_state", """WITH o AS (SELECT full_name, day, stars, row_number() OVER (PARTITION BY full_name ORDER BY day DESC) AS n FROM snapshots)
SELECT full_name, max(day) FILTER (WHERE n = 1) AS day, max(stars) FILTER (WHERE n = 1) AS stars, coalesce(max(stars) FILTER (WHERE n = 2), 0) AS stars_prev FROM o WHERE n <= 2 GROUP BY 1""")
def _(t):
    old = F.col("collected_at") < NOW - 12 * x.DAY
    return _latest(t, old, ~old)


_LATE = "day < {NOW} - 12 * 86400 AND day % 172800 = 0"


@query("r11_late_snapshots", f"""WITH o AS (SELECT full_name, day, stars, row_number() OVER (PARTITION BY full_name ORDER BY day DESC) AS n FROM snapshots WHERE NOT ({_LATE})),
k AS (SELECT full_name, max(day) FILTER (WHERE n = 1) AS day, max(stars) FILTER (WHERE n = 1) AS stars, coalesce(max(stars) FILTER (WHERE n = 2), 0) AS stars_prev FROM o WHERE n <= 2 GROUP BY 1),
l AS (SELECT full_name, day, stars, row_number() OVER (PARTITION BY full_name ORDER BY day DESC) AS n FROM snapshots WHERE {_LATE} AND full_name NOT IN (SELECT full_name FROM o)),
m AS (SELECT full_name, max(day) FILTER (WHERE n = 1) AS day, max(stars) FILTER (WHERE n = 1) AS stars, coalesce(max(stars) FILTER (WHERE n = 2), 0) AS stars_prev FROM l WHERE n <= 2 GROUP BY 1)
SELECT * FROM k UNION ALL SELECT * FROM m""")
def _(t):
    """Snapshots in three batches; the last has old days only, which change nothing but unknown repositories."""
    late = F.expr(_LATE.replace("{NOW}", str(NOW)).replace("day", "collected_at"))
    odd = F.pmod(F.xxhash64("full_name"), F.lit(2)) == 0
    return _latest(t, ~late & odd, ~late & ~odd, late)


def _latest(t, *parts):
    """The latest state after snapshots that come in parts."""
    folder = _folder(t)
    rows = t.snapshots.select("full_name", F.col("day").alias("collected_at"), "stars")
    for part in parts:
        rows.filter(part).write.mode("append").parquet(f"{folder}/snapshots")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{folder}/snapshots")
        ingest.upsert_state(stream, f"{folder}/state", f"{folder}/checkpoint", ["stars"]).awaitTermination()
    return ingest.latest_state(t.spark, f"{folder}/state", ["stars"]).select("full_name", F.col("collected_at").alias("day"), "stars", "stars_prev")


#: Archives of these queries hold the events of a day, under the name of its first hour.
SLOT = 86_400
_SLOT = f"EPOCH(hour) - EPOCH(hour) % {SLOT}"
_ALL_READY = f"SELECT {_SLOT} AS hour_s, count(*) FILTER (WHERE {{kept}}) AS kept, count(*) FILTER (WHERE NOT ({{kept}})) AS discarded FROM repo_events WHERE {_SLOT} <= {{{{NOW}}}} - 5400 GROUP BY 1"
_HOURS = _ALL_READY.format(kept=_KEPT)


def _slot():
    return F.unix_timestamp("hour") - F.unix_timestamp("hour") % SLOT


def _archived(t, folder, rows=None, broken=False):
    """Writes events as gzip archives; every fiftieth event may be a broken line."""
    line = F.to_json(F.struct("type", F.struct(F.col("repo_name").alias("name")).alias("repo")))
    line = F.when(F.col("event_id") % 50 == 0, F.lit('{"type": "WatchEvent", "repo": ')).otherwise(line) if broken else line
    rows = t.repo_events if rows is None else rows
    return sinks.write_archives(rows.select(line.alias("value"), x.archive_name(F.timestamp_seconds(_slot())).alias("archive")), f"{folder}/archives")


def _job(t, folder, hours, **more):
    return archives.Ingest(t.spark, f"{folder}/store", window_hours=hours, files_per_batch=400, **more)


_EMISSIONS = "SELECT type AS source, EPOCH(hour) AS hour_s, CAST(sum(event_id % 200) AS BIGINT) AS emitted FROM repo_events GROUP BY 1, 2"


@query("r10_cap_changes", f"""WITH e AS ({_EMISSIONS}), ends AS (SELECT source, min(hour_s) AS lo, max(hour_s) AS hi FROM e GROUP BY 1),
grid AS (SELECT source, unnest(generate_series(lo, hi, 3600)) AS hour_s FROM ends),
roll AS (SELECT g.source, g.hour_s, CAST(coalesce(sum(e.emitted) OVER (PARTITION BY g.source ORDER BY g.hour_s ROWS BETWEEN 24 PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS rolling FROM grid g LEFT JOIN e ON e.source = g.source AND e.hour_s = g.hour_s),
st AS (SELECT *, CASE WHEN rolling >= 5000 THEN 'hard' WHEN rolling >= 4000 THEN 'warn' ELSE 'ok' END AS cap_state FROM roll)
SELECT * FROM (SELECT source, hour_s, coalesce(lag(cap_state) OVER (PARTITION BY source ORDER BY hour_s), 'ok') AS was, cap_state, rolling FROM st) WHERE was <> cap_state""")
def _(t):
    """Cap changes of five sources, whose emissions come in three batches by time."""
    folder = _folder(t)
    hour = F.unix_timestamp("hour")
    rows = t.repo_events.groupBy(F.col("type").alias("source"), hour.alias("hour_s")).agg(F.sum(F.col("event_id") % 200).alias("emitted"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    was = t.spark.conf.get(provider)
    t.spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for lo, hi in ((None, 20), (20, 10), (10, None)):
            part = rows if lo is None else rows.filter(F.col("hour_s") >= NOW - lo * x.DAY)
            part = part if hi is None else part.filter(F.col("hour_s") < NOW - hi * x.DAY)
            part.coalesce(1).write.mode("append").parquet(f"{folder}/emissions")
            stream = t.spark.readStream.schema("source string, hour_s long, emitted long").parquet(f"{folder}/emissions")
            job = caps.cap_stream(stream).writeStream.format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            job.awaitTermination()
    finally:
        t.spark.conf.set(provider, was)
    last = rows.groupBy("source").agg(F.max("hour_s").alias("end"))
    changes = t.spark.read.schema(caps.CAP_OUT).parquet(f"{folder}/changes")
    return changes.join(last, "source").filter("hour_s <= end").drop("end")  # what timers tell of silent sources comes later


@query("r8_damaged_archives", f"""WITH h AS ({_HOURS})
SELECT hour_s, CASE WHEN hour_s // 86400 % 10 = 7 THEN 'skipped' ELSE 'ok' END AS outcome, CASE WHEN hour_s // 86400 % 10 = 7 THEN 5 ELSE 0 END AS failures, CASE WHEN hour_s // 86400 % 10 = 7 THEN NULL ELSE kept END AS kept FROM h""")
def _(t):
    """Truncated archives fail five cycles and are skipped; some are mended after two and count then."""
    folder = _folder(t)
    names = _archived(t, folder)
    bad = {n: files.get(t.spark, f"{folder}/archives/{n}.json.gz") for n in names if archives.hour_s(n) // SLOT % 10 in (3, 7)}
    for n, whole in bad.items():
        files.put(t.spark, f"{folder}/archives/{n}.json.gz", whole[: len(whole) // 2])
    job = _job(t, folder, 24 * 60)
    for cycle in range(6):
        if cycle == 2:
            for n, whole in bad.items():
                if archives.hour_s(n) // SLOT % 10 == 3:
                    files.put(t.spark, f"{folder}/archives/{n}.json.gz", whole)
        job.run_cycle(f"{folder}/archives", NOW)
    return job.latest().filter("outcome <> 'waiting'").select("hour_s", "outcome", "failures", "kept")


@query("r4_late_and_too_late", f"""WITH h AS ({_HOURS}), o AS (SELECT max(hour_s) AS newest FROM h WHERE hour_s // 86400 % 2 = 1), n AS (SELECT max(hour_s) AS newest FROM h)
SELECT hour_s, CASE WHEN hour_s // 86400 % 2 = 0 AND hour_s <= o.newest - 168 * 3600 THEN 'late' ELSE 'ok' END AS outcome, CASE WHEN hour_s > n.newest - 168 * 3600 THEN kept ELSE 0 END AS stored FROM h, o, n""")
def _(t):
    """Odd archives, then even ones: those inside the window of a week are taken, older ones dropped and counted."""
    folder = _folder(t)
    job = _job(t, folder, 168)
    for odd in (1, 0):
        _archived(t, folder, t.repo_events.filter(F.floor(_slot() / SLOT) % 2 == odd))
        job.run_cycle(f"{folder}/archives", NOW)
    stored = job.rollup().groupBy(F.unix_timestamp("hour").alias("hour_s")).agg(F.sum("event_count").alias("stored"))
    return job.latest().filter("outcome <> 'waiting'").join(stored, "hour_s", "left").select("hour_s", "outcome", F.coalesce("stored", F.lit(0)).alias("stored"))


@query("r6_evicted_totals", f"""WITH r AS (SELECT repo_name, {_SLOT} AS hour_s FROM repo_events WHERE {_KEPT} AND {_SLOT} <= {{NOW}} - 5400), n AS (SELECT max({_SLOT}) AS newest FROM repo_events WHERE {_SLOT} <= {{NOW}} - 5400)
SELECT repo_name, count(*) AS total FROM r, n WHERE hour_s > newest - 168 * 3600 GROUP BY 1""")
def _(t):
    """Window totals that are kept up to date by what comes and what expires, over three cycles."""
    folder = _folder(t)
    job = _job(t, folder, 168)
    day = F.floor((_slot() - (NOW - 30 * x.DAY)) / x.DAY)
    for part in (day < 12, (day >= 12) & (day < 25), day >= 25):
        _archived(t, folder, t.repo_events.filter(part))
        job.run_cycle(f"{folder}/archives", NOW)
    return job.totals()


@query("d5_archive_events", _ALL_READY.format(kept=f"({_KEPT}) AND event_id % 50 <> 0"))
def _(t):
    """What the hooks heard of each archive: kept and discarded events."""
    folder, heard = _folder(t), []
    hooks = archives.Hooks(events=[lambda name, by_type, discarded: heard.append((archives.hour_s(name), sum(by_type.values()), discarded))])
    _archived(t, folder, broken=True)
    _job(t, folder, 24 * 60, hooks=hooks).run_cycle(f"{folder}/archives", NOW)
    return t.spark.createDataFrame(heard, "hour_s long, kept long, discarded long")


@query("r6_retained", f"SELECT repo_name, CAST(sum(event_count) AS BIGINT) AS total FROM ({_HOURLY}) WHERE hour_s >= {{NOW}} - 86400 * 7 AND hour_s <= {{NOW}} - 5400 GROUP BY 1")
def _(t):
    return ingest.retained(_streamed(t), NOW, 168).groupBy("repo_name").agg(F.sum("event_count").alias("total"))


@query("r8_poison_archives", f"SELECT * FROM ({_HOURLY}) WHERE hour_s <= {{NOW}} - 5400 AND hour_s // 3600 % 5 <> 0")
def _(t):
    n = F.when(F.unix_timestamp("hour") / 3600 % 5 == 0, 6).otherwise(4)
    ledger = t.repo_events.select("hour").distinct().select("hour", F.explode(F.sequence(F.lit(1), n)).alias("run"), (F.col("run") == 1).alias("ok"))
    return _streamed(t, ledger=ledger).select("repo_name", F.unix_timestamp("hour").alias("hour_s"), "event_count")


@query("s16_archive_bytes", "SELECT CAST(sum(length(repo_name) + 1) AS BIGINT) AS bytes FROM repo_events")
def _(t):
    folder = _folder(t)
    t.repo_events.select(F.col("repo_name").alias("value")).write.text(folder)
    return archive.archive_bytes(t.spark, folder).select("bytes")


@query("s1_archive_lines", "SELECT count(*) FILTER (WHERE event_id % 50 <> 0) AS good, count(*) FILTER (WHERE event_id % 50 = 0) AS discarded FROM repo_events")
def _(t):
    line = F.to_json(F.struct("type", F.struct(F.col("repo_name").alias("name")).alias("repo")))
    broken = F.when(F.col("event_id") % 100 == 0, F.lit('{"type": "WatchEvent", "repo": ')).when(F.col("event_id") % 50 == 0, F.lit('{"type": "WatchEvent"}')).otherwise(line)
    parsed = archive.parse_events(t.repo_events.select(broken.alias("value"), "hour"))
    return parsed.agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("discarded"))


@query("s2_payload_lines", """SELECT repo_name, count(DISTINCT CASE WHEN type = 'PullRequestEvent' AND action = 'closed' AND merged THEN number END) AS merged_prs,
 count(*) FILTER (WHERE type = 'ReleaseEvent' AND action = 'published') AS releases FROM repo_events GROUP BY 1""")
def _(t):
    pr = F.struct(F.col("merged").alias("merged"))
    payload = F.to_json(F.struct("action", "number", pr.alias("pull_request"), F.struct(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at")).alias("release")))
    event = F.to_json(F.struct("type", F.struct(F.col("repo_name").alias("name")).alias("repo"), F.struct(F.col("actor_login").alias("login")).alias("actor"), payload.alias("payload")))
    e = archive.parse_events(t.repo_events.select(event.alias("value"), "hour"), payloads=True).filter("ok")
    closed = (F.col("type") == "PullRequestEvent") & (F.col("action") == "closed") & F.col("merged")
    return e.groupBy("repo_name").agg(F.count_distinct(F.when(closed, F.col("number"))).alias("merged_prs"), F.count(F.when((F.col("action") == "published"), F.col("published_at"))).alias("releases"))
