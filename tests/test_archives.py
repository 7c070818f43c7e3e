from __future__ import annotations

import calendar
import gzip
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from repopulse.sources import files
from repopulse.streaming import archives, state

T0 = calendar.timegm((2024, 1, 10, 0, 0, 0))


def name(h):
    import time

    return time.strftime("%Y-%m-%d-%H", time.gmtime(T0 + h * 3600))


def write(folder, h, repos, cut=0, junk=0):
    lines = [json.dumps({"type": "WatchEvent", "repo": {"name": r}}) for r in repos] + ["{not json"] * junk + ["", " "]
    data = gzip.compress("\n".join(lines).encode())
    (folder / f"{name(h)}.json.gz").write_bytes(data[: len(data) - cut] if cut else data)


@pytest.fixture
def place(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def job(spark, place, **more):
    return archives.Ingest(spark, str(place / "store"), **{"window_hours": 6, **more})


def outcomes(j):
    return {r.archive: (r.outcome, r.failures) for r in j.latest().collect()}


def totals(j):
    got = {r.repo_name: r.total for r in j.totals().collect()}
    recount = {r.repo_name: r.n for r in j.rollup().groupBy("repo_name").agg(F.sum("event_count").alias("n")).collect()}
    assert got == recount
    return got


def test_damaged_archives_cost_their_own_hour_only(spark, place):
    src, errors = place / "in", []
    write(src, 0, ["a/x", "a/x", "b/y"], junk=2)
    write(src, 1, ["a/x"], cut=6)
    write(src, 2, ["c/z"], cut=6)
    (src / "2024-01-10-03.json.gz").write_bytes(b"no gzip")
    (src / "notes.json.gz").write_bytes(gzip.compress(b"x"))
    j = job(spark, place, hooks=archives.Hooks(error=[lambda *e: errors.append(e)]))
    now = T0 + 12 * 3600
    j.run_cycle(str(src), now)
    assert outcomes(j) == {name(0): ("ok", 0), name(1): ("failed", 1), name(2): ("failed", 1), name(3): ("failed", 1), "notes": ("skipped", 0)}
    assert totals(j) == {"a/x": 2, "b/y": 1}
    assert [(r.kept, r.discarded, r.by_type) for r in j.latest().filter(F.col("archive") == name(0)).collect()] == [(3, 2, {"WatchEvent": 3})]
    write(src, 1, ["a/x"])
    for _ in range(4):
        j.run_cycle(str(src), now)
    assert outcomes(j)[name(1)] == ("ok", 0) and outcomes(j)[name(2)] == ("skipped", 5)
    assert totals(j) == {"a/x": 3, "b/y": 1}
    assert max(e[1] for e in errors if e[0] == name(2)) == 5
    write(src, 2, ["c/z"])  # too late: it isn't opened again
    cycle = j.run_cycle(str(src), now)
    assert not j.ledger().filter((F.col("archive") == name(2)) & (F.col("cycle") == cycle)).count() and totals(j) == {"a/x": 3, "b/y": 1}


def test_hours_wait_until_they_are_complete(spark, place):
    write(place / "in", 0, ["a/x"])
    j, heard = job(spark, place), []
    j.hooks.lag.append(lambda *x: heard.append(x))
    j.run_cycle(str(place / "in"), T0 + 5399)
    assert outcomes(j) == {name(0): ("waiting", 0)} and totals(j) == {}
    j.run_cycle(str(place / "in"), T0 + 5400)
    assert outcomes(j) == {name(0): ("ok", 0)} and totals(j) == {"a/x": 1} and heard == [(name(0), 5399), (name(0), 5400)]


def test_the_window_moves_and_late_hours_drop(spark, place):
    src, now = place / "in", T0 + 100 * 3600
    counts = Counter()
    for h in (10, 11, 12):
        write(src, h, ["a/x"] * h + ["b/y"])
        counts[h] = h
    j = job(spark, place, files_per_batch=2)
    j.run_cycle(str(src), now)
    for h in (7, 6):  # one still inside the six hours behind hour 12, one outside
        write(src, h, ["a/x"] * h)
    j.run_cycle(str(src), now)
    assert outcomes(j)[name(7)] == ("ok", 0) and outcomes(j)[name(6)] == ("late", 0)
    assert totals(j) == {"a/x": 10 + 11 + 12 + 7, "b/y": 3}
    write(src, 17, ["c/z"])
    j.run_cycle(str(src), now)
    assert totals(j) == {"a/x": 12, "b/y": 1, "c/z": 1}
    assert files.names(spark, j.rollup_path)[-2:] == [f"hour_key={name(12)}", f"hour_key={name(17)}"] and f"hour_key={name(10)}" not in files.names(spark, j.rollup_path)
    write(src, 30, [])
    j.run_cycle(str(src), now)
    assert totals(j) == {} and outcomes(j)[name(30)] == ("ok", 0)


def test_a_replayed_hour_replaces_itself(spark, place):
    src, now = place / "in", T0 + 50 * 3600
    write(src, 1, ["a/x", "b/y"])
    write(src, 2, ["a/x"])
    j = job(spark, place)
    j.run_cycle(str(src), now)
    for repos in (["a/x", "a/x"], []):
        (src / f"again{len(repos)}").mkdir()
        write(src / f"again{len(repos)}", 1, repos)
        j.run_cycle(str(src), now)
        assert totals(j) == {"a/x": 1 + len(repos)}


def test_a_batch_that_breaks_off_adds_nothing_twice(spark, place, monkeypatch):
    src, now = place / "in", T0 + 50 * 3600
    write(src, 1, ["a/x", "b/y"])
    for h, breaks in enumerate(("write_rollup", "_evict", "ledger"), 2):
        write(src, h, ["a/x"])
        j = job(spark, place)
        with monkeypatch.context() as m:
            def stop(*_, **__):
                raise KeyError("lost")
            if breaks == "write_rollup":
                m.setattr(archives.sinks, "write_rollup", stop)
            elif breaks == "_evict":
                m.setattr(archives.Ingest, "_evict", stop)
            else:
                m.setattr(archives.files, "delete", stop)
            with pytest.raises(Exception):  # noqa: B017
                j.run_cycle(str(src), now)
        j.run_cycle(str(src), now)
        assert totals(j)["a/x"] == h
    assert {r.outcome for r in j.latest().collect()} == {"ok"}


def test_state_rewrites_touched_buckets_only(spark, tmp_path):
    folder, schema = str(tmp_path / "s"), "k string, n long"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    add = lambda a, b: a.unionByName(b).groupBy("k").agg(F.sum("n").alias("n"))
    first = state.update(folder, "v1", rows(*[(f"k{i}", 1) for i in range(200)]), "k", schema, add)
    assert len(first) == state.BUCKETS
    assert len(state.update(folder, "v2", rows(("k3", 5)), "k", schema, add)) == 1
    assert state.update(folder, "v2", rows(("k3", 5)), "k", schema, add)  # again, from the state before it
    got = {r.k: r.n for r in state.current(spark, folder, schema).collect()}
    assert got == {**{f"k{i}": 1 for i in range(200)}, "k3": 6}
    assert sorted(files.names(spark, f"{folder}/data")) == ["v1", "v2"] and len(files.names(spark, f"{folder}/data/v2")) == 2
