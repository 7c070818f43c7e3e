"""Which windows of W consecutive units also occur elsewhere, for whole corpora.

Shared by the two substring removals (units are words or bytes).  Emitting every window
would multiply the corpus, so windows are first grouped by content-defined anchors: the
smallest hash among the K-unit grams of a window.  Equal windows have equal anchors at
equal places.  Consecutive windows with one anchor form a segment, and a row for each
segment (about two in W - K units) is all that is shuffled:

1. anchors seen twice are found by a map-side combined count; the rest is dropped;
2. segments with equal content are equal in all their windows: one minimum or count for
   each (anchor, content);
3. anchors with several contents need a closer look.  One copy of each content is
   fetched and compared window by window in blocks of whole anchor groups;
4. the contents of an anchor with more than ``HOT`` of them (a common line, say) are cut
   again by longer anchors, which tell them apart, and go through 2 and 3 once more; what
   is hot even then is compared by rows of window hashes.  All ways are exact, and none
   has a group without a bound in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from . import text as t

#: An anchor with more distinct contents than this is compared by window hashes.
HOT = 400
#: Units that one block of anchor groups may hold.
BLOCK_UNITS = 200_000

#: A span, the start of the segment it was found in, and of the content which that was cut from.
SPAN = "doc_id long, tag long, start int, end int, part int, within int"
SEGMENT = "anchor long, content long, doc_id long, tag long, start int, n int"


@dataclass(frozen=True)
class Units:
    """How a text column becomes units: codes, and the unit range of each row."""

    window: int
    gram: int
    long_gram: int
    words: bool

    @property
    def slice_bytes(self) -> int:
        return t.SLICE_BYTES if self.words else t.SLICE_BYTES // 3

    def codes(self, data: list[bytes]) -> np.ndarray:
        """Codes of fetched contents, one behind the other."""
        joined = b"".join(data)
        return np.frombuffer(joined, np.uint64) if self.words else t.byte_codes(np.frombuffer(joined, np.uint8))

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, unit range of each row, and the bytes."""
        if self.words:
            words = t.Tokens(column)
            return words.hash, words.row_off, words.data
        data, off = t.string_buffers(column)
        return t.byte_codes(data), off, data


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost place of the minimum of each run of ``width`` values."""
    at = np.arange(len(values))
    span = 1
    while span < width:
        step = min(span, width - span)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(values[a] <= values[b], a, b)
        span += step
    return at


def segments(codes: np.ndarray, off: np.ndarray, window: int, gram: int):
    """Segments of all rows: (row, start in the row, windows, anchor hash, content hash, first unit)."""
    n = len(codes)
    prefix = t.prefix_hash(codes)
    empty = np.zeros(0, np.int64)
    if n < window:
        return (empty,) * 3 + (np.zeros(0, np.uint64),) * 2 + (empty,), prefix
    at = np.arange(n - gram + 1)
    grams = t.span_hash(prefix, at, at + gram)
    anchor = _sliding_argmin(grams, window - gram + 1)  # one for each window
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    valid = row[: n - window + 1] == row[window - 1 :]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]) | (row[1 : n - window + 1] != row[: n - window])]
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(anchor)]
    ok = valid[begin]
    begin, end = begin[ok], end[ok]
    place = anchor[begin]
    content = t.span_hash(prefix, begin, end - 1 + window)
    # the anchor's place in the content is part of it
    content = t.mixed(content + (place - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (row[begin], begin - off[row[begin]], end - begin, grams[place], content, begin), prefix


def _segment_rows(units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in t.pieces(batches, limit=units.slice_bytes):
            codes, off, _ = units.read(part.column(1))
            (row, start, n, anchor, content, _), _ = segments(codes, off, units.window, units.gram)
            if len(row):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), part.column(0).take(pa.array(row)), part.column(2).take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                    [x.split()[0] for x in SEGMENT.split(", ")],
                )

    return run


def shared_segments(docs: DataFrame, units: Units) -> DataFrame:
    """Segments whose anchor occurs at least twice; ``several``: their anchor has more contents than one.

    ``docs``: doc_id, text, tag.  The rows are read twice, so they are written once.  The
    anchors found are written too, so that the join has a shuffle of its own on either side
    and a hot anchor can be split.
    """
    rows = kept_in(docs.sparkSession, docs.select("doc_id", "text", "tag").mapInArrow(t.task(_segment_rows(units)), SEGMENT), "rows")
    twice = kept_in(docs.sparkSession,
        rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("times"), F.min("content").alias("low"), F.max("content").alias("high"))
        .filter("times > 1").select("anchor", (F.col("low") != F.col("high")).alias("several")),
        "anchors")
    return rows.join(twice, "anchor")


def contents(shared: DataFrame) -> DataFrame:
    """One row for each (anchor, content): how often, its first occurrence, and the last one in the same document."""
    return shared.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "tag", "start", "n")).alias("first"), _last(), F.first("several").alias("several")
    )


def _last():
    """The last occurrence in the document of the first one; ``~`` turns the order of ids around."""
    return F.max(F.struct(F.bitwise_not("doc_id").alias("doc_id"), "tag", "start")).alias("last")


def has_hot(found: DataFrame) -> bool:
    """Whether any anchor has more than ``HOT`` contents."""
    return bool(found.filter("several").groupBy("anchor").count().filter(F.col("count") > HOT).take(1))


FETCHED = "anchor long, times long, doc_id long, tag long, start int, n int, data binary"


def fetched(docs: DataFrame, found: DataFrame, units: Units, hot: bool) -> DataFrame:
    """The contents of the cold or of the hot anchors with their units, from the texts that
    hold their first occurrences; a unit is a byte, or a word's hash."""
    found = found.filter("several")
    kinds = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter((F.col("kinds") > HOT) == hot)
    wanted = (
        found.join(kinds, "anchor")
        .select("first.doc_id", "first.tag", F.struct("anchor", "times", "first.start", "first.n").alias("of"))
        .groupBy("doc_id", "tag").agg(F.collect_list("of").alias("of"))
    )
    pairs = docs.alias("d").join(wanted.alias("w"), same_row("d", "w")).select("d.doc_id", "d.text", "d.tag", "w.of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in t.pieces(batches, limit=units.slice_bytes):
            codes, off, raw = units.read(part.column(1))
            kept = codes if units.words else raw
            of = part.column(3)
            flat = of.flatten()
            row = np.repeat(np.arange(part.num_rows), of.value_lengths().to_numpy())
            start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            out = [kept[a : a + k - 1 + units.window].tobytes() for a, k in zip((off[row] + start).tolist(), n.tolist(), strict=True)]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [flat.field("anchor"), flat.field("times"), part.column(0).take(take), part.column(2).take(take), flat.field("start"), flat.field("n"), pa.array(out, pa.binary())],
                [x.split()[0] for x in FETCHED.split(", ")],
            )

    return pairs.mapInArrow(t.task(run), FETCHED)


def cut_again(rows: DataFrame, units: Units) -> DataFrame:
    """Segments of fetched contents by longer anchors, each with its units: FETCHED with
    ``content``, and ``within``, the start of the content that was cut."""
    names = ["anchor", "content", "times", "doc_id", "tag", "start", "n", "data", "within"]
    size = 8 if units.words else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                data = part.column(6).to_pylist()
                off = np.r_[0, np.cumsum([len(x) // size for x in data])]
                (row, start, n, anchor, content, first), _ = segments(units.codes(data), off, units.window, units.long_gram)
                if not len(row):
                    continue
                # the first anchor stays part of the key: contents of different anchors never match
                anchor = t.mixed(anchor ^ part.column(0).to_numpy().view(np.uint64)[row])
                joined = b"".join(data)
                own = [joined[size * a : size * (a + k - 1 + units.window)] for a, k in zip(first.tolist(), n.tolist(), strict=True)]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), part.column(1).take(take), part.column(2).take(take), part.column(3).take(take),
                     pa.array((part.column(4).to_numpy()[row] + start).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(own, pa.binary()), part.column(4).take(take)],
                    names,
                )

    return rows.mapInArrow(t.task(run), "anchor long, content long, times long, doc_id long, tag long, start int, n int, data binary, within int")


def window_hashes(rows: list[dict], units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of some contents, and the number of windows of each content."""
    n = np.array([r["n"] for r in rows])
    prefix = t.prefix_hash(units.codes([r["data"] for r in rows]))
    length = n - 1 + units.window
    begin = np.repeat(np.cumsum(length) - length, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return t.span_hash(prefix, begin, begin + units.window), n


def in_blocks(rows: DataFrame, units: Units, flag: Callable[[list[dict]], Iterator[tuple[dict, np.ndarray]]]) -> DataFrame:
    """Spans of flagged windows, from blocks of whole anchor groups.

    ``flag`` gets the rows of a block and yields each row with its flagged windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, last = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if size >= BLOCK_UNITS and row["anchor"] != last:
                    yield from _spans(flag(held), units.window)
                    held, size = [], 0
                last = row["anchor"]
                size += row["n"] + units.window
                held.append(row)
        if held:
            yield from _spans(flag(held), units.window)

    ordered = rows.repartition(partitions(rows), "anchor").sortWithinPartitions("anchor", "doc_id", "tag", "start")
    return ordered.mapInArrow(t.task(run), SPAN)


def _spans(flagged: Iterator[tuple[dict, np.ndarray]], window: int) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row, hit in flagged:
        edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            out.append((row["doc_id"], row["tag"], row["start"] + a, row["start"] + b - 1 + window, row["start"], row.get("within", row["start"])))
    if out:
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in SPAN.split(", ")])


def exploded(rows: DataFrame, units: Units) -> DataFrame:
    """A row for each window of the contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                hashes, n = window_hashes(part.select(["n", "data"]).to_pylist(), units)
                row = pa.array(np.repeat(np.arange(len(n)), n))
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = part.column(4).take(row).to_numpy() + nth
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), *(part.column(i).take(row) for i in (1, 2, 3)), pa.array(start.astype(np.int32)), part.column(4).take(row), part.column(7).take(row)],
                    ["hash", "times", "doc_id", "tag", "start", "part", "within"],
                )

    return rows.mapInArrow(t.task(run), "hash long, times long, doc_id long, tag long, start int, part int, within int")


def followed(flagged: DataFrame, found: DataFrame, rows: DataFrame, at: str, within: str) -> DataFrame:
    """Spans of first occurrences, for the further occurrences in their own documents.

    flagged: spans, with the start of their content's first occurrence in ``at``.  found:
    contents with ``first`` and ``last``.  rows: all occurrences; ``within``: the column of
    the start of what theirs was cut from.
    """
    first = found.filter("times > 1 AND (last.tag <> first.tag OR last.start <> first.start)").select(
        "anchor", "content", F.col("first.doc_id").alias("doc_id"), F.col("first.tag").alias("tag"), F.col("first.start").alias(at)
    )
    # rows that repeat an id and a text give the same spans: once is enough
    moved = flagged.select("doc_id", "tag", at, "start", "end").distinct().join(first, ["doc_id", "tag", at])
    moved = kept_in(flagged.sparkSession, moved.select(
        "anchor", "content", "doc_id", F.col("tag").alias("_tag"), F.col(at).alias("_at"), (F.col("start") - F.col(at)).alias("_from"), (F.col("end") - F.col(at)).alias("_to")),
        "moved")
    here = rows.select("anchor", "content", "doc_id", "tag", F.col("start").alias("part"), F.col(within).alias("within"))
    return here.join(moved, ["anchor", "content", "doc_id"]).filter("tag <> _tag OR part <> _at").select(
        "doc_id", "tag", (F.col("part") + F.col("_from")).alias("start"), (F.col("part") + F.col("_to")).alias("end"), "part", "within"
    )


def has_followers(found: DataFrame) -> bool:
    """Whether any content that is judged by its windows stands several times in the document of its first occurrence."""
    return bool(found.filter("times > 1 AND (last.tag <> first.tag OR last.start <> first.start)").take(1))


def spans(docs: DataFrame, units: Units, flag: Callable[[list[dict]], Iterator[tuple[dict, np.ndarray]]], again: Callable[[DataFrame], DataFrame], seen: Callable[[DataFrame], DataFrame], follow: bool = False) -> DataFrame:
    """Unit spans (doc_id, tag, start, end) of the windows that go.

    flag: rows of a block -> rows with their flagged windows.  again: occurrences
    (anchor, content, doc_id, tag, start, n, times, first) of contents that occur several
    times -> those that go as a whole.  seen: windows (hash, doc_id, tag, start) with
    their ``kinds`` and ``first`` -> those that go.  flag and seen judge the first
    occurrence of a content; with ``follow`` the other ones in its document, which again
    leaves, lose the same windows.
    """
    spark = docs.sparkSession

    def ends(rows: DataFrame, within: str) -> DataFrame:
        return rows.select("doc_id", "tag", "start", (F.col("start") + F.col("n") - 1 + units.window).cast("int").alias("end"), F.col("start").alias("part"), F.col(within).alias("within"))

    shared = kept_in(spark, shared_segments(docs, units), "segments")
    found = kept_in(spark, contents(shared), "contents")  # read several times; joins with it can split hot keys
    whole = shared.join(found.filter("times > 1").select("anchor", "content", "times", "first"), ["anchor", "content"])
    out = ends(again(whole), "start")
    flagged = in_blocks(fetched(docs, found, units, hot=False), units, flag)
    if has_hot(found):
        flagged = flagged.unionByName(hot_spans(docs, found, units, flag, again, seen, follow, ends))
    # written by itself, so that a hot key of the join with whole segments is split without regard to these
    flagged = kept_in(spark, flagged, "flagged")
    several = found.filter("several")
    if follow and has_followers(several):
        out = out.unionByName(followed(flagged, several, shared, "within", "start"))
    return out.unionByName(flagged).select("doc_id", "tag", "start", "end")


def hot_spans(docs: DataFrame, found: DataFrame, units: Units, flag: Callable, again: Callable, seen: Callable, follow: bool, ends: Callable) -> DataFrame:
    """Spans in the first occurrences of the contents of hot anchors."""
    spark = docs.sparkSession
    parts = kept_in(spark, cut_again(fetched(docs, found, units, hot=True), units), "parts")
    kinds = parts.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "tag", "start", "n", "within")).alias("first"), _last(), F.min_by("data", F.struct("doc_id", "tag", "start")).alias("data")
    )
    kinds = kept_in(spark, kinds, "contents")
    first = F.struct("first.doc_id", "first.tag", "first.start", "first.n").alias("first")
    whole = parts.select("anchor", "content", "doc_id", "tag", "start", "n", "within").join(kinds.filter("times > 1").select("anchor", "content", "times", first), ["anchor", "content"])
    many = kept_in(spark, kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "kinds")
    rows = kinds.join(many, "anchor").select("anchor", "times", "first.doc_id", "first.tag", "first.start", "first.n", "data", "first.within", "kinds")
    out = ends(again(whole), "within")
    flagged = in_blocks(rows.filter(F.col("kinds") <= HOT).drop("kinds"), units, flag)
    if many.filter(F.col("kinds") > HOT).take(1):
        windows = exploded(rows.filter(F.col("kinds") > HOT).drop("kinds"), units)
        known = windows.groupBy("hash").agg(F.count(F.lit(1)).alias("kinds"), F.min(F.struct("doc_id", "tag", "start")).alias("first")).filter("kinds > 1")
        known = kept_in(spark, known, "windows")
        gone = seen(windows.join(known, "hash"))
        flagged = flagged.unionByName(gone.select("doc_id", "tag", "start", (F.col("start") + units.window).cast("int").alias("end"), "part", "within"))
    if follow and has_followers(kinds):
        flagged = kept_in(spark, flagged, "flagged")
        out = out.unionByName(followed(flagged, kinds, parts, "part", "within"))
    return out.unionByName(flagged)


def same_row(a: str, b: str):
    """Join condition on a row's id and text hash; rows without an id match by their text."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.tag").eqNullSafe(F.col(f"{b}.tag"))


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text; texts that are null read as empty."""
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tag", F.xxhash64("text"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every document with the list of its spans (null: none)."""
    lists = spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return docs.alias("d").join(lists.alias("s"), same_row("d", "s"), "left").select("d.doc_id", "d.text", "s.spans")


def removed(part: pa.RecordBatch, at: int, sizes: np.ndarray) -> np.ndarray:
    """Flags of the units of a batch that its span lists cover; sizes: unit offsets of the rows."""
    of = part.column(at)
    lengths = of.value_lengths().fill_null(0).to_numpy()
    flat = of.flatten()
    base = np.repeat(sizes[:-1], lengths)
    return t.covered(int(sizes[-1]), flat.field("start").to_numpy() + base, flat.field("end").to_numpy() + base)


def partitions(frame: DataFrame) -> int:
    """Shuffle partitions of the session.  Given as a number they aren't merged for being
    small: blocks cost far more to work on than to read."""
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def kept_in(spark, frame: DataFrame, name: str) -> DataFrame:
    """Writes a table to the cluster's shared checkpoint folder and reads it back."""
    return written(frame, name)
