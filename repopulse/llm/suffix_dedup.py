"""Suffix-array dedup 8: repeated byte strings by longest-previous-factor arrays.

Texts are UTF-8 bytes.  A position whose longest earlier match has at least ``WINDOW``
bytes starts a copy.  Earlier matches come from the longest-previous-factor array: in
suffix order, the nearest smaller positions before and after a suffix give its longest
earlier match; the same with larger positions gives the longest later one.

One suffix array of a corpus fits no task, so the work is cut by content-defined anchors
(``overlap``): equal 200-byte strings share an anchor.  Contents that are equal as a
whole need a count only; the different contents of an anchor meet in a block, which gets
a suffix array of its own.

``keep_first`` removes later copies and keeps the first (by id, then text hash, then
place); without it, every string that occurs elsewhere goes, the first one too.

Defined cases: a null text is empty; texts shorter than ``WINDOW`` bytes keep all; rows
without an id and repeated rows are documents like others, ties of ``keep_first`` go as
said; removal may cut a character in two, so the kept bytes are hashed, not decoded; a very
long text is one row of many segments, read in memory in proportion to it; other columns
are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import overlap as o
from . import text as t
from .suffix import lcp_array, previous_factors, suffix_array

WINDOW = 200
#: Bytes that suffix sorting starts from; it divides ``WINDOW``.
UNIT = 8
UNITS = o.Units(WINDOW, gram=32, long_gram=128, words=False)

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def factors(rows: list[dict], keep_first: bool, window: int = WINDOW) -> Iterator[tuple[dict, np.ndarray]]:
    """Windows of each content that have a match of ``window`` bytes in another one."""
    size = np.array([r["n"] for r in rows])
    length = size + window - 1
    end = np.cumsum(length + 1)  # a place of its own stands behind each content
    data = np.zeros(int(end[-1]) + UNIT, np.uint8)
    inside = np.ones(len(data), bool)
    inside[end - 1] = inside[end[-1] :] = False
    data[inside] = np.frombuffer(b"".join(r["data"] for r in rows), np.uint8)
    # a name is the ``UNIT`` bytes from a position on; one that leaves its content occurs once only
    names = np.ndarray(end[-1], ">u8", data.tobytes(), strides=(1,)).astype(np.uint64)
    away = np.r_[0, np.cumsum(~inside)]
    across = away[UNIT : end[-1] + UNIT] > away[: end[-1]]
    known, names = np.unique(names, return_inverse=True)
    names[across] = len(known) + np.arange(across.sum())
    order, _, levels = suffix_array(names, window, UNIT)
    lcp = lcp_array(order, levels, UNIT)
    near = (lcp[:-1] >= window) | (lcp[1:] >= window)
    earlier, later = previous_factors(order[near], levels, UNIT)
    hit = earlier >= window
    if not keep_first:
        hit |= later >= window
    for r, a, n in zip(rows, end - length - 1, size, strict=True):
        if hit[a : a + n].any():
            yield r, hit[a : a + n]


def duplicate_spans(docs: DataFrame, keep_first: bool) -> DataFrame:
    """Byte spans (doc_id, tag, start, end) that occur elsewhere; docs: doc_id, text, tag."""
    def again(rows: DataFrame) -> DataFrame:
        return rows.filter(F.struct("doc_id", "tag", "start", "n") > F.col("first")) if keep_first else rows

    def seen(rows: DataFrame) -> DataFrame:
        return rows.filter(F.struct("doc_id", "tag", "start") > F.col("first")) if keep_first else rows

    return o.spans(docs, UNITS, lambda block: factors(block, keep_first), again, seen)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in t.pieces(batches):
        data, off = t.string_buffers(part.column(1))
        gone = o.removed(part, 2, off)
        total = np.r_[0, np.cumsum(gone)]
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        cut = off[:-1][off[:-1] < len(data)]
        first[cut] = gone[cut]
        runs = np.r_[0, np.cumsum(first)]
        kept = data[~gone].tobytes()
        at = off - total[off]  # places of the rows in the kept bytes
        shas = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(np.diff(off)), pa.array(np.diff(total[off])), pa.array(np.diff(runs[off])), pa.array(shas, pa.string()), part.column(2)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def suffix_duplicates(docs: DataFrame, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: bytes, removed bytes, removed runs, hash of the kept bytes, spans."""
    base = o.tagged(t.text_frame(docs, id_col, text_col))
    return o.with_spans(base, duplicate_spans(base, keep_first)).mapInArrow(t.task(_digest), SCHEMA)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_first=False).drop("spans")


ORACLE = {
    "op8_suffix_dedup": f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, {2 * WINDOW})) AS h
  FROM (SELECT doc_id, x, unnest(generate_series(0, len(x) // 2 - {WINDOW})) AS i FROM d WHERE len(x) >= {2 * WINDOW})),
f AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {WINDOW} THEN 0 ELSE 1 END AS new FROM win SEMI JOIN f USING (h)),
span AS (SELECT doc_id, min(i) AS s, max(i) + {WINDOW} AS e
  FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit) GROUP BY doc_id, g),
part AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS was FROM span),
kept AS (SELECT d.doc_id, count(*) AS n, sum(e - s) AS gone, max(e) AS last, string_agg(substr(x, 2 * was + 1, 2 * (s - was)), '' ORDER BY s) AS k
  FROM part JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(k, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
}
