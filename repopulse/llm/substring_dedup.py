"""Substring dedup 6: relative Lempel-Ziv parsing of documents against earlier ones.

A document is factored against what stands in documents with a smaller id: the longest
run of words from a place on that also stands there is a factor, and the next one begins
where it ends.  Factors of at least ``WINDOW`` words become duplicate spans; windows that
lie across a factor's boundary are checked one by one.

The reference is indexed in blocks, by content-defined anchors (``overlap``), so a document
is parsed only against blocks that can hold a long factor:

* a segment that is equal as a whole to one of a smaller id is inside a factor, found by
  an aggregate;
* where an anchor has several contents, a copy of each is parsed greedily against the
  suffix array of the block's contents;
* what that copy loses, the same content also loses where it stands again in the document.

Every window is judged on the input, so the result does not depend on the order of work.

Defined cases: a null or empty text has no words; a document of fewer than ``WINDOW``
words keeps all; rows without an id neither lose words nor make others lose them; rows
that repeat an id are equal in rank and don't affect each other (no other ties arise); a
very long text is one row of many segments, read in memory in proportion to it; other
columns are ignored by ``substring_duplicates`` and kept by ``drop_duplicate_passages``,
whatever their names; an empty table gives an empty result.
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
from .suffix import common_prefix, lcp_array, previous_smaller, suffix_array

WINDOW = 50
UNITS = o.Units(WINDOW, gram=12, long_gram=32, words=True)

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def longest_factors(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """For each word of some contents, one behind the other, how many words from there on
    also stand in a content of a smaller id; and where each content begins."""
    rank = np.unique(np.array([r["doc_id"] for r in rows]), return_inverse=True)[1]
    codes = [np.frombuffer(r["data"], np.uint64) for r in rows]
    length = np.array([len(x) for x in codes])
    begin = np.cumsum(length + 1) - length - 1
    names = np.unique(np.concatenate(codes), return_inverse=True)[1]
    place = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
    data = np.empty(int(length.sum()) + len(rows), np.int64)
    data[place] = names
    data[begin + length] = names.max() + 1 + np.arange(len(rows))  # an end of its own behind each content
    owner = np.repeat(rank, length + 1)
    order, _, levels = suffix_array(data)
    lcp = lcp_array(order, levels)
    near = order[(lcp[:-1] >= WINDOW) | (lcp[1:] >= WINDOW)]
    longest = np.zeros(len(data), np.int64)
    for side in (1, -1):
        way = near[::side]
        found = previous_smaller(owner[way])
        has = np.flatnonzero(found >= 0)
        at = way[has]
        longest[at] = np.maximum(longest[at], common_prefix(levels, at, way[found[has]]))
    return longest, begin


def parse(rows: list[dict]) -> Iterator[tuple[dict, np.ndarray]]:
    """Windows of each content that a smaller id of its anchor group has too, by its factors."""
    longest, begin = longest_factors(rows)
    for r, a in zip(rows, begin.tolist(), strict=True):
        own = longest[a : a + r["n"]]
        starts = np.flatnonzero(own >= WINDOW)
        if not len(starts):
            continue
        hit = np.zeros(r["n"], bool)
        at = int(starts[0])
        while at < len(own):
            size = int(own[at])
            if size < WINDOW:  # no factor from here: on to the next place that has one
                at = int(starts[k]) if (k := int(np.searchsorted(starts, at))) < len(starts) else len(own)
                continue
            last = at + size - WINDOW + 1
            hit[at:last] = True
            hit[last : at + size] = own[last : at + size] >= WINDOW  # windows across the boundary
            at += size
        yield r, hit


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """Word spans (doc_id, tag, start, end) that stand in a document with a smaller id; docs: doc_id, text, tag."""
    named = docs.filter("doc_id IS NOT NULL")
    return o.spans(named, UNITS, parse, lambda rows: rows.filter("doc_id > first.doc_id"), lambda rows: rows.filter("doc_id > first.doc_id"), follow=True)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in t.pieces(batches):
        words = t.Tokens(part.column(1))
        gone = o.removed(part, 2, words.row_off)
        raw = words.data.tobytes()
        start, end = words.start.tolist(), words.end.tolist()
        shas = []
        for a, b in zip(words.row_off[:-1].tolist(), words.row_off[1:].tolist(), strict=True):
            kept = (np.flatnonzero(~gone[a:b]) + a).tolist()
            shas.append(hashlib.sha256(b" ".join([raw[start[i] : end[i]] for i in kept])).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(words.counts.astype(np.int64)), pa.array(words.per_row_of_words(gone)), pa.array(shas), part.column(2)],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"],
        )


def substring_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, removed words, hash of the kept words, duplicate spans."""
    base = o.tagged(t.text_frame(docs, id_col, text_col))
    return o.with_spans(base, duplicate_spans(base)).mapInArrow(t.task(_digest), SCHEMA)


def drop_duplicate_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the duplicate words; texts that lose none stay as they are.

    Kept words are joined by one space.  All other columns are unchanged.
    """
    base = o.tagged(t.text_frame(docs, id_col, text_col))
    lists = duplicate_spans(base).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    row = row.withColumn("tag", F.xxhash64("text"))
    paired = row.alias("d").join(lists.alias("s"), o.same_row("d", "s"), "left").select("d.row", "d.text", "s.spans")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in t.pieces(batches):
            words = t.Tokens(part.column(1))
            gone = o.removed(part, 2, words.row_off)
            raw, texts = words.data.tobytes(), part.column(0).field(text_col).to_pylist()
            for r in np.flatnonzero(words.per_row_of_words(gone)):
                a, b = words.row_off[r], words.row_off[r + 1]
                kept = np.flatnonzero(~gone[a:b]) + a
                texts[r] = b" ".join([raw[words.start[i] : words.end[i]] for i in kept]).decode(errors="replace")
            columns = [pa.array(texts, pa.string()) if f.name == text_col else part.column(0).field(f.name) for f in part.column(0).type]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in part.column(0).type])

    return paired.mapInArrow(t.task(run), schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


_WORD = r"[^\x20\x09-\x0D]+"

ORACLE = {
    "op6_substring_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM d WHERE len(w) >= {WINDOW})),
f AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT win.doc_id, unnest(generate_series(i, i + {WINDOW - 1})) AS p FROM win JOIN f USING (h) WHERE win.doc_id > first)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
}
