"""Quality rule 1: repeated passages inside one document, found by suffix arrays.

Per document the words get a suffix array with its common-prefix array.  Every
common-prefix interval is a repeated substring; those that extend neither left nor
right are the maximal repeats.  The union of their spans is the repeated part of the
document.  A document is rejected if that part, or its longest repeat, is too large.

Defined cases: a null or empty text has no words and fails the base rule (fewer than
20 words); repeated rows are judged one by one; other columns are ignored, so their
names can't clash; an empty table gives an empty result.  A document is worked on
inside one task, with memory in proportion to the largest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import text as t
from .suffix import lcp_array, maximal_repeats, suffix_array

WINDOW = 8
MIN_WORDS = 20
#: Limits of the method: share of words in repeats, and share of the longest repeat.
MAX_COVERED = 0.25
MAX_LONGEST = 0.20
MIN_LONGEST = 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_maximal_repeats long, longest_repeat long, covered_fraction double"
)


def _duplicate_lines(words: t.Tokens) -> np.ndarray:
    data, off = words.data, words.offsets
    newline = np.flatnonzero(data == 0x0A)
    start = np.unique(np.r_[off[:-1], newline + 1])
    start = start[start < len(data)]
    row = np.searchsorted(off, start, "right") - 1
    end = np.minimum(np.r_[newline, len(data)][np.searchsorted(newline, start)], off[row + 1])
    inside = np.r_[0, np.cumsum(words.inside)]
    has = inside[end] > inside[start]
    start, end, row = start[has], end[has], row[has]
    key = t.mixed(t.piece_hash(words.data, start, end) + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), np.int64)
    again[first] = 0
    return np.bincount(row, again, len(off) - 1).astype(np.int64)


def repetition_rows(column: pa.Array, window: int = WINDOW) -> dict[str, np.ndarray]:
    """The figures of every row of a text column."""
    words = t.Tokens(column)
    rows, n = len(words.counts), len(words.start)
    names = t.mixed(words.hash + words.row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order, place, levels = suffix_array(names)
    lcp = lcp_array(order, levels)
    own = np.maximum(lcp[:-1], lcp[1:])[place] if n else np.zeros(0, np.int64)
    left = np.r_[np.int64(-1), levels[0][: max(n - 1, 0)]][:n]
    starts_row = np.zeros(n, bool)
    starts_row[words.row_off[:-1][words.counts > 0]] = True
    left = np.where(starts_row, -1 - np.arange(n), left)
    at = np.flatnonzero(own >= window)
    in_window = t.covered(n, at, at + window)
    repeats = maximal_repeats(order, lcp, left, window)
    n_maximal, longest = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    if repeats:
        first, _, length = np.array(repeats, np.int64).T
        row = words.row[order[first]]
        n_maximal += np.bincount(row, minlength=rows)
        np.maximum.at(longest, row, length)
    # a suffix's deepest interval either is maximal or lies in a longer one that starts
    # a word earlier, so these spans have the same union as the maximal repeats' spans
    in_repeat = t.covered(n, at, at + own[at])
    counts = words.counts.astype(np.int64)
    char = words.inside & ((words.data & 0xC0) != 0x80)
    n_repeat = words.per_row_of_words(in_window)
    share = words.per_row_of_words(in_repeat) / np.maximum(counts, 1)
    failed = (counts < MIN_WORDS) | (100 * n_repeat > 30 * counts)
    too_long = (longest >= MIN_LONGEST) & (longest > MAX_LONGEST * counts)
    return {
        "n_words": counts,
        "word_chars": words.per_row(char),
        "n_symbols": words.per_row(_SYMBOL[words.data]),
        "n_dup_lines": _duplicate_lines(words),
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "kept": ~failed & (share <= MAX_COVERED) & ~too_long,
        "n_maximal_repeats": n_maximal,
        "longest_repeat": longest,
        "covered_fraction": share,
    }


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in t.pieces(batches):
        out = repetition_rows(part.column(1))
        yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, out.values())], ["doc_id", *out])


def repetition_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its repetition figures and verdict; a narrow job, no shuffle."""
    return t.text_frame(docs, id_col, text_col).mapInArrow(t.task(_score), SCHEMA)


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
