"""Vectorised text helpers used inside Arrow tasks.

A task receives Arrow record batches.  ``pieces`` cuts them into slices of a few
megabytes of text, so that a worker's memory depends on the slice (or on the
longest single document), not on the batch; ``Tokens`` finds the words of a whole
slice at once with numpy and gives each a 64-bit hash.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000

#: The two word alphabets of the contracts, by byte of UTF-8.
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_SPACE_WORD = np.ones(256, bool)
_SPACE_WORD[list(SPACES)] = False
_ALNUM_WORD = np.zeros(256, bool)
_ALNUM_WORD[0x30:0x3A] = _ALNUM_WORD[0x61:0x7B] = _ALNUM_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODES = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}
_held: dict[str, object] = {}


def held(key: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept by the worker process from task to task.

    One thing at a time: whatever an earlier stage has left is dropped first, so that a
    worker which serves many stages is no larger than its largest one.
    """
    if key not in _held:
        _held.clear()
        slim()
        _held[key] = make()
    return _held[key]


def slim() -> None:
    """Gives memory that is free inside the process back to the machine."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def forget() -> None:
    """Drops what an earlier stage has left in this worker."""
    _held.clear()


def task(run: Callable) -> Callable:
    """A function of batches that drops what earlier stages hold and leaves its worker slim."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        try:
            yield from run(batches)
        finally:
            slim()

    return wrapped


def holding(run: Callable) -> Callable:
    """The same for a function that asks for ``held`` itself."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            slim()

    return wrapped


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64, kept for the task."""
    if len(_powers.get("up", ())) < n:
        n = max(n, SLICE_BYTES // 8 + 1)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[key] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash over uint64 codes; ``span_hash`` reads them."""
    up, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end] for many spans, equal for equal contents."""
    _, down = powers(len(prefix))
    return mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def _multipliers(n: int) -> np.ndarray:
    """A number for each place in a span, without any structure from place to place."""
    if len(_powers.get("places", ())) < n:
        _powers["places"] = mixed(np.arange(1, max(n, 4096) + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    return _powers["places"][:n]


def piece_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of many byte spans, equal for equal contents, whatever their length.

    Each byte is weighed by its place in the span.  (``span_hash`` weighs by powers, which on texts of
    1,024 units and more can be equal for certain, whatever the base.)  Spans are worked on in parts.
    """
    out = np.empty(len(start), np.uint64)
    size = end - start
    offsets = np.r_[0, np.cumsum(size)]
    at = 0
    while at < len(start):
        to = max(int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1, at + 1)
        own, first = size[at:to], offsets[at:to] - offsets[at]
        place = np.arange(offsets[to] - offsets[at]) - np.repeat(first, own)
        codes = _CODES[data[np.repeat(start[at:to], own) + place]]
        total = np.zeros(len(place) + 1, np.uint64)
        np.cumsum(codes * _multipliers(int(own.max(initial=1)))[place], out=total[1:])
        out[at:to] = mixed(total[first + own] - total[first] + own.astype(np.uint64) * _BASE)
        at = to
    return out


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _CODES[data]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def runs(member: np.ndarray, data: np.ndarray, offsets: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the maximal runs of a set of bytes, at least so long, cut between rows."""
    inside = member[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    good = end - start >= least
    return start[good], end[good]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, rows whole."""
    for batch in batches:
        _, off = string_buffers(batch.column(batch.schema.get_field_index(text)))
        row, n = 0, batch.num_rows
        while row < n:
            end = int(np.searchsorted(off, off[row] + limit, "right")) - 1
            end = min(n, max(end, row + 1), row + 20_000)
            yield batch.slice(row, end - row)
            row = end


class Tokens:
    """Words of every row of a string column.

    ``data``/``offsets``: the bytes (lower-cased A-Z if asked) and row offsets;
    ``start``/``end``: byte span of each word; ``row_off``: word range of each row;
    ``row``: row of each word; ``hash``: 64-bit hash of each word.
    """

    def __init__(self, column: pa.Array | tuple[np.ndarray, np.ndarray], lower: bool = False, spaced: bool = True) -> None:
        data, self.offsets = column if isinstance(column, tuple) else string_buffers(column)
        self.data = LOWER[data] if lower else data
        n = len(self.data)
        inside = (_SPACE_WORD if spaced else _ALNUM_WORD)[self.data]
        self.inside = inside
        first = np.empty(n, bool)
        last = np.empty(n, bool)
        if n:
            first[0], last[-1] = inside[0], inside[-1]
            np.greater(inside[1:], inside[:-1], out=first[1:])
            np.greater(inside[:-1], inside[1:], out=last[:-1])
            cut = self.offsets[(self.offsets > 0) & (self.offsets < n)]
            first[cut] = inside[cut]
            last[cut - 1] = inside[cut - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row_off = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.row_off)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = piece_hash(self.data, self.start, self.end)
        return self._hash

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over each row."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def per_row_of_words(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-word array over each row."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.row_off[1:]] - total[self.row_off[:-1]]


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any span [start, end)."""
    step = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(step)[:n] > 0


def text_frame(docs, id_col: str, text_col: str):
    """The two columns that an operator reads, under fixed names and types."""
    from pyspark.sql import functions as F

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
