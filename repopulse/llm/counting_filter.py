"""Counting quotient filters: lossless, compact, sorted counters of packed n-grams.

An n-gram of word ids is a number of ``size * bits`` bits in two halves.  A Feistel
network permutes it, which is invertible, so that equal shares of any input fall to each
value of its leading bits.  Those name the shard; the next bits are the quotient, and all
that is left is kept as the full remainder, so nothing is lost.  A filter stores, in order,
two bits a slot (quotients that occur, ends of their runs), remainders in whole bytes, and
counters of one byte with an escape for larger ones.  Sorted filters are merged by
adding the counters of equal keys.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

from .text import mixed

_HEAD = struct.Struct("<QBBBQ")
_ROUNDS = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
Words = tuple[np.ndarray, ...]


class Entries(NamedTuple):
    """Keys of one shard in order, leading part and rest (if the key has more than 64 bits), with counts."""

    top: np.ndarray
    low: np.ndarray | None
    counts: np.ndarray


class Layout(NamedTuple):
    """How n-grams of ``size`` ids of ``bits`` (even) bits are split: ``shard_bits`` name the shard."""

    size: int
    bits: int
    shard_bits: int

    @property
    def half(self) -> int:
        return self.size * self.bits // 2

    @property
    def joined(self) -> bool:
        return 2 * self.half <= 64

    @property
    def widths(self) -> tuple[int, int]:
        """Bits of ``top`` and ``low``."""
        return (2 * self.half - self.shard_bits, 0) if self.joined else (self.half - self.shard_bits, self.half)


def _ones(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _down(values: np.ndarray, bits: int) -> np.ndarray:
    return np.zeros_like(values) if bits >= 64 else values >> np.uint64(bits)


def pack(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of n-grams, the first id in the upper bits."""
    size, high = len(words), np.zeros(len(words[0]), np.uint64)
    low = high.copy()
    for i, w in enumerate(words):
        w = w.astype(np.uint64)
        if 2 * i + 1 == size:  # the middle id is cut in two
            cut = np.uint64(bits // 2)
            high = (high << cut) | (w >> cut)
            low = w & _ones(bits // 2)
        elif 2 * i < size:
            high = (high << np.uint64(bits)) | w if i else w
        else:
            low = (low << np.uint64(bits)) | w
    return high, low


def unpack(high: np.ndarray, low: np.ndarray, size: int, bits: int) -> Words:
    out: list[np.ndarray] = []
    for i in range(size - 1, -1, -1):
        if 2 * i + 1 == size:
            cut = np.uint64(bits // 2)
            out.append(((high & _ones(bits // 2)) << cut) | low)
            high = high >> cut
        elif 2 * i < size:
            out.append(high & _ones(bits))
            high = _down(high, bits)
        else:
            out.append(low & _ones(bits))
            low = _down(low, bits)
    return tuple(reversed(out))


def permuted(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    for key in _ROUNDS:
        high, low = low, high ^ (mixed(low + key) & _ones(half))
    return high, low


def restored(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    for key in reversed(_ROUNDS):
        high, low = low ^ (mixed(high + key) & _ones(half)), high
    return high, low


def keys(words: Words, layout: Layout) -> tuple[np.ndarray, np.ndarray | None]:
    """Permuted n-grams as whole keys, with the shard in the leading bits."""
    high, low = permuted(*pack(words, layout.bits), layout.half)
    return ((high << np.uint64(layout.half)) | low, None) if layout.joined else (high, low)


def words(shard: int, entries: Entries, layout: Layout) -> Words:
    """The n-grams of a shard's entries."""
    top_bits, half = layout.widths[0], layout.half
    top = entries.top | np.uint64(shard << top_bits)
    high, low = (top >> np.uint64(half), top & _ones(half)) if layout.joined else (top, entries.low)
    return unpack(*restored(high, low, half), layout.size, layout.bits)


def summed(top: np.ndarray, low: np.ndarray | None, counts: np.ndarray | None = None) -> Entries:
    """Sorted entries: equal keys once, with the sum of their counts (1 each where none are given)."""
    if low is None and counts is None:
        top = np.sort(top)
    else:
        order = np.argsort(top, kind="stable") if low is None else np.lexsort((low, top))
        top, low = top[order], None if low is None else low[order]
        counts = None if counts is None else counts[order]
    if not len(top):
        return Entries(top, low, np.zeros(0, np.int64))
    new = np.empty(len(top), bool)
    new[0] = True
    np.not_equal(top[1:], top[:-1], out=new[1:])
    if low is not None:
        new[1:] |= low[1:] != low[:-1]
    at = np.flatnonzero(new)
    total = np.diff(np.r_[at, len(top)]) if counts is None else np.add.reduceat(counts, at)
    return Entries(top[at], None if low is None else low[at], total)


def merged(parts: list[Entries]) -> Entries:
    """Filters of one shard, or lists of whole keys, as one."""
    if len(parts) == 1:
        return parts[0]
    low = None if parts[0].low is None else np.concatenate([p.low for p in parts])
    return summed(np.concatenate([p.top for p in parts]), low, np.concatenate([p.counts for p in parts]))


def shards(entries: Entries, layout: Layout) -> list[tuple[int, Entries]]:
    """Whole keys in order, cut into the entries of each shard."""
    top_bits = layout.widths[0]
    names = _down(entries.top, top_bits)
    cut = np.flatnonzero(np.diff(names)) + 1 if len(names) else []
    bounds = [0, *cut, len(names)]
    rest = entries.top & _ones(top_bits)
    return [
        (int(names[a]), Entries(rest[a:b], None if entries.low is None else entries.low[a:b], entries.counts[a:b])) for a, b in zip(bounds, bounds[1:]) if b > a
    ]


def _planes(values: np.ndarray, bits: int) -> bytes:
    n = (bits + 7) // 8
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def _values(data: memoryview, count: int, bits: int) -> tuple[np.ndarray, memoryview]:
    n = (bits + 7) // 8
    out = np.zeros((count, 8), np.uint8)
    out[:, :n] = np.frombuffer(data[: n * count], np.uint8).reshape(n, count).T
    return out.view("<u8").reshape(-1).astype(np.uint64), data[n * count :]


def encode(entries: Entries, top_bits: int, low_bits: int) -> bytes:
    """The filter of sorted entries."""
    n = len(entries.top)
    q = min(top_bits, max(n.bit_length() - 1, 0), 40)
    quotient = _down(entries.top, top_bits - q)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient.astype(np.int64)] = True
    ends = np.ones(n, bool)
    np.not_equal(quotient[1:], quotient[:-1], out=ends[:-1])
    large = entries.counts > 255
    counters = np.where(large, 0, entries.counts).astype(np.uint8)  # counts are positive, so 0 is the escape
    over = entries.counts[large].astype("<u8")
    low = b"" if entries.low is None else _planes(entries.low, low_bits)
    return b"".join([
        _HEAD.pack(n, q, top_bits, low_bits, len(over)), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), _planes(entries.top & _ones(top_bits - q), top_bits - q), low,
        counters.tobytes(), over.tobytes(),
    ])


def decode(data: bytes) -> Entries:
    n, q, top_bits, low_bits, n_over = _HEAD.unpack_from(data)
    view = memoryview(data)[_HEAD.size :]
    occupied = np.flatnonzero(np.unpackbits(np.frombuffer(view[: ((1 << q) + 7) // 8], np.uint8), count=1 << q)).astype(np.uint64)
    view = view[((1 << q) + 7) // 8 :]
    ends = np.unpackbits(np.frombuffer(view[: (n + 7) // 8], np.uint8), count=n).astype(np.int64)
    remainder, view = _values(view[(n + 7) // 8 :], n, top_bits - q)
    quotient = occupied[np.cumsum(ends) - ends] if n else np.zeros(0, np.uint64)
    top = remainder if top_bits - q >= 64 else (quotient << np.uint64(top_bits - q)) | remainder
    low = None
    if low_bits:
        low, view = _values(view, n, low_bits)
    counts = np.frombuffer(view[:n], np.uint8).astype(np.int64)
    counts[counts == 0] = np.frombuffer(view[n : n + 8 * n_over], "<u8").astype(np.int64)
    return Entries(top, low, counts)
