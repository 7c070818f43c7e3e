"""Suffix arrays, common-prefix arrays and longest-previous-factor arrays in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(names: np.ndarray, limit: int | None = None, unit: int = 1) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling over integer names; with a limit, suffixes that
    share so many names keep the order of their positions.  A name may stand for ``unit``
    symbols from its position on; lengths are then told in steps of ``unit``.

    Returns the suffix order, each suffix's place in it, and for each level k the
    classes of equal substrings of length unit * 2**k.  Only suffixes that still share a
    class are sorted again, so text with few long repeats costs a few passes.
    """
    n = len(names)
    _, rank = np.unique(names, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    head = np.flatnonzero(np.r_[True, sorted_rank[1:] != sorted_rank[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[head, n])
    cls = np.empty(n + 1, np.int64)
    cls[order] = np.repeat(head, size)
    cls[n] = -1
    active = order[np.repeat(size > 1, size)]
    levels = [cls.copy()]
    step = unit
    while len(active) and not (limit and step >= limit):
        ahead = cls[np.minimum(active + step, n)] + 1
        old = cls[active]
        by = np.argsort(old * (n + 1) + ahead, kind="stable")
        active, old, ahead = active[by], old[by], ahead[by]
        new_old = np.r_[True, old[1:] != old[:-1]]
        head_mask = new_old | np.r_[True, ahead[1:] != ahead[:-1]]
        at = np.arange(len(active))
        old_start = np.maximum.accumulate(np.where(new_old, at, 0))
        group_start = np.maximum.accumulate(np.where(head_mask, at, 0))
        cls = cls.copy()
        cls[active] = old + group_start - old_start
        levels.append(cls)
        heads = np.flatnonzero(head_mask)
        size = np.diff(np.r_[heads, len(active)])
        active = active[np.repeat(size > 1, size)]
        step *= 2
    order = np.argsort(levels[-1][:n], kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place, levels


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, unit: int = 1) -> np.ndarray:
    """Length of the common prefix of suffixes a[i] and b[i], from the doubling classes."""
    n = len(levels[0]) - 1
    a, b = a.copy(), b.copy()
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        cls = levels[k]
        same = (a < n) & (b < n) & (cls[np.minimum(a, n)] == cls[np.minimum(b, n)])
        # a class whose substring runs past the end holds one suffix only
        out[same] += unit << k
        a[same] += unit << k
        b[same] += unit << k
    return out


def lcp_array(order: np.ndarray, levels: list[np.ndarray], unit: int = 1) -> np.ndarray:
    """lcp[r]: common prefix of the suffixes at places r-1 and r; lcp[0] = 0, lcp[n] = 0."""
    out = np.zeros(len(order) + 1, np.int64)
    if len(order) > 1:
        out[1:-1] = common_prefix(levels, order[:-1], order[1:], unit)
    return out


def maximal_repeats(order: np.ndarray, lcp: np.ndarray, left: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Common-prefix intervals (first place, last place, length) of maximal repeats.

    An interval is a set of neighbours in suffix order that share ``length`` names;
    it can't be extended to the right.  It is maximal if the names before the
    occurrences (``left``) aren't all the same either.  Only runs of the suffix order
    with common prefixes of at least ``least`` are walked.
    """
    out: list[tuple[int, int, int]] = []
    n = len(order)
    if n < 2:
        return out
    before = left[order]
    differs = np.zeros(n, np.int64)
    differs[1:] = np.cumsum(before[1:] != before[:-1])
    long_ones = np.flatnonzero(lcp[:n] >= least)
    if not len(long_ones):
        return out
    runs = np.split(long_ones, np.flatnonzero(np.diff(long_ones) > 1) + 1)
    for run in runs:
        stack: list[tuple[int, int]] = []  # (length, first place)
        place = int(run[0])
        for length in [*lcp[run].tolist(), 0]:
            first = place - 1
            while stack and stack[-1][0] > length:
                depth, first = stack.pop()
                if differs[place - 1] > differs[first]:
                    out.append((first, place - 1, depth))
            if length and (not stack or stack[-1][0] < length):
                stack.append((length, first))
            place += 1
    return out


def previous_factors(order: np.ndarray, levels: list[np.ndarray], unit: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor of each position.

    The longest earlier match of position i starts at one of its two neighbours in
    suffix order among positions smaller than i: the previous and the next smaller
    value.  The same with larger values gives the longest later match.  ``order`` may be
    part of a suffix order; matches are then exact within its runs of neighbours.
    """
    n = len(order)
    earlier, later = np.zeros((2, len(levels[0]) - 1), np.int64)
    for out, values in ((earlier, order), (later, -order)):
        for reverse in (False, True):
            near = previous_smaller(values[::-1] if reverse else values)
            if reverse:
                near = np.where(near[::-1] >= 0, n - 1 - near[::-1], -1)
            has = np.flatnonzero(near >= 0)
            i, j = order[has], order[near[has]]
            np.maximum.at(out, i, common_prefix(levels, i, j, unit))
    return earlier, later


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left of each place, -1 where none is."""
    out, stack = [], []
    values = values.tolist()
    for i, v in enumerate(values):
        while stack and values[stack[-1]] >= v:
            stack.pop()
        out.append(stack[-1] if stack else -1)
        stack.append(i)
    return np.array(out, np.int64)
