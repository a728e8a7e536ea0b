"""Suffix arrays in NumPy: Larsson-Sadakane refinement and Kasai common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of all suffixes of ``data`` (integers below 511), ordered by at least their
    first ``depth`` values; equal prefixes stay in position order.

    The first round sorts by seven values at once. Each later round doubles the compared length by
    the ranks of the suffixes further on, and visits only groups that are still tied (the refinement
    of Larsson and Sadakane).
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    padded = np.zeros(n + 7, np.int64)
    padded[:n] = data + 1  # 0 is past the end and sorts first
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = (key << 9) | padded[k : n + k]
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = np.r_[True, key[1:] != key[:-1]]
    heads = np.flatnonzero(fresh)
    sizes = np.diff(np.r_[heads, n])
    rank = np.zeros(n + 1, np.int64)  # a group's rank is the place of its first member; -1 past the end
    rank[n] = -1
    rank[order] = np.repeat(heads, sizes)
    places = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in the order that are still tied
    width = 7
    while len(places) and width < depth:
        rows = order[places]
        further = rank[np.minimum(rows + width, n)]
        own = rank[rows]
        by = np.argsort((own << 32) | (further + 1), kind="stable")
        rows, own, further = rows[by], own[by], further[by]
        order[places] = rows
        fresh = np.r_[True, (own[1:] != own[:-1]) | (further[1:] != further[:-1])]
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.r_[heads, len(rows)])
        rank[rows] = np.repeat(places[heads], sizes)
        places = places[np.repeat(sizes > 1, sizes)]
        width *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place in the order, the length (up to ``depth``) of the prefix that its suffix shares
    with the suffix before it; 0 for the first.

    Kasai's lemma: if two neighbours share L > 0 values, the suffixes one position on share L - 1. Runs
    of positions whose forerunners also follow each other form chains; only the head of a chain is
    compared, in blocks of growing length, as far as the chain's end and ``depth`` beyond it.
    """
    n = len(data)
    if n < 2:
        return np.zeros(n, np.int64)
    before = np.full(n, -1, np.int64)  # by position: the suffix before it in the order
    before[order[1:]] = order[:-1]
    chained = np.zeros(n, bool)
    chained[1:] = (before[:-1] >= 0) & (before[1:] == before[:-1] + 1) & (data[:-1] == data[before[:-1]])
    heads = np.flatnonzero(~chained)
    links = np.diff(np.r_[heads, n])
    padded = np.full(n + 4_096, -1, np.int32)
    padded[:n] = data
    shared = np.zeros(len(heads), np.int64)
    active = np.flatnonzero(before[heads] >= 0)
    step = 16
    while len(active):
        at = np.minimum(heads[active] + shared[active], n)
        other = np.minimum(before[heads[active]] + shared[active], n)
        width = np.arange(step)
        a, b = padded[at[:, None] + width], padded[other[:, None] + width]
        same = (a == b) & (a >= 0)
        full = same.all(axis=1)
        shared[active] += np.where(full, step, np.argmin(same, axis=1))
        active = active[full & (shared[active] < links[active] + depth)]
        if len(active) * step < 1 << 20:
            step = min(2 * step, 4_096)
    by_position = np.repeat(shared, links) - (np.arange(n) - np.repeat(heads, links))
    return np.clip(by_position, 0, depth)[order]


def find(data: np.ndarray, order: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether each row of ``windows`` (equal lengths) is the prefix of a suffix in the order.

    A binary search over the suffix array, for all rows in step.
    """
    if len(order) == 0 or len(windows) == 0:
        return np.zeros(len(windows), bool)
    depth = windows.shape[1]
    padded = np.full(len(data) + depth, -1, np.int32)
    padded[: len(data)] = data
    reach = np.arange(depth)
    low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(order), np.int64)
    while (low < high).any():
        middle = np.minimum((low + high) // 2, len(order) - 1)
        seen = padded[order[middle][:, None] + reach]
        differs = seen != windows
        first = differs.argmax(axis=1)
        rows = np.arange(len(windows))
        less = differs[rows, first] & (seen[rows, first] < windows[rows, first])
        open_ = low < high
        low = np.where(open_ & less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    return (low < len(order)) & (padded[order[np.minimum(low, len(order) - 1)][:, None] + reach] == windows).all(axis=1)
