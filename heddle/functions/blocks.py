"""Matching blocks of many pairs of texts at once, the way difflib's SequenceMatcher takes them: the longest common block, then
what lies left and right of it, and so on.

All open stretches of all pairs advance together: one step compares a character of every left stretch with its whole right
stretch, so the work is in a few array operations per character and round, whatever the number of pairs.
"""

from __future__ import annotations

import numpy as np

#: Cells (stretches times characters) that are compared in one go, and texts from which on frequent characters start no block.
CELLS, POPULAR_FROM = 1 << 21, 200


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts end to end, and where each text begins."""
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), at


def _popular(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Characters of long right texts that stand in more than one in a hundred places, and one."""
    out = np.zeros(len(b), bool)
    for i in np.flatnonzero(np.diff(at) >= POPULAR_FROM):
        part = b[at[i] : at[i + 1]]
        _, which, n = np.unique(part, return_inverse=True, return_counts=True)
        out[at[i] : at[i + 1]] = n[which] > len(part) // 100 + 1
    return out


def _longest(a: np.ndarray, b: np.ndarray, banned: np.ndarray, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in a, start in b and length of the longest block of each pair of stretches; of equally long ones the earliest in a, then in b."""
    n, width, height = len(alo), int((bhi - blo).max()), int((ahi - alo).max())
    places = blo[:, None] + np.arange(width)
    fine = places < bhi[:, None]
    places = np.where(fine, places, 0)
    right, fine = b[places], fine & ~banned[places]
    run, size, end_a, end_b = np.zeros((n, width + 1), np.int32), np.zeros(n, np.int64), alo - 1, blo - 1
    for i in range(height):
        live = alo + i < ahi
        same = fine & (right == a[np.where(live, alo + i, 0)][:, None]) & live[:, None]
        run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        at = run.argmax(1)
        top = run[np.arange(n), at]
        better = top > size
        size = np.where(better, top, size)
        end_a, end_b = np.where(better, alo + i, end_a), np.where(better, blo + at - 1, end_b)
    return end_a - size + 1, end_b - size + 1, size


def matched(left: list[str], right: list[str]) -> np.ndarray:
    """How many characters of each pair are in matching blocks."""
    (a, a_at), (b, b_at) = _codes(left), _codes(right)
    banned = _popular(b, b_at)
    total = np.zeros(len(left), np.int64)
    open_ = np.stack([np.arange(len(left)), a_at[:-1], a_at[1:], b_at[:-1], b_at[1:]], 1)
    while len(open_ := open_[(open_[:, 1] < open_[:, 2]) & (open_[:, 3] < open_[:, 4])]):
        sizes = np.maximum(open_[:, 2] - open_[:, 1], open_[:, 4] - open_[:, 3])
        open_ = open_[np.argsort(sizes, kind="stable")]
        sizes = np.sort(sizes)
        fresh, start = [], 0
        while start < len(open_):
            # As many stretches as fit with the last one's size, which is the greatest.
            stop = start + 1
            while stop < len(open_) and (min(2 * stop - start, len(open_)) - start) * (sizes[min(2 * stop - start, len(open_)) - 1] + 1) <= CELLS:
                stop = min(2 * stop - start, len(open_))
            p, alo, ahi, blo, bhi = open_[start:stop].T
            i, j, size = _longest(a, b, banned, alo, ahi, blo, bhi)
            if banned.any():
                # Frequent characters start no block but prolong one on either side.
                while (grow := np.flatnonzero((i > alo) & (j > blo))).size and (grow := grow[a[i[grow] - 1] == b[j[grow] - 1]]).size:
                    i[grow], j[grow], size[grow] = i[grow] - 1, j[grow] - 1, size[grow] + 1
                while (grow := np.flatnonzero((i + size < ahi) & (j + size < bhi))).size and (grow := grow[a[(i + size)[grow]] == b[(j + size)[grow]]]).size:
                    size[grow] += 1
            np.add.at(total, p, size)
            some = size > 0
            fresh += [np.stack([p, alo, i, blo, j], 1)[some], np.stack([p, i + size, ahi, j + size, bhi], 1)[some]]
            start = stop
        open_ = np.concatenate(fresh)
    return total


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    """Twice the matched characters by all characters of both; 1 for two empty texts."""
    every = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], np.int64)
    return np.where(every > 0, 2.0 * matched(left, right) / np.maximum(every, 1), 1.0)
