"""Matching blocks of two sequences."""

from __future__ import annotations

import difflib
from collections import Counter

import numpy as np

MOST_PAIRS = 4_000_000  # of equal places held at once; beyond, the blocks are found one after the other


def matched(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements of ``a`` and ``b`` lie in their matching blocks.

    The longest run of ``a`` that also is a run of ``b`` is the first block (the
    earliest in ``a``, then in ``b``, of equally long ones); what is before it in
    both and what is after it in both is matched in the same way. Equal places
    are lined up by their diagonal once, so that a block is looked up among the
    runs of the diagonals, cut to the part in question.
    """
    order = np.argsort(b, kind="stable")
    low, high = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    often = high - low
    if often.sum() > MOST_PAIRS:
        blocks = difflib.SequenceMatcher(None, a.tolist(), b.tolist(), autojunk=False).get_matching_blocks()
        return sum(block.size for block in blocks)
    i = np.repeat(np.arange(len(a)), often)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(often) - often, often) + np.repeat(low, often)]
    along = np.lexsort((i, j - i))
    i, j = i[along], j[along]
    head = np.ones(len(i), bool)
    head[1:] = (np.diff(i) != 1) | (np.diff(j) != 1)
    start = np.flatnonzero(head)
    size = np.diff(np.append(start, len(i)))
    total, parts = 0, [(0, len(a), 0, len(b), i[start], j[start], size)]
    while parts:
        a_low, a_high, b_low, b_high, x, y, size = parts.pop()
        skip = np.maximum(0, np.maximum(a_low - x, b_low - y))
        size = np.minimum(size, np.minimum(a_high - x, b_high - y)) - skip
        there = size > 0
        if not there.any():
            continue
        x, y, size = (x + skip)[there], (y + skip)[there], size[there]
        longest = int(size.max())
        most = np.flatnonzero(size == longest)
        best = most[np.lexsort((y[most], x[most]))[0]]
        at, to = int(x[best]), int(y[best])
        total += longest
        parts.append((a_low, at, b_low, to, x, y, size))
        parts.append((at + longest, a_high, to + longest, b_high, x, y, size))
    return total


def agreement(a: np.ndarray, b: np.ndarray, least: float, ordered: bool = True) -> tuple[int, int] | None:
    """``matched(a, b), matched(b, a)``, or None where twice the common elements, in any order, are under ``least`` of all.

    Unless ``ordered``, the common elements themselves are counted. Common
    elements without repeats need no blocks where they stand in the same order
    (all are matched) or in reverse (one is).
    """
    x, y = a.tolist(), b.tolist()
    inside = set(x).intersection(y)
    p, q = [e for e in x if e in inside], [e for e in y if e in inside]
    once = len(p) == len(q) == len(inside)
    common = len(p) if once else sum((Counter(p) & Counter(q)).values())
    if 2.0 * common / (len(x) + len(y)) < least:
        return None
    if not ordered or common < 2 or once and p == q:
        return common, common
    if once and p == q[::-1]:
        return 1, 1
    return matched(a, b), matched(b, a)


def ratio(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the matched elements over all elements; 1 for two empty sequences."""
    return 2.0 * matched(a, b) / (len(a) + len(b)) if len(a) + len(b) else 1.0
