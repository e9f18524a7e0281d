"""Recompression of word sequences: rounds that name runs and pairs alike wherever they stand.

A round of runs names every maximal run of a symbol by symbol and length.  A round
of pairs splits the symbols into left and right ones by a bit of their names and
names every left symbol that is followed by a right one together with it.  Names
are 64-bit hashes of what they stand for, so every task gives equal content the
same name without asking the others: naming is global.

Each symbol carries the span of words that decides that it is there and what it is
called.  A window that holds this span holds the symbol, in whatever document it
stands, so equal windows hold equal symbols.  A window's anchor is the symbol of
the last round whose span it holds and whose name hashes lowest; neighbouring
windows mostly share theirs and form one segment.
"""

from __future__ import annotations

import numpy as np

from ._words import Words, mix

ROUNDS = "RPPRPP"
_RUN, _PAIR = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_CHOICE = np.uint64(0x589965CC75374CC3)
_BASE = 0xE7037ED1A0B428DB
_INVERSE = pow(_BASE, -1, 1 << 64)
_up = np.ones(1, np.uint64)
_down = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if len(_up) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        _up, _down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_BASE, _INVERSE))
    return _up, _down


class Spans:
    """Hashes of any spans of words: equal spans hash alike."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * up[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _RUN)


def symbols(words: Words, rounds: str = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, first and end word of the deciding span of each symbol after all rounds.

    Where a document's edge decides, the span reaches one word beyond the document, so no window holds it.
    """
    name = words.hash
    left = np.arange(len(name))
    right = left + 1
    doc = np.repeat(np.arange(len(words.count)), words.count)
    low, high = words.first[:-1] - 1, words.first[1:] + 1
    for turn, kind in enumerate(rounds):
        if len(name) < 2:
            return name, low[doc], high[doc]
        near = doc[1:] == doc[:-1]  # the next symbol is of the same document
        before = np.where(np.concatenate([[False], near]), np.concatenate([left[:1], left[:-1]]), low[doc])
        after = np.where(np.concatenate([near, [False]]), np.concatenate([right[1:], right[-1:]]), high[doc])
        if kind == "R":
            head = np.flatnonzero(np.concatenate([[True], ~(near & (name[1:] == name[:-1]))]))
            last = np.append(head[1:], len(name)) - 1
            size = (last - head + 1).astype(np.uint64)
            name = np.where(size > 1, mix(name[head] * _RUN + size), name[head])
            left, right, doc = before[head], after[last], doc[head]
        else:
            is_left = mix(name + np.uint64((turn + 1) * 0xA0761D6478BD642F % (1 << 64))) & np.uint64(1) == 0
            first = np.concatenate([near & is_left[:-1] & ~is_left[1:], [False]])
            second = np.concatenate([[False], first[:-1]])
            at = np.flatnonzero(~second)
            pair = first[at]
            nxt = np.minimum(at + 1, len(name) - 1)
            merged = mix(mix(name[at] * _PAIR) + name[nxt])
            new_left = np.where(pair | is_left[at], left[at], before[at])
            new_right = np.where(pair, right[nxt], np.where(is_left[at], after[at], right[at]))
            name, left, right, doc = np.where(pair, merged, name[at]), new_left, new_right, doc[at]
    return name, left, right


def _lowest(order: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Index of the lowest value, the first of equals, of order[start:end]; none of the ranges is empty."""
    size = end - start
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(start), np.int64)
    best = np.arange(len(order))
    for k in range(int(level.max()) + 1):
        if k:
            a, b = best[: len(best) - (1 << k - 1)], best[1 << k - 1 :]
            best = np.where(order[b] < order[a], b, a)
        at = np.flatnonzero(level == k)
        a, b = best[start[at]], best[end[at] - (1 << k)]
        out[at] = np.where(order[b] < order[a], b, a)
    return out


def segments(words: Words, window: int, rounds: str = ROUNDS) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: document, first window, last window, anchor hash and content hash.

    The anchor hash depends on the deciding span alone; windows without an anchor stand for themselves.  The content hash
    covers all words of the segment's windows, so segments with equal hashes hold equal windows.
    """
    n = np.maximum(words.count - window + 1, 0)
    total = int(n.sum())
    if not total:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(total) + np.repeat(words.first[:-1] - (np.cumsum(n) - n), n)
    name, left, right = symbols(words, rounds)
    start, end = np.searchsorted(left, at, "left"), np.searchsorted(right, at + window, "right")
    has = end > start
    chosen = np.full(total, -1, np.int64)
    if has.any():
        chosen[has] = _lowest(mix(name ^ _CHOICE), start[has], end[has])
    spans = Spans(words.hash)
    own = np.zeros(total, np.uint64)  # hash of a window without an anchor
    bare = np.flatnonzero(~has)
    own[bare] = spans.hash(at[bare], at[bare] + window)
    new = np.ones(total, bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], total) - 1
    pick = chosen[head]
    key = own[head]
    held = pick >= 0
    key[held] = spans.hash(left[pick[held]], right[pick[held]])
    content = spans.hash(at[head], at[last] + window)
    base = words.first[:-1][doc[head]]
    return doc[head], at[head] - base, at[last] - base, key, content

