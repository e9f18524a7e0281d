"""Vectorised word and shingle hashing over Arrow string batches.

Tasks receive whole texts as Arrow batches.  The helpers here work on the
UTF-8 bytes of a slice of documents at once, so no Python loop runs per word.
A word is a maximal run of bytes outside the separator class; its 64-bit hash
depends on its bytes only, never on its place, task or document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # bytes of text hashed at once; bounds a task's memory
_BASE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: white space of the word contract: \x20 and \x09 to \x0D
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: every ASCII byte but letters and digits
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[:128] = True
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def _table(lower: bool) -> np.ndarray:
    out = _BYTE.copy()
    if lower:
        out[65:91] = out[97:123]
    return out


_TABLES = {False: _table(False), True: _table(True)}
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        size = max(1024, 1 << int(n - 1).bit_length())
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE, np.uint64))])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; the input array is not changed."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in these bytes); null rows are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """Words of a slice of documents: byte spans, hashes and the first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, separators: np.ndarray = SPACES):
        inside = ~separators[data]
        edge = np.empty(len(data) + 1, bool)  # a word begins or ends
        if len(data):
            edge[0], edge[-1] = inside[0], inside[-1]
            np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
            cut = offsets[1:-1]
            cut = cut[(cut > 0) & (cut < len(data))]
            touching = np.unique(cut[inside[cut] & inside[cut - 1]])  # two texts meet without a separator
        else:
            edge[:], touching = False, offsets[:0]
        at = np.flatnonzero(edge)
        if len(touching):
            at = np.sort(np.concatenate([at, touching, touching]))
        self.start, self.end = at[0::2], at[1::2]
        self.first = np.searchsorted(self.start, offsets)  # first word of each document, and the count
        self.count = np.diff(self.first)
        self.data = data
        if len(self.start):
            length = self.end - self.start
            power = _power(int(length.max()))
            place = np.arange(len(data), dtype=np.int64)
            place -= np.repeat(self.start, np.diff(np.append(self.start, len(data)))) if self.start[0] == 0 else np.concatenate(
                [place[: self.start[0]], np.repeat(self.start, np.diff(np.append(self.start, len(data))))]
            )
            place[~inside] = 0
            value = _TABLES[lower][data]
            value *= power[place]
            value[~inside] = 0
            self.hash = mix(np.add.reduceat(value, self.start) + length.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    def plain(self) -> tuple[bytes, np.ndarray]:
        """All words with one space behind each, and where each begins; one place more than words."""
        length = self.end - self.start
        at = np.concatenate([[0], np.cumsum(length + 1)])
        out = np.full(int(at[-1]), 32, np.uint8)
        out[ragged(at[:-1], length)] = self.data[ragged(self.start, length)]
        return out.tobytes(), at

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of `size` words inside one document, and the index of each run's first word."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = self.hash[:n] * _PLACE[0]
        for j in range(1, size):
            h += self.hash[j : n + j] * _PLACE[j]
        last = np.repeat(self.first[1:], self.count)[:n]
        at = np.flatnonzero(np.arange(n) + size <= last)
        return mix(h[at] + np.uint64(size)), at


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of every document, with repeats, and the bounds of each document's part.

    A document with fewer than `size` words has its whole sequence as one shingle; without words it has none.
    """
    h, at = words.runs(size)
    bounds = np.searchsorted(at, words.first)
    few = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(few):
        extra = np.empty(len(few), np.uint64)
        for k, d in enumerate(few):
            part = words.hash[words.first[d] : words.first[d + 1]]
            extra[k] = (part * _PLACE[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
        h = np.insert(h, bounds[few], mix(extra))
        grown = np.zeros(len(words.count) + 1, np.int64)
        grown[few + 1] = 1
        bounds = bounds + np.cumsum(grown)
    return h, bounds


def distinct_sets(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each document, and their bounds."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = h.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    if len(out) > 1:
        keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(bounds) - 1))]).astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of every part, one part after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
