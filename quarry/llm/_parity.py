"""Parity sketches of shingle sets: keys for the pigeonhole join and dense sketches for the Hamming filter.

A sketch flips one bit for each shingle, so two sketches differ in no more bits than
their sets differ in shingles.  Sets with Jaccard similarity of at least t and sizes
a and b differ in at most (1 - t) / (1 + t) * (a + b) shingles.  A size band cuts
its sketches into more blocks than that, so some blocks of such a pair are equal.

Blocks are kept sparsely: a block's word is the XOR of the codes of its flipped
bits.  A document emits words of its first heavy blocks (two shingles or more that
are not common ones), one more than a partner may spoil.  If it has fewer, it
emits all of them, and also as many first blocks of a second sketch that takes all
shingles and counts empty blocks.  Of any two similar sets at least one word is
shared: either one of them has heavy blocks enough, or both emit the second sketch.
"""

from __future__ import annotations

import numpy as np

from ._words import mix, ragged

_CODE, _KEY, _BIT = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
_BLOCK = np.uint64(0x165667B19E3779F9)
HEAVY = 2


def most_apart(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Shingles in which similar sets of a and b shingles can differ."""
    return (100 - percent) * (a + b) // (100 + percent)


def set_ids(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each document's set; 0 for the empty set."""
    n = np.diff(bounds)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h * _CODE))])
    name = mix((sums[bounds[1:]] - sums[bounds[:-1]]) + n.astype(np.uint64) * _KEY)
    return np.where(n > 0, np.where(name == 0, np.uint64(1), name), np.uint64(0))


def _blocks(h: np.ndarray, job: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Job, block, word and weight of every block with a shingle, in order of job and block."""
    block = ((mix(h * _BLOCK) >> np.uint64(33)) % blocks[job].astype(np.uint64)).astype(np.int64)
    width = int(blocks.max()) + 1
    at = job * width + block
    order = np.argsort(at, kind="stable")
    at = at[order]
    head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    word = np.bitwise_xor.reduceat(mix(h[order] ^ _CODE), head) if len(head) else np.zeros(0, np.uint64)
    return at[head] // width, at[head] % width, word, np.diff(np.append(head, len(at)))


def _key(word: np.ndarray, band: np.ndarray, block: np.ndarray, second: bool) -> np.ndarray:
    place = (band * 2 + second).astype(np.uint64) << np.uint64(40) | block.astype(np.uint64)
    return mix(word + mix(place * _KEY))


def pigeonhole_keys(h: np.ndarray, bounds: np.ndarray, common: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Document index and key, in no order; common: sorted hashes left out of the first sketch."""
    n = np.diff(bounds)
    most = 100 * n // percent  # largest partner
    band = np.frexp(np.maximum(n, 1).astype(float))[1] - 1
    top = np.frexp(np.maximum(most, 1).astype(float))[1] - 1
    docs, bands, partner = [], [], []
    own_end = (2 << band) - 1  # largest size of the own band
    for b, p, which in ((band, np.minimum(most, own_end), n > 0), (top, most, (n > 0) & (top > band))):
        at = np.flatnonzero(which)
        docs.append(at)
        bands.append(b[at])
        partner.append(p[at])
    doc, band, partner = (np.concatenate(x).astype(np.int64) for x in (docs, bands, partner))
    spoil = most_apart(n[doc], partner, percent)
    use = spoil > 0  # else only equal sets are similar, and those are one already
    doc, band, need = doc[use], band[use], spoil[use] + 1
    if not len(doc):
        return doc, np.zeros(0, np.uint64)
    size = (2 << band) - 1
    limit = most_apart(size, size, percent) + 1
    job = np.repeat(np.arange(len(doc)), n[doc])
    shingle = h[ragged(bounds[:-1][doc], n[doc])]
    rare = np.ones(len(shingle), bool)
    if len(common):
        rare = common[np.minimum(np.searchsorted(common, shingle), len(common) - 1)] != shingle
    j, block, word, weight = _blocks(shingle[rare], job[rare], limit * 6 // 5 + 1)
    heavy = weight >= HEAVY
    j, block, word = j[heavy], block[heavy], word[heavy]
    rank = np.arange(len(j)) - np.searchsorted(j, j)
    have = np.bincount(j, minlength=len(doc))
    first = rank < need[j]
    out = [(doc[j[first]], _key(word[first], band[j[first]], block[first], False))]
    few = np.flatnonzero(have < need)
    if len(few):
        again = np.full(len(doc), -1)
        again[few] = np.arange(len(few))
        take = again[job] >= 0
        j, block, word, _ = _blocks(shingle[take], again[job[take]], limit[few])
        start = np.cumsum(need[few]) - need[few]
        words = np.zeros(int(need[few].sum()), np.uint64)
        seen = block < need[few][j]
        words[start[j[seen]] + block[seen]] = word[seen]
        which = np.repeat(few, need[few])
        out.append((doc[which], _key(words, band[which], ragged(np.zeros(len(few), np.int64), need[few]), True)))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def sketch(h: np.ndarray) -> bytes:
    """A dense parity sketch of a set, at least four bits for each shingle."""
    bits = 1 << min(16, max(8, int(4 * len(h) - 1).bit_length()))
    place = (mix(h + _BIT) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _fold(s: np.ndarray, size: int) -> np.ndarray:
    while len(s) > size:  # the place of a bit is its hash modulo the size
        s = s[: len(s) // 2] ^ s[len(s) // 2 :]
    return s


def hamming(one: bytes, two: bytes) -> int:
    a, b = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
    size = min(len(a), len(b))
    return int(np.bitwise_count(_fold(a, size) ^ _fold(b, size)).sum())


def near_pairs(sketches: list[bytes], n: np.ndarray, group: np.ndarray, tile: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different groups whose sizes and sketches allow similarity, and their distances; between two tiles if there are two."""
    length = np.array([len(s) for s in sketches])
    cross = len(np.unique(tile)) > 1
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    sizes = np.unique(length).tolist()
    members = {size: np.flatnonzero(length == size) for size in sizes}
    for k, size in enumerate(sizes):
        mine = np.stack([np.frombuffer(sketches[i], np.uint8) for i in members[size]]).view(np.uint64)
        for other in sizes[k:]:
            far = mine if other == size else np.stack([_fold(np.frombuffer(sketches[i], np.uint8), size) for i in members[other]]).view(np.uint64)
            at = members[other]
            step = max(1, (1 << 20) // len(at))
            for low in range(0, len(mine), step):
                i = members[size][low : low + step]
                may = group[i][:, None] != group[at][None, :]
                may &= 100 * np.minimum.outer(n[i], n[at]) >= percent * np.maximum.outer(n[i], n[at])
                if other == size:
                    may &= i[:, None] < at[None, :]
                if cross:
                    may &= tile[i][:, None] != tile[at][None, :]
                p, q = np.nonzero(may)
                part = max(1, (1 << 20) // mine.shape[1])
                for c in range(0, len(p), part):
                    x, y = p[c : c + part], q[c : c + part]
                    apart = np.bitwise_count(mine[low + x] ^ far[y]).sum(axis=1).astype(np.int64)
                    good = apart <= most_apart(n[i[x]], n[at[y]], percent)
                    found.append((i[x[good]], at[y[good]], apart[good]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def forest(x: np.ndarray, y: np.ndarray, distance: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Indexes of pairs, the nearest first, that join all groups which pairs join, each pair joining two."""
    up: dict = {}

    def top(g):
        while up.setdefault(g, g) != g:
            up[g] = up[up[g]]
            g = up[g]
        return g

    keep = []
    for k in np.argsort(distance, kind="stable").tolist():
        a, b = top(group[x[k]]), top(group[y[k]])
        if a != b:
            up[a] = b
            keep.append(k)
    return np.array(keep, np.int64)
