"""Plain single-machine versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib


def substring_dedup(rows, window=50):
    """rows: (doc_id, text).  (doc_id, n_words, n_removed, sha256) of each row, in order."""
    words = [(text or "").encode().split() for _, text in rows]
    least = {}
    for (doc_id, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1):
            if doc_id is not None:
                key = tuple(w[i : i + window])
                least[key] = min(least.get(key, doc_id), doc_id)
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if doc_id is not None and least[tuple(w[i : i + window])] < doc_id:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def jaccard_components(rows, size=4, percent=85):
    """rows: (doc_id, text).  (doc_id, set size, component) of each row, in order, by all pairs that share a shingle."""
    sets = [shingle_set(text, size) for _, text in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in where.get(x, ()):
                common[j] = common.get(j, 0) + 1
            where.setdefault(x, []).append(i)
        for j, both in common.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(doc_id, len(s), least.get(find(i)) if s else doc_id) for i, ((doc_id, _), s) in enumerate(zip(rows, sets, strict=True))]


def quality(rows, trusted, buckets, smoothing, threshold):
    """rows: (doc_id, text); trusted: ids.  One tuple for each row: id, five counts, base_failed, kept."""
    import math
    import re

    import xxhash

    def bucket(*words):
        seed = 42
        for w in words:
            seed = xxhash.xxh64_intdigest(w, seed)
        signed = seed - (1 << 64) if seed >> 63 else seed
        return signed % buckets

    def grams(w):
        return [bucket(x) for x in w] + [bucket(a, b) for a, b in zip(w, w[1:], strict=False)]

    words = [(text or "").encode().split() for _, text in rows]
    raw, target = {}, {}
    for (doc_id, _), w in zip(rows, words, strict=True):
        for b in grams(w):
            raw[b] = raw.get(b, 0) + 1
            if doc_id in trusted:
                target[b] = target.get(b, 0) + 1
    n, t = sum(raw.values()), sum(target.values())
    weight = {b: math.log((target.get(b, 0) + smoothing) / (r * t / n + smoothing)) if t else 0.0 for b, r in raw.items()}
    out = []
    for (doc_id, text), w in zip(rows, words, strict=True):
        windows = {}
        for i in range(len(w) - 2):
            windows.setdefault(tuple(w[i : i + 3]), []).append(i)
        covered = {p + d for places in windows.values() if len(places) > 1 for p in places for d in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        g = grams(w)
        llr = sum(round(weight[b] * (1 << 24)) for b in g) / (1 << 24) / max(1, len(g))
        symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
        out.append((doc_id, len(w), sum(len(x.decode()) for x in w), symbols, len(lines) - len(set(lines)), len(covered), failed, not failed and llr >= threshold))
    return out


def containment(docs, items, size=5, percent=80):
    """(doc_id, item_id, n_item, n_common) of the pairs that hold, each once with its best."""
    import re

    def words(text):
        return [w for w in re.split(r"[\x00-/:-`{-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]

    best = {}
    for item_id, text in items:
        w = words(text)
        k = min(size, len(w))
        mine = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for doc_id, body in docs:
            d = words(body)
            if mine:
                common = len(mine & {tuple(d[i : i + k]) for i in range(len(d) - k + 1)})
                if 100 * common >= percent * len(mine):
                    new = (common / len(mine), len(mine), common)
                    best[doc_id, item_id] = max(best.get((doc_id, item_id), new), new)
    return [(d, i, n, c) for (d, i), (_, n, c) in best.items()]


def best_fit(items, capacity):
    """Bin of each (size, source, cluster), by looking at every bin: the least residual that suffices, the oldest of equals."""
    bins, out = [], []
    for size, source, cluster in items:
        fit = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])]
        if fit:
            k = min(fit)[1]
        else:
            k = len(bins)
            bins.append({"left": capacity, "s": set(), "c": set()})
        bins[k]["left"] -= size
        bins[k]["s"].add(source)
        bins[k]["c"].add(cluster)
        out.append(k)
    return out
