"""MinHash near-duplicates: a multi-index Hamming join of b-bit signatures.

A text is lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``; its set holds the distinct runs of `size`
words, or its whole sequence if it has fewer words.  Sets are linked when 100 * |A & B| >= percent * |A | B|.

1. Every document gets the name of its set and a signature: the last 8 bits of its least shingle under each of some
   hundred permutations.  Equal sets are one node from here on.  Two signatures differ in a place with probability of
   about 1 - Jaccard, so linked sets stay within a Hamming radius that `layout` derives from the binomial law: a link
   at the threshold itself is beyond it with a probability below LOSS.
2. Signatures are cut into M chunks.  The radius is 2M - 3, so of any pair within it at least two chunks differ in one
   place or none (else there were 2(M - 1) differences).  Each chunk gives a key for each place left out, so any pair
   within the radius shares a key: this index loses none.
3. Each node is compared with the least and the greatest node of its keys, of those it shares most with.  Links found
   so join large groups of copies at once, without pairs within the group.
4. What is left are keys whose nodes are of several components.  Keys of one least node are one group.  A group of
   more than TILE nodes is cut by its nodes' keys, and what is still larger by a second chunk: a pair within the
   radius shares keys of two chunks.  It stays whole where that leaves more to compare: texts around one passage share
   many keys, so their pairs would meet again under each.  Groups are compared in tiles, only across components.  Of pairs within the radius
   those go on whose parity sketches allow a link (their Hamming distance is at most the sets' difference), and are
   confirmed on the full sets.  Rounds send the nearest pairs that join components, the last all others.

Defined results: null texts and texts without words have an empty set, are linked with nothing and are their own
component.  Rows that repeat, or that share an id, are rows of their own, and all rows of the least id are kept.  A
null id never names a component unless all ids in it are null.  A very long text is hashed whole, in a task's slice of
its own, linear in its length.  An empty table gives an empty result.  Only doc_id and text are read, so other columns
may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import components
from ._parity import _fold, forest, most_apart, set_ids
from ._tables import discard, read, spool
from ._words import mix
from .ngram_jaccard import TILE, _linked, _of_both, _open_groups, _renamed, _sets, _whole_sets

SIZE, PERCENT = 3, 85
LOSS = 1e-5  # chance that a link at the threshold is beyond the radius
MOST_CHUNKS, MOST_KEYS = 31, 128  # of a signature
MOSTLY = 0.75  # once so many of the nearest pairs are linked, little is left and all other pairs are sent
CELLS = 1 << 23  # bytes of signatures compared at once
KEYED = 1 << 15  # nodes that give their keys in one task, which holds most of these keys at once
MOVED = 128  # pairs that are compared in about the time in which a row of a group is moved
_rng = np.random.Generator(np.random.PCG64(11))
_PERMUTE = _rng.integers(1, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SYMBOL = _rng.integers(1, 2**63, (512, 256), dtype=np.uint64)


@cache
def layout(percent: int) -> tuple[int, int]:
    """(chunks, places of a chunk) of signatures: the longest chunks for which few enough keys keep the loss."""
    differ = (100 - percent) / 100
    for width in (8, 7, 6, 5, 4, 3):
        for chunks in range(3, min(MOST_CHUNKS, MOST_KEYS // width) + 1):
            k, radius = chunks * width, 2 * chunks - 3
            within = sum(comb(k, d) * differ**d * (1 - differ) ** (k - d) for d in range(radius + 1))
            if 1 - within <= LOSS:
                return chunks, width
    raise ValueError(f"{percent} % is too low a similarity for these signatures")


def signatures(h: np.ndarray, bounds: np.ndarray, places: int) -> np.ndarray:
    """A row of 8-bit symbols for each set that is not empty."""
    start = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(start), places), np.uint8)
    if len(start):
        for j in range(places):
            out[:, j] = mix(np.minimum.reduceat(h * _PERMUTE[j], start)).astype(np.uint8)
    return out


def _signed(size: int, places: int):
    """From (doc_id, tx, text): (doc_id, tx, n, node, sig)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, bounds in _sets(batch.column(2), size):
                n = np.diff(bounds)
                sig = np.full(b - a, None, object)
                sig[n > 0] = [row.tobytes() for row in signatures(h, bounds, places)]
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), pa.array(set_ids(h, bounds).view(np.int64)), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tx", "n", "node", "sig"])

    return emit


def _symbols(column: pa.Array) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1) if data else np.zeros((0, 1), np.uint8)


def chunk_keys(sig: np.ndarray, chunks: int) -> np.ndarray:
    """(rows, chunks, places): a key for each chunk and each place of it that may differ; its last 5 bits are the chunk."""
    value = _SYMBOL[np.arange(sig.shape[1]), sig].reshape(len(sig), chunks, -1)
    key = mix(value.sum(axis=2, keepdims=True) - value + np.arange(value.shape[1] * value.shape[2], dtype=np.uint64).reshape(1, chunks, -1))
    return key & ~np.uint64(31) | np.arange(chunks, dtype=np.uint64)[None, :, None]


def _keys(chunks: int):
    """From (node, sig): (key, node)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                key = chunk_keys(_symbols(part.column(1)), chunks).reshape(part.num_rows, -1)
                node = np.repeat(part.column(0).to_numpy(), key.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(node)], ["key", "node"])

    return emit


def _keyed(nodes: DataFrame, chunks: int) -> DataFrame:
    """(key, node) of all nodes, in tasks of some KEYED nodes: a task that reads a whole file of them has too many keys for its memory."""
    tasks = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-nodes.count() // KEYED))
    return nodes.select("node", "sig").repartition(tasks, "node").mapInArrow(_keys(chunks), "key long, node long")


def _second_keys(chunks: int):
    """From (low, chunk, node, comp, sig): the same rows once for each key of a later chunk, which cuts the group; of is the group that was cut."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                key = chunk_keys(_symbols(part.column(4)), chunks)
                low, chunk = part.column(0).to_numpy().view(np.uint64), part.column(1).to_numpy()
                row, c, _ = np.nonzero(np.broadcast_to(np.arange(chunks)[None, :, None] > chunk[:, None, None], key.shape))
                key = key[np.arange(chunks)[None, :] > chunk[:, None]].reshape(-1)
                columns = [pa.array(mix(key * _PERMUTE[0] + low[row]).view(np.int64)), pa.array(c.astype(np.int32)), *(part.column(k).take(pa.array(row)) for k in (2, 3, 0))]
                yield pa.RecordBatch.from_arrays(columns, ["low", "chunk", "node", "comp", "of"])

    return emit


def _may_link(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _close(percent: int, radius: int):
    """From (a, b, n and sig of a, n and sig of b): (a, b) within the radius."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = _may_link(batch.column(2).to_numpy(), batch.column(4).to_numpy(), percent)
            if batch.num_rows:
                good &= (_symbols(batch.column(3)) != _symbols(batch.column(5))).sum(axis=1) <= radius
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))

    return emit


def sketches_apart(sketches: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hamming distances of the parity sketches of pairs; longer ones are folded."""
    length = np.array([len(s) for s in sketches])
    both = np.minimum(length[x], length[y])
    out = np.zeros(len(x), np.int64)
    for size in np.unique(both).tolist():
        at = np.flatnonzero(both == size)
        used = np.unique(np.concatenate([x[at], y[at]]))
        table = np.stack([_fold(np.frombuffer(sketches[i], np.uint8), size) for i in used.tolist()]).view(np.uint64)
        step = max(1, CELLS // size)
        for a in range(0, len(at), step):
            part = at[a : a + step]
            one, two = (table[np.searchsorted(used, z[part])] for z in (x, y))
            out[part] = np.bitwise_count(one ^ two).sum(axis=1)
    return out


def near_pairs(t: pa.Table, percent: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different components within the radius that may be linked, and their sketches' distances; between two tiles if there are two."""
    n, comp, tile = (t.column(c).to_numpy() for c in ("n", "comp", "tile"))
    sig, sketches = _symbols(t.column("sig")), t.column("sketch").to_pylist()
    left = np.flatnonzero(tile == tile.min())
    right = left if tile.min() == tile.max() else np.flatnonzero(tile == tile.max())
    found = [(np.zeros(0, np.int64),) * 3]
    step = max(1, (1 << 20) // len(right))
    for a in range(0, len(left), step):
        i = left[a : a + step]
        may = (comp[i][:, None] != comp[right][None, :]) & _may_link(n[i][:, None], n[right][None, :], percent)
        if right is left:
            may &= i[:, None] < right[None, :]
        p, q = np.nonzero(may)
        part = max(1, CELLS // sig.shape[1])
        for c in range(0, len(p), part):
            x, y = i[p[c : c + part]], right[q[c : c + part]]
            within = (sig[x] != sig[y]).sum(axis=1) <= radius
            x, y = x[within], y[within]
            apart = sketches_apart(sketches, x, y)
            good = apart <= most_apart(n[x], n[y], percent)
            found.append((x[good], y[good], apart[good]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _tiles(percent: int, radius: int, every: bool):
    """From (low, i, j, node, comp, tile, n, sig, sketch) in order of low, i and j: pairs of nodes to confirm with their components."""

    def pairs(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        node, comp = t.column("node").to_numpy(), t.column("comp").to_numpy()
        x, y, distance = near_pairs(t, percent, radius)
        if not every:
            keep = forest(x, y, distance, comp)
            x, y = x[keep], y[keep]
        x, y = np.where(node[x] < node[y], x, y), np.where(node[x] < node[y], y, x)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (node[x], node[y], comp[x], comp[y])], ["a", "b", "comp_a", "comp_b"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                if held and any(held[0].column(k)[0] != part.column(k)[0] for k in range(3)):
                    yield pairs(held)
                    held = []
                held.append(part)
        if held:
            yield pairs(held)

    return emit


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of pairs (a, b, ...) whose full sets are linked."""
    return _of_both(pairs, sets, "hashes").select(*pairs.columns, "a_hashes", "b_hashes").mapInArrow(_linked(percent), pairs.schema)


def _cut(large: DataFrame, nodes: DataFrame, chunks: int) -> DataFrame:
    """(low, chunk, node, comp, of) of groups of rows (low, chunk, node, comp), cut by the keys of later chunks."""
    signed = large.join(nodes.select("node", "sig"), "node").select("low", "chunk", "node", "comp", "sig")
    return signed.mapInArrow(_second_keys(chunks), "low long, chunk int, node long, comp long, of long")


def _worth_cutting(large: DataFrame, nodes: DataFrame, chunks: int) -> DataFrame:
    """(low) of the groups of which cutting leaves less to move and compare than tiles of the whole group do."""
    price = F.col("size") * (F.col("size") + MOVED * F.ceil(F.col("size") / TILE))
    whole = large.groupBy("low").agg(F.count("*").alias("size")).select("low", price.alias("whole"))
    parts = _cut(large, nodes, chunks).groupBy("of", "low").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size")).filter("x < y")
    parts = parts.groupBy("of").agg(F.sum(price).alias("cut")).withColumnRenamed("of", "low")
    return whole.join(parts, "low", "left").filter("coalesce(cut, 0) < whole").select("low")


def _open_rows(shared: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, compared: DataFrame, chunks: int) -> DataFrame:
    """(low, node, comp, tiles, n, sig, sketch) of groups with several components; groups above TILE are cut by further chunks where that saves work."""
    of_node = shared.groupBy("node").agg(F.collect_set("low").alias("lows")).join(labels, "node")  # a node has no more of them than keys
    rows = spool(of_node.select(F.explode("lows").alias("low"), F.lit(-1).alias("chunk"), "node", "comp"), "named")
    left = _open_groups(rows, compared)
    discard(rows)
    parts, used = [], [left]
    for _ in range(2):
        large = left.filter("tiles > 1").drop("tiles")
        if large.isEmpty():
            break
        worth = spool(_worth_cutting(large, nodes, chunks), "worth")
        parts.append(left.join(worth, "low", "left_anti"))
        cut = spool(_cut(large.join(worth, "low", "left_semi"), nodes, chunks).drop("of"), "cut")
        left = _open_groups(cut)
        discard(cut)
        used += [worth, left]
    every = left
    for p in parts:
        every = every.unionByName(p)
    every = every.groupBy("node", "comp").agg(F.collect_list(F.struct("low", "tiles")).alias("at"))
    every = every.join(nodes.select("node", "n", "sig"), "node").join(sets.select("node", "sketch"), "node")
    out = spool(every.select(F.explode("at").alias("at"), "node", "comp", "n", "sig", "sketch").select("at.low", "node", "comp", "at.tiles", "n", "sig", "sketch"), "rows")
    discard(*used)
    return out


def _across(rows: DataFrame, sets: DataFrame, percent: int, radius: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, comp_a, comp_b) of different components of groups, and those of them that are linked."""
    rows = rows.withColumn("tile", F.expr("cast(pmod(xxhash64(node), tiles) as int)")).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("low", F.least("tile", "_with").alias("i"), F.greatest("tile", "_with").alias("j"), "node", "comp", "tile", "n", "sig", "sketch")
    tiled = rows.repartition("low", "i", "j").sortWithinPartitions("low", "i", "j").mapInArrow(_tiles(percent, radius, every), "a long, b long, comp_a long, comp_b long")
    pairs = spool(tiled.distinct(), "sent")
    return pairs, spool(_confirmed(pairs, sets, percent), "links")


def _join(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tx, n, node) of every row, and (node, comp) of the nodes that share keys with others."""
    chunks, width = layout(percent)
    radius = 2 * chunks - 3
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tx"), "text")
    known = spool(texts.mapInArrow(_signed(size, chunks * width), "doc_id long, tx long, n long, node long, sig binary"), "known")
    nodes = spool(known.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "tx", "n", "sig")).alias("x")).select("node", "x.*"), "nodes")

    keys = _keyed(nodes, chunks)
    ends = spool(keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high"), "ends")
    shared = spool(keys.join(ends, "key").groupBy("node", "low", "high").agg(F.count("*").alias("times")), "shared")
    discard(ends)

    one_text = nodes.join(shared.select("node").distinct(), "node", "left_semi").select(F.col("doc_id").alias("_id"), F.col("tx").alias("_tx"))
    here = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tx") == F.col("_tx"))
    sets = spool(texts.join(one_text, here, "left_semi").select("text").mapInArrow(_whole_sets(size), "node long, n long, sketch binary, hashes binary"), "whole-sets")
    if sets.count() > sets.select("node").distinct().count():  # only where rows agree in id and text
        twice, sets = sets, spool(sets.dropDuplicates(["node"]), "whole-sets")
        discard(twice)

    best = None
    for hub in ("low", "high"):
        count = shared.filter(f"node <> {hub}").groupBy("node", hub).agg(F.sum("times").alias("count"))
        top = count.groupBy("node").agg(F.max_by(hub, F.struct("count", hub)).alias("hub"))
        best = top if best is None else best.unionByName(top)
    pairs = spool(best.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "pairs")
    near = _of_both(pairs, nodes, "n", "sig").select("a", "b", "a_n", "a_sig", "b_n", "b_sig").mapInArrow(_close(percent, radius), "a long, b long")
    links = spool(_confirmed(near, sets, percent), "links")
    joined = components(links).withColumnRenamed("comp", "linked")
    labels = spool(shared.select("node").distinct().join(joined, "node", "left").select("node", F.coalesce("linked", "node").alias("comp")), "labels")
    discard(links)

    rows = _open_rows(shared, labels, nodes, sets, pairs, chunks)
    discard(shared, pairs)
    every = False
    while True:
        sent, more = _across(rows, sets, percent, radius, every)
        tried, found = sent.count(), more.count()
        if found:
            onto = components(more.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))).select(F.col("node").alias("comp"), F.col("comp").alias("onto"))
            old, labels = labels, spool(_renamed(labels, onto), "labels")
            discard(old)
            if not every:
                old, named = rows, spool(_renamed(rows.drop("tiles"), onto), "named")
                rows = _open_groups(named)
                discard(old, named)
        discard(more, sent)
        if every:
            discard(rows, sets, nodes)
            return known.drop("sig"), labels
        every = not found or found > tried * MOSTLY


def minhash_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs."""
    known, labels = _join(docs, size, percent)
    least = known.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node", "left")
    least = spool(least.select("node", "least", F.coalesce("comp", "node").alias("comp")), "least")
    named = spool(least.join(least.groupBy("comp").agg(F.min("least").alias("component")), "comp").select("node", "component"), "named")
    discard(least, labels)
    out = known.join(named, "node", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(read(spark, sf_dir, "documents"))
