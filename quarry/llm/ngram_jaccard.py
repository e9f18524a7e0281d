"""N-gram Jaccard join: documents whose shingle sets are similar, by parity sketches.

A text is lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``; its set holds the
distinct runs of `size` words, or its whole sequence if it has fewer words.  Two sets are
linked when 100 * |A & B| >= percent * |A | B|.

1. Every document gets the size and name of its set; equal sets are one node from here on.
   Shingles that are common in some part of the corpus are counted on the way.
2. Every document emits its pigeonhole keys (see _parity): similar sets share a key.
3. Each node is compared with the hub of its keys that it shares most keys with: the least
   node of a key, and the greatest.  Links found so join large groups of near copies at
   once, without pairs within the group.
4. What is left are pairs across components that share a key.  Keys with the same least node
   are one group from here on: near copies share most of their keys, so a node stands in few
   groups however many keys it has.  Only groups of several components go on; they are cut
   into tiles of bounded size whose sketches are compared in one task.  Pairs within the
   Hamming bound are verified on the whole sets.  As long as that joins components, a tile
   sends only the nearest pairs that join all it could join; when it joins none any more, or
   nearly all of these pairs are linked, it sends all pairs that are left, and none is missed.
jaccard_components leaves out pairs already known to be in one component; jaccard_links
compares all different sets that share a key and gives every link between them.

Joins by key, hub or component have written tables on both sides, so Spark can split a
key that holds many rows.

Defined results: null texts and texts without words have an empty set, are linked with
nothing and are their own component.  Rows that repeat, or that share an id, are rows of
their own.  A null id never names a component unless all ids in it are null.  An empty
table gives an empty result.  Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import components
from ._parity import forest, hamming, most_apart, near_pairs, pigeonhole_keys, set_ids, sketch
from ._tables import discard, read, release, spool
from ._words import Words, distinct_sets, shingles, text_slices

SIZE, PERCENT = 4, 85
PART = 1 << 21  # shingles counted together when looking for common ones
COMMON = 500  # a shingle is common if one document of so many has it
MOST_COMMON = 1 << 20  # common shingles left out of the first sketch: 8 MB; any choice is right, this one is quick
MOSTLY = 0.75  # once so many of the nearest pairs are linked, little is left and all other pairs are sent
TILE = 4096  # nodes compared in one task: some MB of sketches


def _sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, data, offsets in text_slices(texts):
        yield a, b, *distinct_sets(*shingles(Words(data, offsets, lower=True), size))


def _describe(size: int):
    """From (doc_id, tx, text): a row for each document, and rows (null, null, count, shingle) of shingles common here."""

    def common(held: list[np.ndarray], docs: int) -> pa.RecordBatch:
        h, count = np.unique(np.concatenate(held), return_counts=True)
        often = count >= max(8, docs // COMMON)
        columns = [pa.nulls(int(often.sum()), pa.int64()), pa.nulls(int(often.sum()), pa.int64()), pa.array(count[often].astype(np.int64)), pa.array(h[often].view(np.int64)), pa.array(np.ones(int(often.sum()), bool))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "tx", "n", "node", "common"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, docs = [], 0, 0
        for batch in batches:
            for a, b, h, bounds in _sets(batch.column(2), size):
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(set_ids(h, bounds).view(np.int64)), pa.array(np.zeros(b - a, bool))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tx", "n", "node", "common"])
                held.append(h)
                total, docs = total + len(h), docs + b - a
                if total >= PART:
                    yield common(held, docs)
                    held, total, docs = [], 0, 0
        if held:
            yield common(held, docs)

    return emit


def _keys(size: int, percent: int, common):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, bounds in _sets(batch.column(0), size):
                doc, key = pigeonhole_keys(h, bounds, common.value, percent)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(set_ids(h, bounds)[doc].view(np.int64))], ["key", "node"])

    return emit


def _whole_sets(size: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, bounds in _sets(batch.column(0), size):
                sets = [h[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                columns = [pa.array(set_ids(h, bounds).view(np.int64)), pa.array(np.diff(bounds)), pa.array([sketch(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", "sketch", "hashes"])

    return emit


def _linked(percent: int):
    """From (a, b, ..., hashes of a, of b): the rows of pairs that are linked, without the hashes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, kept = [], batch.num_columns - 2
            for one, two in zip(batch.column(kept), batch.column(kept + 1), strict=True):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(range(kept)).filter(pa.array(good, pa.bool_()))

    return emit


def _close(percent: int):
    """From (a, b, n and sketch of a, n and sketch of b): the pairs within the bounds of size and Hamming distance."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            good = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            bound = most_apart(n, m, percent)
            for i in np.flatnonzero(good).tolist():
                good[i] = hamming(batch.column(3)[i].as_py(), batch.column(5)[i].as_py()) <= bound[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))

    return emit


def _tiles(percent: int, every: bool):
    """From (low, i, j, node, comp, tile, n, sketch) in order of low, i and j: pairs of nodes to verify with their components."""

    def pairs(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        node, comp = t.column("node").to_numpy(), t.column("comp").to_numpy()
        x, y, distance = near_pairs(t.column("sketch").to_pylist(), t.column("n").to_numpy(), comp, t.column("tile").to_numpy(), percent)
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


def _of_both(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """pairs with these columns of the sets of a and of b, as a_* and b_*."""
    for k in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in columns]), k)
    return pairs


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of pairs (a, b, ...) that are linked, by their whole sets."""
    df = _of_both(pairs, sets, "hashes").select(*pairs.columns, "a_hashes", "b_hashes")
    return df.mapInArrow(_linked(percent), pairs.schema)


def _describe_sets(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, tx, n, node) of every row; (node, low, high, times) of nodes that share keys, by the keys' ends; the sets of these nodes."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tx"), "text")
    found = spool(texts.mapInArrow(_describe(size), "doc_id long, tx long, n long, node long, common boolean"), "sets")
    known = found.filter("not common").drop("common")
    often = found.filter("common").groupBy("node").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "node").limit(MOST_COMMON)
    common = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in often.select("node").collect()], np.int64).view(np.uint64)))

    keys = texts.select("text").mapInArrow(_keys(size, percent, common), "key long, node long")
    ends = spool(keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high"), "ends")
    release(spark)
    shared = spool(keys.join(ends, "key").groupBy("node", "low", "high").agg(F.count("*").alias("times")), "shared")
    discard(ends)
    release(spark)

    nodes = shared.select("node").distinct()
    one_text = known.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "tx")).alias("at")).join(nodes, "node").select("at.*")
    one_text = one_text.select(F.col("doc_id").alias("_id"), F.col("tx").alias("_tx"))
    here = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tx") == F.col("_tx"))
    sets = texts.join(one_text, here, "left_semi").select("text").mapInArrow(_whole_sets(size), "node long, n long, sketch binary, hashes binary")
    sets = spool(sets, "whole-sets")
    if sets.count() > sets.select("node").distinct().count():  # only where rows agree in id and text
        twice, sets = sets, spool(sets.dropDuplicates(["node"]), "whole-sets")
        discard(twice)
    release(spark)
    return known, shared, sets


def _join_sets(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tx, n, node) of every row, and (node, comp) of the nodes that share keys with others."""
    known, shared, sets = _describe_sets(docs, size, percent)
    best = None
    for hub in ("low", "high"):
        count = shared.filter(f"node <> {hub}").groupBy("node", hub).agg(F.sum("times").alias("count"))
        top = count.groupBy("node").agg(F.max_by(hub, F.struct("count", hub)).alias("hub"))
        best = top if best is None else best.unionByName(top)
    pairs = spool(best.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "pairs")
    near = _of_both(pairs, sets, "n", "sketch").select("a", "b", "a_n", "a_sketch", "b_n", "b_sketch").mapInArrow(_close(percent), "a long, b long")
    links = spool(_verify(near, sets, percent), "links")
    joined = components(links).withColumnRenamed("comp", "linked")
    labels = spool(sets.select("node").join(joined, "node", "left").select("node", F.coalesce("linked", "node").alias("comp")), "labels")
    discard(links)
    release(docs.sparkSession)

    rows = _group_rows(shared, labels, sets, pairs)
    discard(shared, pairs)
    every = False
    while True:
        sent, more = _across(rows, sets, percent, every)
        tried, found = sent.count(), more.count()
        if found:
            # only components are joined from here on, so the graph shrinks from round to round
            onto = components(more.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))).select(F.col("node").alias("comp"), F.col("comp").alias("onto"))
            old, labels = labels, spool(_renamed(labels, onto), "labels")
            discard(old)
            if not every:
                old, named = rows, spool(_renamed(rows.drop("tiles"), onto), "named")
                rows = _open_groups(named)
                discard(old, named)
        discard(more, sent)
        release(docs.sparkSession)
        if every:
            discard(rows, sets)
            return known, labels
        every = not found or found > tried * MOSTLY


def _renamed(table: DataFrame, onto: DataFrame) -> DataFrame:
    """table with the components that onto (comp, onto) gives, where it has them."""
    return table.join(onto, "comp", "left").select(*[F.coalesce("onto", c).alias(c) if c == "comp" else c for c in table.columns])


def _open_groups(rows: DataFrame, compared: DataFrame | None = None) -> DataFrame:
    """Rows (low, node, comp, ...) of groups of several components with their number of tiles; not groups of two nodes that are compared already."""
    ends = rows.groupBy("low").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size"), F.min("node").alias("a"), F.max("node").alias("b")).filter("x < y")
    if compared is not None:
        ends = ends.join(compared.select("a", "b", F.lit(2).cast("long").alias("size")), ["a", "b", "size"], "left_anti")
    several = spool(ends.select("low", F.ceil(F.col("size") / TILE).cast("int").alias("tiles")), "several")
    left = spool(rows.join(several, "low"), "rows")
    discard(several)
    return left


def _group_rows(shared: DataFrame, labels: DataFrame, sets: DataFrame, compared: DataFrame | None = None) -> DataFrame:
    """(low, node, comp, tiles, n, sketch) of the nodes of open groups: nodes are looked up here, once for all rounds.

    A node meets its component and its sketch as one row with all its groups, of which it has no more than keys.
    """
    of_node = shared.groupBy("node").agg(F.collect_set("low").alias("lows")).join(labels, "node")
    named = spool(of_node.select(F.explode("lows").alias("low"), "node", "comp"), "named")
    left = _open_groups(named, compared)
    of_node = left.groupBy("node", "comp").agg(F.collect_list(F.struct("low", "tiles")).alias("at")).join(sets.select("node", "n", "sketch"), "node")
    rows = spool(of_node.select(F.explode("at").alias("at"), "node", "comp", "n", "sketch").select("at.low", "node", "comp", "at.tiles", "n", "sketch"), "rows")
    discard(named, left)
    return rows


def _across(rows: DataFrame, sets: DataFrame, percent: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, comp_a, comp_b) of different components from groups (low, tiles, node, comp, n, sketch), and those of them that are linked.

    All pairs that are left, or enough to join what a tile can join.
    """
    rows = rows.withColumn("tile", F.expr("cast(pmod(xxhash64(node), tiles) as int)")).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("low", F.least("tile", "_with").alias("i"), F.greatest("tile", "_with").alias("j"), "node", "comp", "tile", "n", "sketch")
    tiled = rows.repartition("low", "i", "j").sortWithinPartitions("low", "i", "j").mapInArrow(_tiles(percent, every), "a long, b long, comp_a long, comp_b long")
    pairs = spool(tiled.distinct(), "sent")
    return pairs, spool(_verify(pairs, sets, percent), "links")  # their sketches are compared in the tiles


def jaccard_links(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(a, b): every link between different sets, by their names; and (doc_id, tx, n_shingles, node, n_links): the set of every row.

    Rows with equal sets are one node; n_links counts the other nodes that it is linked with.
    """
    known, shared, sets = _describe_sets(docs, size, percent)
    own = sets.select("node", F.col("node").alias("comp"))
    links = _across(_group_rows(shared, own, sets), sets, percent, True)[1].select("a", "b")
    count = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    member = known.join(count, "node", "left").select("doc_id", "tx", F.col("n").alias("n_shingles"), "node", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return links, member


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, tx, n_shingles, component_id, group) of every row of docs.

    tx is the XXH64 of its text (null as empty), group a name of the component that null ids have too.
    """
    known, joined = _join_sets(docs, size, percent)
    least = known.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(joined, "node", "left")
    least = spool(least.select("node", "least", F.coalesce("comp", "node").alias("comp")), "least")
    of_comp = least.groupBy("comp").agg(F.min("least").alias("component"))
    named = spool(least.join(of_comp, "comp").select("node", "comp", "component"), "named")
    out = known.join(named, "node", "left")
    return out.select("doc_id", "tx", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.col("comp").alias("group"))


def one_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """docs with the row of least id of each component, of equal ids that of least text hash; rows without words all stay.

    Rows that agree in id and text are one document.
    """
    rows = jaccard_components(docs.select("doc_id", "text"), size, percent)
    first = rows.filter("n_shingles > 0").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tx")).alias("x"))
    stay = first.select("x.doc_id", "x.tx").unionByName(rows.filter("n_shingles = 0").select("doc_id", "tx")).distinct()
    stay = stay.select(F.col("doc_id").alias("_id"), F.col("tx").alias("_tx"))
    here = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_tx"))
    return docs.join(stay, here, "left_semi")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
