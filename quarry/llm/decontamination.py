"""Benchmark decontamination: which documents hold which test items, by size-partitioned MinHash containment.

Words are runs of letters and digits (A-Z lower-cased, all characters beyond ASCII
count as letters).  An item's set holds its distinct 5-word shingles; a shorter
item is one shingle of all its words.  A document holds an item when at least
`percent` of the item's set occurs in the document's.

Search: an item with n shingles may miss n * (100 - percent) // 100 of them, so of
its lowest hashes, its MinHash sketch, one more than that must hit the document.
The number of hashes follows the item's size, not the document's: short items are
found in documents of any length, and no item that meets the bound is missed.
Candidates are verified by counting shared shingles.

Items are partitioned by powers of two of their size.  Each partition has its own key space
and its own bound, the largest hash that it keeps, and a document looks up or sends a hash
in a partition only up to that bound.  Partitions with up to ITEM_HASHES shingles in all,
counted first, the smallest ones before, are broadcast, and every document is settled with
them in the task that reads it.  The others meet the documents in a shuffle by partition and
hash, of two written or freshly dealt tables, so Spark can split a very common hash.

Defined results: null or wordless texts and items match nothing.  Items that repeat
an id are items of their own; the pair gets the best of them, as it does for rows of
documents with one id.  Null ids pair as null.  Empty tables give an empty result.
Only ids and texts are read, so other columns of any name do no harm.  Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import read, spool
from ._words import PUNCTUATION, Words, distinct_sets, ragged, shingles, text_slices

SIZE, PERCENT = 5, 80
ITEM_HASHES = 1 << 20  # 8 MB of hashes and as much for their items
_PAIRS = "doc_id long, item long, n_item long, n_common long"


def _item_sets(size: int):
    """From (item, text): item, its distinct hashes and the words in a shingle."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets, lower=True, separators=PUNCTUATION)
                parts, width = [], np.minimum(words.count, size)
                for d in range(b - a):
                    one = Words(data[offsets[d] : offsets[d + 1]], np.array([0, offsets[d + 1] - offsets[d]]), lower=True, separators=PUNCTUATION)
                    parts.append(np.unique(one.runs(int(width[d]))[0]) if width[d] else np.zeros(0, np.uint64))
                hashes = pa.array([p.view(np.int64) for p in parts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), hashes, pa.array(width.astype(np.int32))], ["item", "hashes", "width"])

    return emit


def _document_sets(texts: pa.Array, widths: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Sorted distinct runs of every one of the widths, for each document."""
    for a, b, data, offsets in text_slices(texts):
        words = Words(data, offsets, lower=True, separators=PUNCTUATION)
        if len(widths) == 1:
            h, at = words.runs(widths[0])
            yield a, b, *distinct_sets(h, np.searchsorted(at, words.first))
            continue
        h, at = (np.concatenate(x) for x in zip(*[words.runs(w) for w in widths], strict=True))
        order = np.argsort(at, kind="stable")
        yield a, b, *distinct_sets(h[order], np.searchsorted(at[order], words.first))


def _kept(n: np.ndarray, percent: int) -> np.ndarray:
    """Hashes in the sketch of an item of n shingles."""
    return n * (100 - percent) // 100 + 1


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def _part(n: np.ndarray) -> np.ndarray:
    """The partition of an item of n shingles, at least one."""
    return np.frexp(n.astype(np.float64))[1] - 1


def _partitions(hashes: np.ndarray, bounds: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray, np.uint64]]:
    """For each partition by size: its sketches' hashes in order, their items, and the largest hash."""
    n, out = np.diff(bounds), []
    for part in np.unique(_part(n)).tolist():
        mine = np.flatnonzero(_part(n) == part)
        kept = np.minimum(_kept(n[mine], percent), n[mine])
        keys = hashes[ragged(bounds[:-1][mine], kept)]  # each set is sorted: its lowest hashes
        order = np.argsort(keys, kind="stable")
        out.append((keys[order], np.repeat(mine, kept)[order], keys.max()))
    return out


def _settle(percent: int, held):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths, hashes, bounds = held.value
        n = np.diff(bounds)
        parts = _partitions(hashes, bounds, percent)
        for batch in batches:
            for a, _, h, cut in _document_sets(batch.column(1), widths):
                found = [np.zeros((0, 2), np.int64)]
                for keys, item, largest in parts:
                    at = np.flatnonzero(h <= largest)
                    low, high = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
                    hit = np.flatnonzero(high > low)
                    doc = np.searchsorted(cut, at[hit], "right") - 1
                    times = (high - low)[hit]
                    found.append(np.stack([np.repeat(doc, times), item[ragged(low[hit], times)]], axis=1))
                pairs = np.unique(np.concatenate(found), axis=0)
                common = np.array([np.isin(hashes[bounds[i] : bounds[i + 1]], h[cut[d] : cut[d + 1]], assume_unique=True).sum() for d, i in pairs.tolist()], np.int64)
                size = n[pairs[:, 1]]
                good = common >= _needed(size, percent)
                columns = [batch.column(0).take(pa.array(pairs[good, 0] + a)), pa.array(pairs[good, 1]), pa.array(size[good]), pa.array(common[good])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item", "n_item", "n_common"])

    return emit


def _send(widths: list[int], largest: dict[int, int]):
    """Distinct hashes of each document, for each partition those up to its bound."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, h, cut in _document_sets(batch.column(2), widths):
                for part, bound in largest.items():
                    at = np.flatnonzero(h <= np.uint64(bound))
                    doc = pa.array(np.searchsorted(cut, at, "right") - 1 + a)
                    columns = [batch.column(0).take(doc), batch.column(1).take(doc), pa.array(np.full(len(at), part, np.int32)), pa.array(h[at].view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tx", "part", "hash"])

    return emit


def _count(percent: int, widths: list[int]):
    """From (doc_id, text, items with their hashes): the pairs that hold."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, cut in _document_sets(batch.column(1), widths):
                rows = []
                for d in range(b - a):
                    for x in batch.column(2)[a + d].as_py():
                        item = np.array(x["hashes"], np.int64).view(np.uint64)
                        common = int(np.isin(item, h[cut[d] : cut[d + 1]]).sum())
                        if common >= _needed(len(item), percent):
                            rows.append((batch.column(0)[a + d].as_py(), x["item"], len(item), common))
                columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], [], []))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item", "n_item", "n_common"])

    return emit


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, percent: int = PERCENT, item_hashes: int = ITEM_HASHES) -> DataFrame:
    """(doc_id, item_id, n_item, n_common, containment) of docs (doc_id, text) that hold items (item_id, text)."""
    spark = docs.sparkSession
    given = items.select(F.col("item_id").cast("long").alias("item"), "text")
    sets = given.mapInArrow(_item_sets(size), "item long, hashes array<long>, width int").filter("width > 0")
    sets = spool(sets.withColumn("part", F.floor(F.log2(F.size("hashes") + 0.5)).cast("int")), "items")
    facts = sets.groupBy("part").agg(F.sum(F.size("hashes")).alias("total"), F.collect_set("width").alias("widths")).orderBy("total", "part").collect()  # at most one row for each power of two
    widths = sorted({w for r in facts for w in r["widths"]})
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total, small, large = 0, [], []
    for r in facts:
        total += r["total"]
        (small if total <= item_hashes else large).append(r["part"])
    found = texts.limit(0).selectExpr("doc_id", "0L as item_id", "0L as n_item", "0L as n_common")
    if small:
        rows = sets.filter(F.col("part").isin(small)).select("item", "hashes").collect()  # at most item_hashes hashes
        parts = [np.sort(np.array(r["hashes"], np.int64).view(np.uint64)) for r in rows]
        held = spark.sparkContext.broadcast((widths, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])))
        names = spark.createDataFrame([(k, r["item"]) for k, r in enumerate(rows)], "item long, item_id long")
        found = found.unionByName(texts.mapInArrow(_settle(percent, held), _PAIRS).join(F.broadcast(names), "item").drop("item"))
    if large:
        found = found.unionByName(_by_shuffle(texts, sets.filter(F.col("part").isin(large)), widths, percent))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_common") / F.col("n_item"), "n_item", "n_common")).alias("x"))
    return best.select("doc_id", "item_id", "x.n_item", "x.n_common", (F.col("x.n_common") / F.col("x.n_item")).alias("containment"))


def _by_shuffle(texts: DataFrame, sets: DataFrame, widths: list[int], percent: int) -> DataFrame:
    texts = texts.withColumn("tx", F.xxhash64(F.coalesce("text", F.lit(""))))
    rank = F.expr(f"transform(hashes, h -> h ^ {-(1 << 63)}L)")  # unsigned order as signed order
    items = sets.withColumn("uid", F.xxhash64("item", "hashes")).withColumn("low", F.slice(F.sort_array(rank), 1, (F.size("hashes") * (100 - percent) / 100).cast("int") + 1))
    bound = {r["part"]: (r["x"] ^ -(1 << 63)) & ((1 << 64) - 1) for r in items.groupBy("part").agg(F.max(F.element_at("low", -1)).alias("x")).collect()}  # one row a partition
    keys = spool(items.select("uid", "part", F.explode("low").alias("k")).select("uid", "part", F.expr(f"k ^ {-(1 << 63)}L").alias("hash")), "keys")
    sent = texts.select("doc_id", "tx", "text").mapInArrow(_send(widths, bound), "doc_id long, tx long, part int, hash long")
    pairs = spool(sent.join(keys, ["part", "hash"]).select("doc_id", "tx", "uid").distinct(), "pairs")
    full = pairs.join(items.select("uid", "item", "hashes").distinct(), "uid")
    # a document's items in parts of bounded number, so that one that holds very many stays spread
    full = full.withColumn("part", F.pmod("uid", F.lit(64))).groupBy("doc_id", "tx", "part").agg(F.collect_list(F.struct("item", "hashes")).alias("items"))
    full = full.select(F.col("doc_id").alias("_id"), F.col("tx").alias("_tx"), "items")
    held = texts.join(full, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tx") == F.col("_tx"))).select("doc_id", "text", "items")
    return held.mapInArrow(_count(percent, widths), _PAIRS).withColumnRenamed("item", "item_id")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """docs without the rows whose id holds an item."""
    ids = contamination(docs, items, size, percent).select(F.col("doc_id").alias("_held")).distinct()
    return docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("_held")), "left_anti")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = r"""list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-/:-`{-\x7F]+'), lambda x: x <> '')"""

SQL = f"""
WITH item_words AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_sets AS (
    SELECT DISTINCT item_id, least(len(w), 5) AS width, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
doc_sets AS (
    SELECT DISTINCT doc_id, width, array_to_string(w[i : i + width - 1], ' ') AS s
    FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i
          FROM doc_words, (SELECT DISTINCT width FROM item_sets) WHERE len(w) >= width)),
sizes AS (SELECT item_id, count(*) AS n_item FROM item_sets GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_common FROM item_sets JOIN doc_sets USING (width, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_common, n_common / n_item AS containment
FROM shared JOIN sizes USING (item_id) WHERE 100 * n_common >= 80 * n_item
"""
