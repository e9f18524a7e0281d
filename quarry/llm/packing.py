"""Best-fit packing of documents into bins of fixed capacity, without conflicts.

A bin holds at most `capacity` words, no two documents of one source and no two of one
duplicate cluster.  Bins are kept in order of what they have left.  A document, longest
first, goes to the tightest bin that takes it: the search starts at the least residual
that suffices and steps to the next until neither the bin's source bitmap nor its cluster
bitmap has the document's bit; else it opens a bin.

Documents are dealt by a hash of id and piece to shards of about SHARD rows, and each
shard is packed for itself: a source or cluster with any share of all rows is spread over
all shards, and a task never holds more than a shard at once.  Texts longer than a bin are
cut into full pieces, each of which fills a bin alone, and a rest.

Defined results: a null or empty text is one piece of 0 words.  A null source or cluster
conflicts with nothing.  Ties go by id, piece and then cluster and source, bins of equal
residual by age.  Rows that repeat are packed each for itself, in different bins.  An empty
table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import read

CAPACITY = 2048
SHARD = 2048
_OUT = "doc_id long, piece int, n_words long, source string, cluster long, bin long, residual long"


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """The bin of each item, taken in the given order, and what each bin has left."""
    source_bit: dict = {}
    cluster_bit: dict = {}
    order: list[tuple[int, int]] = []  # (residual, bin)
    source_map, cluster_map, left, out = [], [], [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        at = bisect_left(order, (size, -1))
        while at < len(order) and (source_map[order[at][1]] & s or cluster_map[order[at][1]] & c):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(left)
            source_map.append(0)
            cluster_map.append(0)
            left.append(capacity)
        source_map[b] |= s
        cluster_map[b] |= c
        left[b] = residual - size
        insort(order, (left[b], b))
        out.append(b)
    return out, left


def _pack(capacity: int):
    """From (shard, doc_id, piece, n_words, source, cluster), each shard's rows together and longest first."""

    def packed(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        bins, left = best_fit(t.column("n_words").to_pylist(), t.column("source").to_pylist(), t.column("cluster").to_pylist(), capacity)
        base = t.column("shard")[0].as_py() << 32
        columns = [t.column(c).combine_chunks() for c in ("doc_id", "piece", "n_words", "source", "cluster")]
        columns += [pa.array([base + b for b in bins], pa.int64()), pa.array([left[b] for b in bins], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "n_words", "source", "cluster", "bin", "residual"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard, at = batch.column(0).to_numpy(), 0
            while at < batch.num_rows:
                end = int((shard[at:] != shard[at]).argmax()) + at
                end = batch.num_rows if end == at else end
                if held and held[0].column(0)[0].as_py() != shard[at]:
                    yield packed(held)
                    held = []
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield packed(held)

    return emit


def best_fit_packing(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, n_words, source, cluster, bin, residual) for items (doc_id, n_words, source, cluster).

    residual is what the bin has left in the end.  A null n_words is 0: such an item takes no room in the bin it gets.
    """
    pieces = items.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("n_words").cast("long"), F.lit(0)).alias("_n"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("long").alias("cluster"))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / capacity).cast("int") - 1, F.lit(0)))))
    pieces = pieces.withColumn("n_words", F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("piece") * capacity))
    shards = max(1, -(-items.count() // shard))
    # the cluster is no part of the hash: copies of one text are spread
    pieces = pieces.select(F.pmod(F.xxhash64("doc_id", "piece", F.lit("shard")), F.lit(shards)).alias("shard"), "doc_id", "piece", "n_words", "source", "cluster")
    dealt = pieces.repartition("shard").sortWithinPartitions("shard", F.desc("n_words"), "doc_id", "piece", "cluster", "source")
    return dealt.mapInArrow(_pack(capacity), _OUT)


def document_items(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, source, cluster) of docs: texts that are equal but for case and white space are a cluster."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    df = docs.select("doc_id", "source", words.alias("w"))
    cluster = F.when(F.size("w") > 0, F.xxhash64(F.lower(F.array_join("w", " "))))
    return df.select("doc_id", F.size("w").cast("long").alias("n_words"), "source", cluster.alias("cluster"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(document_items(read(spark, sf_dir, "documents")))
