"""Substring deduplication: every repeated run of `window` words stays in its first document only.

A window is `window` consecutive words of one document.  A word goes when a window
that covers it also starts in a document with a smaller id.  Windows are judged on
the input, not on what is left.

Method: recompression (see _recompression) gives every window an anchor, a symbol
that equal windows share wherever they stand; windows with one anchor form segments.
1. Each document emits its segments: anchor, content hash, first and last window.
2. Anchors that only one document has are dropped: their windows are not repeated.
3. Segments with equal content hashes form a class.  In every document of a class
   but its first, all windows of the segment are repeated.
4. Where one anchor has several classes, the first document of each class also
   compares its single windows with the other classes' by hash: this verifies
   repeats that begin or end inside a segment.
5. The removed spans meet the texts again by document.

Contents are compared by two digests: a polynomial hash of the words and 64 bits of the
BLAKE2b digest of their bytes, so no accident of the one makes different passages equal.

A class, an anchor or a document may hold any share of the rows: classes and anchors are
reduced by partial minima, and the joins that follow have written tables on both sides, so
Spark can split the rows of one anchor, content or window over tasks.

Defined results: a null text has no words; documents without a repeat keep all words.
A null id is never smaller than another: such rows lose nothing and take nothing from
others.  Rows with equal ids never take words from each other.  Texts shorter than a
window lose nothing; texts of any length are read whole.  An empty table gives an empty result.  Only id and text are read;
every input row gives one output row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._recompression import Spans, segments
from ._tables import discard, read, release, spool
from ._words import Words, text_slices

WINDOW = 50
_SEGMENT = "doc_id long, mark int, first int, last int, anchor long, content long, check long"


def _mark() -> Column:
    return (F.crc32(F.coalesce("text", F.lit(""))) - F.lit(1 << 31)).cast("int")


def _long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _digests(words: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of the BLAKE2b digest of each span of words, joined by one space."""
    text = words.plain()
    raw, at = memoryview(text[0]), text[1]
    return np.array([int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little") for a, b in zip(at[start].tolist(), (at[end] - 1).tolist(), strict=True)], np.uint64)


def _segments(window: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            for a, _, data, offsets in text_slices(batch.column(2)):
                words = Words(data, offsets)
                doc, first, last, anchor, content = segments(words, window)
                base = words.first[:-1][doc]
                check = _digests(words, base + first, base + last + window)
                take = pa.array(doc + a)
                columns = [ids.take(take), marks.take(take), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), _long(anchor), _long(content), _long(check)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "first", "last", "anchor", "content", "check"])

    return emit


def _windows(window: int):
    """From (doc_id, mark, text, spans): each window of the spans once, with its digests."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(2)):
                words = Words(data, offsets)
                spans = Spans(words.hash)
                part = batch.column(3).slice(a, b - a)
                flat = part.flatten()
                first, last = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(b - a), np.diff(part.offsets.to_numpy()))
                n = last - first + 1
                which = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]
                start = at + words.first[:-1][doc[which]]
                take = pa.array(doc[which] + a)
                columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(at.astype(np.int32)), _long(spans.hash(start, start + window)), _long(_digests(words, start, start + window))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "first", "hash", "check"])

    return emit


def _covered(part: pa.Array, words: Words, window: int) -> np.ndarray:
    """For each word, whether the spans (first and last window by document) cover it."""
    flat = part.flatten()
    change = np.zeros(len(words.hash) + 1, np.int32)
    if len(flat):
        base = words.first[:-1][np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))]
        np.add.at(change, base + flat.field(0).to_numpy(), 1)
        np.add.at(change, base + flat.field(1).to_numpy() + window, -1)
    return np.cumsum(change[:-1]) > 0


def _finish(window: int, keep_text: bool):
    """From (doc_id, text, spans): word counts and the hash of the kept words, or the kept text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            for a, b, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets)
                gone = _covered(spans.slice(a, b - a), words, window)
                raw, out = data.tobytes(), []
                total = np.concatenate([[0], np.cumsum(gone)])
                lost = np.diff(total[words.first])
                for d in range(b - a):
                    text = raw[offsets[d] : offsets[d + 1]]
                    x, y = words.first[d], words.first[d + 1]
                    if not keep_text:
                        kept = text.split()
                        if lost[d]:
                            kept = [w for w, g in zip(kept, gone[x:y].tolist(), strict=True) if not g]
                        out.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    elif not lost[d]:
                        out.append(text.decode())
                    else:
                        edge = np.flatnonzero(np.diff(np.concatenate([[True], gone[x:y], [True]]).astype(np.int8)))
                        runs = zip(words.start[x + edge[0::2]], words.end[x + edge[1::2] - 1], strict=True)
                        out.append(b"\n".join(raw[s:e] for s, e in runs).decode())
                columns = [pa.array(words.count.astype(np.int64)), pa.array(lost.astype(np.int64)), pa.array(out, pa.string())]
                left = [batch.column(k).slice(a, b - a) for k in range(3, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns, *left], ["doc_id", "n_words", "n_removed", "kept", *batch.schema.names[3:]])

    return emit


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, mark, spans): for each document with repeats, ranges (first, last) of windows that start in a smaller one too.

    mark is the text's CRC-32: it tells rows with equal ids apart.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"), "text")
    texts = texts.filter("doc_id is not null and text is not null")
    found = spool(texts.mapInArrow(_segments(window), _SEGMENT), "segments")
    anchors = found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("content", "check") for f in (F.min, F.max)])
    anchors = spool(anchors.filter("a < b").select("anchor", F.expr("min_content < max_content or min_check < max_check").alias("several")), "anchors")
    release(docs.sparkSession)
    shared = spool(found.join(anchors, "anchor"), "shared")
    discard(found, anchors)
    release(docs.sparkSession)
    same = ["anchor", "content", "check"]
    classes = spool(shared.groupBy(*same).agg(F.min("doc_id").alias("owner")), "classes")
    judged = spool(shared.join(classes, same).filter("several or doc_id > owner").select("doc_id", "mark", "first", "last", (F.col("doc_id") == F.col("owner")).alias("owns")), "judged")
    discard(shared, classes)
    release(docs.sparkSession)
    owners = judged.filter("owns").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    singles = texts.join(owners, ["doc_id", "mark"]).select("doc_id", "mark", "text", "spans").mapInArrow(_windows(window), "doc_id long, mark int, first int, hash long, check long")
    singles = spool(singles, "windows")
    release(docs.sparkSession)
    first = singles.groupBy("hash", "check").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("_last")).filter("owner < _last").select("hash", "check", "owner")
    first = spool(first, "first")
    late = singles.join(first, ["hash", "check"]).filter("doc_id > owner").select("doc_id", "mark", "first", F.col("first").alias("last"))
    gone = judged.filter("not owns").select("doc_id", "mark", "first", "last").unionByName(late)
    spans = spool(gone.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")
    discard(judged, singles, first)
    release(docs.sparkSession)
    return spans


def _with_spans(docs: DataFrame, window: int) -> DataFrame:
    spans = repeated_spans(docs, window).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "spans")
    here = (F.col("doc_id").cast("long") == F.col("_id")) & (_mark() == F.col("_mark"))
    return docs.join(spans, here, "left").withColumn("_spans", F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>"))).drop("_id", "_mark", "spans")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with text cut down to its kept words, n_words before and n_removed; a line break joins what a cut leaves.

    Columns of docs named n_words or n_removed give way to these.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_words", "n_removed")]
    df = _with_spans(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_none"), *rest).alias("_rest")), window)
    df = df.select(F.col("doc_id").cast("long"), "text", "_spans", F.col("text").isNull().alias("_null"), "_rest")
    rest_type = df.schema["_rest"].dataType.simpleString()
    df = df.mapInArrow(_finish(window, True), f"doc_id long, n_words long, n_removed long, kept string, _null boolean, _rest {rest_type}")
    text = F.when(~F.col("_null"), F.col("kept")).alias("text")
    out = df.select("doc_id", text, "n_words", "n_removed", *[F.col("_rest").getField(c).alias(c) for c in rest])
    return out.select(*docs.drop("n_words", "n_removed").columns, "n_words", "n_removed")


def substring_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256: the kept words joined by one space."""
    df = _with_spans(docs.select("doc_id", "text"), window).select(F.col("doc_id").cast("long"), "text", "_spans")
    df = df.mapInArrow(_finish(window, False), "doc_id long, n_words long, n_removed long, kept string")
    return df.withColumnRenamed("kept", "kept_sha256")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(read(spark, sf_dir, "documents"))
