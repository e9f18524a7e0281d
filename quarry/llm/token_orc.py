"""Token ids as ORC: written in ascending document order, read back by stripes.

Texts are range-partitioned by document id, encoded task by task and written as
ORC lists of integers: integer run-length encoding packs the ids, row indexes and
a Bloom filter on the document id let readers skip stripes.  Each output file
covers one range of ids, so file order and place in the file give the order.

Every white-space-delimited piece of a text is encoded by the tokenizer on its own
and remembered by the worker: the vocabulary's normaliser lowers letters and drops white
space, and no pre-token spans it, so the pieces' ids joined are those of the whole text.

Defined results: a null text is empty and gives the end id alone.  Null ids come
first.  Rows with equal ids are ordered by their text and kept apart.  An empty
table gives an empty result.  Only id and text are read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tables import fresh_path, read, spool
from ._words import ragged

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
REMEMBERED = 3 << 19  # pieces a worker remembers before it starts anew
MARKS = b".,;:!?|*#%&$"  # a word's letters and such marks after it are pre-tokens of their own
ROWS = 512  # documents encoded at once

_memories: dict[str, "_Memory"] = {}


class _Memory:
    """Ids of the pieces that this worker has met, for all tasks that it runs."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.isabs(tokenizer):
            import public_tokenizers

            tokenizer = public_tokenizers.path(tokenizer)
        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.ids, self.start, self.length = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.used = 0

    def _add(self, pieces: list[bytes], ids: np.ndarray, length: np.ndarray) -> None:
        n, total = len(self.codes), int(length.sum())
        while len(self.ids) < self.used + total:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.start) < n + len(pieces):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.ids[self.used : self.used + total] = ids
        self.length[n : n + len(pieces)] = length
        self.start[n : n + len(pieces)] = self.used + np.cumsum(length) - length
        self.used += total
        self.codes.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def _lengths_of_words(self, ids: np.ndarray) -> np.ndarray:
        return np.diff(np.flatnonzero(self.ends_word[ids]) + 1, prepend=0)

    def _learn_words(self, pieces: list[bytes]) -> None:
        """Pieces of letters alone: each is one pre-token, so many are encoded as one text and cut at the ends of words."""
        parts = [pieces[at : at + 1000] for at in range(0, len(pieces), 1000)]
        found = self.tokenizer.encode_batch_fast([b" ".join(part).decode() for part in parts], add_special_tokens=False)
        for part, encoded in zip(parts, found, strict=True):
            ids = np.array(encoded.ids, np.int32)
            length = self._lengths_of_words(ids)
            if len(length) == len(part) and length.sum() == len(ids):
                self._add(part, ids, length)
            else:
                self._learn_any(part)

    def _learn_any(self, pieces: list[bytes]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        length = np.fromiter(map(len, found), np.int64, len(found))
        self._add(pieces, np.fromiter((i for x in found for i in x), np.int32, int(length.sum())), length)

    def learn(self, pieces: list[bytes]) -> None:
        """Learns new pieces; a word and the marks after it are learnt apart and put together, capitals as small letters."""
        split, whole, words, marks = [], [], {}, {}
        for p in pieces:
            core = p.rstrip(MARKS)
            low = core.lower()
            if not core or not core.decode().lower().isalpha():  # lowered, a letter may bring a mark
                whole.append(p)
            elif low == p:
                words[p] = None
            else:
                split.append((p, low, p[len(core) :]))
                words[low] = None
                if len(core) < len(p):
                    marks[p[len(core) :]] = None
        self._learn_words([w for w in words if w not in self.codes])
        alone = set(whole)
        self._learn_any([*whole, *(m for m in marks if m not in self.codes and m not in alone)])
        if split:
            parts = np.array([(self.codes[w], self.codes[m] if m else -1) for _, w, m in split])
            one, two = self.length[parts[:, 0]].astype(np.int64), np.where(parts[:, 1] >= 0, self.length[parts[:, 1]], 0).astype(np.int64)
            starts, lengths = np.empty(2 * len(split), np.int64), np.empty(2 * len(split), np.int64)
            starts[0::2], starts[1::2] = self.start[parts[:, 0]], self.start[parts[:, 1]]
            lengths[0::2], lengths[1::2] = one, two
            self._add([p for p, _, _ in split], self.ids[ragged(starts, lengths)], one + two)

    def encode(self, texts: list[str | None], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        split = [(t or "").encode().split() for t in texts]
        pieces = [p for x in split for p in x]
        codes = np.array([self.codes.get(p, -1) for p in pieces], np.int64)
        new = np.flatnonzero(codes < 0).tolist()
        if new:
            if len(self.codes) + len(new) > REMEMBERED:
                self.clear()
                new = range(len(pieces))
            self.learn(list({pieces[i]: None for i in new}))
            for i in new:
                codes[i] = self.codes[pieces[i]]
        length = self.length[codes].astype(np.int64)
        ids = self.ids[ragged(self.start[codes], length)]
        pieces_of = np.fromiter(map(len, split), np.int64, len(split))
        ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum(pieces_of)]
        counts = np.diff(ends, prepend=0)
        if end_id is None:
            return ids, counts
        return np.insert(ids, ends, np.int32(end_id)), counts + 1


def memory(tokenizer: str) -> _Memory:
    if tokenizer not in _memories:
        _memories[tokenizer] = _Memory(tokenizer)
    return _memories[tokenizer]


def _encoder(tokenizer: str, end_id: int | None):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = memory(tokenizer), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, counts = known.encode(part.column(1).to_pylist(), end_id)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                places = pa.array(np.arange(place, place + part.num_rows))
                place += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), places, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "place", "ids"])

    return encode


def write_token_orc(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int | None = END_ID) -> None:
    """Writes (doc_id, place in the file, ids) of docs (doc_id, text) to ORC files in ascending order of doc_id."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(_encoder(tokenizer, end_id), "doc_id long, place long, ids array<int>")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.create.index": "true", "orc.row.index.stride": "1000", "compression": "zstd"}
    encoded.write.options(**options).orc(path)


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files, with file: their order."""
    df = spark.read.schema("doc_id long, place long, ids array<int>").orc(path)
    return df.withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        crc = np.fromiter((zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.int64, len(ids))
        columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "file", "place", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row of the files, from the files alone."""
    rows = read_token_orc(spark, path).select("doc_id", "file", "place", "ids")
    rows = spool(rows.mapInArrow(_digest, "doc_id long, file long, place long, n_tokens long, ids_crc32 long"), "digests")
    # ids before each file: one row a file; before a row in its file: a running sum over that file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_file_start"))
    within = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(files, "file")
    return rows.select("doc_id", (F.col("_start") + F.col("_file_start")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-orc")
    write_token_orc(read(spark, sf_dir, "documents"), path)
    return token_digests(spark, path)
