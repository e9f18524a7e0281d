"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character 1-, 2- and 3-grams of the lower-cased text in which
everything but letters is a blank; an n-gram starts with a letter or a blank before one.
A document's value of a feature is its share of the document's n-grams times the
feature's inverse document frequency, counted over all learning rows.  The weights are
learnt by follow-the-regularised-leader (per-coordinate rates, elastic net: l1 makes them
sparse, l2 shrinks them) and a temperature, fitted on learning rows left out of this,
calibrates the probabilities.

Learning rows: those with a language whose crc32(doc_id as text) mod 4 is not 2.  The
document frequencies take all of them.  The weights and the temperature take a sample of
about SAMPLE rows of each language, chosen by a hash of the id: this bound is a parameter,
and keeps what the driver learns from at some tens of MB.  Prediction reads the text only.

Defined results: `und` with score 0 for null texts, texts without a letter, and where
there is nothing to learn from; ties go to the language that sorts first.  A null id is
not held out and not learnt from.  Rows that repeat are predicted alike.  An empty table
gives an empty result.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import read
from ._words import mix

BUCKETS = 1 << 15
SAMPLE = 500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.02
SCALE = 20.0
SLICE = 1 << 18  # characters handled at once
_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _tables["letters"]


def grams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, bucket of each n-gram, document of each n-gram from 0, number of letters of each document)."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= SLICE):
            size += len(texts[end] or "")
            end += 1
        low = [(t or "").lower() for t in texts[at:end]]
        # two blanks between texts: no n-gram holds letters of both
        code = np.frombuffer(("\0\0" + "\0\0".join(low) + "\0\0\0").encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[code]
        code = np.where(letter, code, 0).astype(np.uint64)
        length = np.fromiter(map(len, low), np.int64, len(low))
        start = np.cumsum(length + 2) - length  # of each text
        doc = np.repeat(np.arange(len(low)), length + 2)  # by the position before each text's first
        n = len(doc)
        one, two, three = code[1 : n + 1], code[2 : n + 2], code[3 : n + 3]
        begins = letter[1 : n + 1] | letter[2 : n + 2]
        h = one * _MULTIPLY[0]
        parts, docs = [], []
        for k, nxt in enumerate((None, two, three)):
            if nxt is not None:
                h = h + nxt * _MULTIPLY[k]
            use = np.flatnonzero(letter[1 : n + 1] if k == 0 else begins)
            parts.append((mix(h[use] + np.uint64(k)) >> np.uint64(49)).astype(np.int64))
            docs.append(doc[use])
        letters = np.add.reduceat(letter[: start[-1] + length[-1] + 1].astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
        letters[length == 0] = 0
        yield at, end, np.concatenate(parts), np.concatenate(docs), letters
        at = end


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count, total = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for a, b, bucket, doc, _ in grams(batch.column(0).to_pylist()):
            for d in range(0, b - a, 256):
                part = (doc >= d) & (doc < d + 256)
                seen = np.zeros((256, BUCKETS), bool)
                seen[doc[part] - d, bucket[part]] = True
                count += seen.sum(axis=0)
            total += b - a
    at = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(count[at], total))], ["bucket", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, text): lang, buckets and their shares of the n-grams."""
    for batch in batches:
        out = []
        for a, b, bucket, doc, _ in grams(batch.column(1).to_pylist()):
            order = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[order], np.arange(b - a + 1))
            for d in range(b - a):
                at, n = np.unique(bucket[order[cut[d] : cut[d + 1]]], return_counts=True)
                out.append((at.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
        columns = [batch.column(0), pa.array([x for x, _ in out], pa.list_(pa.int32())), pa.array([x for _, x in out], pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "at", "share"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(samples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights [bucket, class] learnt from (buckets, values, class) by FTRL-proximal steps."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * L1 - z
        return np.where(np.abs(z) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for epoch in range(epochs):
        for k in np.random.Generator(np.random.PCG64(epoch)).permutation(len(samples)):
            at, x, y = samples[k]
            w = weights(z[at], n[at])
            p = _softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    return weights(z, n)


def temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The divisor of the logits with the least log loss."""
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(np.log(0.02), np.log(20), 200)):
        loss = -np.log(np.maximum(_softmax(logits / t)[np.arange(len(classes)), classes], 1e-300)).mean()
        best = min(best, (loss, float(t)))
    return best[1]


class Model:
    """Languages, and for each bucket the weights times its inverse document frequency over the temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        for a, b, bucket, doc, letters in grams(texts):
            count = np.maximum(np.bincount(doc, minlength=b - a), 1)
            logits = np.stack([np.bincount(doc, self.weights[bucket, c], b - a) for c in range(len(self.languages))], axis=1) if self.languages else np.zeros((b - a, 1))
            p = _softmax(logits / count[:, None])
            known = (letters > 0) & bool(self.languages)
            scores[a:b] = np.where(known, p.max(axis=1), 0.0)
            names += [self.languages[k] if ok else "und" for k, ok in zip(p.argmax(axis=1).tolist(), known.tolist(), strict=True)]
        return names, scores


def train(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of rows (doc_id, text, lang), none of them null but the text."""
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 1)))
    counts = rows.select("text").mapInArrow(_document_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = {r["bucket"]: r["n"] for r in counts.collect()}  # at most one row a bucket
    total = found.pop(-1)
    idf = np.full(BUCKETS, np.log((1 + total) / 1) + 1)
    for b, n in found.items():
        idf[b] = np.log((1 + total) / (1 + n)) + 1
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    drawn = chosen.select("lang", "text").mapInArrow(_vectors, "lang string, at array<int>, share array<float>").collect()
    samples = [(np.array(r["at"], np.int64), np.array(r["share"]) * idf[r["at"]] * SCALE, languages.index(r["lang"])) for r in drawn if r["at"]]
    samples.sort(key=lambda s: (s[2], len(s[0]), s[0].tolist()[:50], s[1].tolist()[:50]))
    learn, rest = [s for k, s in enumerate(samples) if k % 5], samples[::5]
    weights = ftrl(learn, len(languages))
    logits = np.array([x @ weights[at] for at, x, _ in rest]) if rest else np.zeros((0, len(languages)))
    divide = temperature(logits, np.array([y for *_, y in rest])) if rest else 1.0
    return Model(languages, weights * (idf * SCALE / divide)[:, None])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id with lang_pred and score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = held.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(emit, "doc_id long, lang_pred string, score double")


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~_held_out()).select("doc_id", "text", "lang"))
    return identify(docs, model).withColumn("held_out", _held_out()).select("doc_id", "held_out", "lang_pred", "score")
