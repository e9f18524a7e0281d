"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio.

Every text is split into words ``[^\\x20\\x09-\\x0D]+``.  A document fails the
base rules when it is short or when most of its words lie in repeated 3-word
windows.  The others are judged by the mean, over their hashed word unigrams and
bigrams, of log p_target - log p_raw: two smoothed multinomials over the same
buckets, counted over all trusted documents and over all documents.  A document
is kept when that mean reaches a fixed threshold.

Only DataFrame functions run on the executors.  The driver sees one row for each
bucket, whatever the size of the corpus.

Defined results: a null or empty text has no words, all counts 0, and fails the
base rules.  Repeated rows are judged alike, each for itself.  With no trusted
document every ratio is 0.  An empty table gives an empty result.  Columns of the
input other than id and text are not read, so clashing names do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import read

SPACE = r"[\x20\x09-\x0D]+"
NONSPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
BUCKETS = 1 << 14
SMOOTHING = 20.0
HELD_IDS = 1 << 21  # trusted ids sent to every task: some 50 MB there
UNIT = 1 << 24  # ratios are whole multiples of 1 / UNIT
THRESHOLD = -0.045
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Starts of windows found twice or more, sorted.  A packed window holds the high bits of its hash over PLACES bits of its
# start, so a plain sort of longs brings windows of equal hash together; neighbours count only if their words are equal.
# Most texts have no near neighbours and stop there.  A text in which neighbours of equal hash differ in words, or with
# more words than PLACES bits can count, is sorted by the words of its windows instead, where equal ones always touch.
PLACES = 24


def _packed(places: int) -> str:
    low = (1 << places) - 1
    return f"""case when size(_words) between 3 and {low} then sort_array(transform(sequence(0, size(_words) - 3), i ->
        (shiftrightunsigned(xxhash64(_words[i], _words[i + 1], _words[i + 2]), 1) & {~low}L) | cast(i as bigint))) end"""


def _same(x: str, y: str, low: int) -> str:
    p, q = (f"cast({v} & {low}L as int)" for v in (x, y))
    return " and ".join(f"_words[{p} + {j}] = _words[{q} + {j}]" for j in range(3))


_BY_WORDS = """array_sort(transform(sequence(0, size(_words) - 3), i -> named_struct('w', concat_ws(' ', _words[i], _words[i + 1], _words[i + 2]), 'i', i)))"""


def _repeated_windows(df: DataFrame, places: int) -> DataFrame:
    """df with _repeated: the sorted starts of three-word windows that stand in their text twice or more."""
    low = (1 << places) - 1
    df = df.withColumn("_packed", F.expr(_packed(places)))
    df = df.withColumn("_near", F.expr(f"filter(_packed, (x, k) -> x - get(_packed, k - 1) <= {low}L)"))
    clash = f"exists(sequence(1, size(_packed) - 1), k -> _packed[k] - _packed[k - 1] <= {low}L and not ({_same('_packed[k]', '_packed[k - 1]', low)}))"
    df = df.withColumn("_clash", F.expr(f"case when size(_words) > {low} then true when size(_near) > 0 then {clash} else false end"))
    df = df.withColumn("_by_words", F.expr(f"case when _clash then {_BY_WORDS} end"))
    beside = " or ".join(f"coalesce(x - {y} between {-low}L and {low}L and {_same('x', y, low)}, false)" for y in ("get(_packed, k - 1)", "get(_packed, k + 1)"))
    repeated = f"""sort_array(case when _clash then transform(filter(_by_words, (x, k) -> coalesce(get(_by_words, k - 1).w = x.w, false) or coalesce(get(_by_words, k + 1).w = x.w, false)), x -> x.i)
        when size(_near) > 0 then transform(filter(_packed, (x, k) -> {beside}), x -> cast(x & {low}L as int)) else cast(array() as array<int>) end)"""
    return df.withColumn("_repeated", F.expr(repeated)).drop("_packed", "_near", "_clash", "_by_words")


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _text (null as empty) and _words."""
    return docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_words", F.array_remove(F.split("_text", SPACE), ""))


def base_counts(docs: DataFrame, text: str = "text", places: int = PLACES) -> DataFrame:
    """docs with _words, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    df = with_words(docs, text).withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.size(F.split("_text", SYMBOLS)) - 1).cast("long"),
            "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(NONSPACE)),
        }
    )
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    df = _repeated_windows(df, places)
    # sorted starts of repeated windows: each covers three words, less what the next one covers again
    covered = (
        "aggregate(_repeated, named_struct('at', -3, 'n', 0L),"
        " (a, p) -> named_struct('at', p, 'n', a.n + cast(least(3, p - a.at) as bigint)), a -> a.n)"
    )
    return df.withColumn("n_repeat_words", F.expr(covered)).drop("_repeated")


_ONE = f"cast(pmod(xxhash64(_word), {BUCKETS}L) as int)"
_TWO = f"cast(pmod(xxhash64(_word, _words[_at + 1]), {BUCKETS}L) as int)"


def _buckets(docs: DataFrame, *rest: str) -> DataFrame:
    """(bucket, rest) for every n-gram of _given."""
    df = with_words(docs, "_given").select(*rest, "_words", F.posexplode("_words").alias("_at", "_word"))
    df = df.select(*rest, F.expr(f"explode(array({_ONE}, case when _at + 1 < size(_words) then {_TWO} end))").alias("bucket"))
    return df.filter("bucket is not null")


def bucket_counts(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", held_ids: int = HELD_IDS) -> DataFrame:
    """(bucket, raw, target) over all documents; trusted: one row for each id of a trusted document.

    Texts are counted where they are read while the trusted ids, counted first, are few enough to be held by every task.
    Beyond that raw is still counted there, and texts meet the ids in a shuffle for target alone.
    """
    ids = trusted.select(F.col(doc_id).alias("_trusted_id")).distinct()
    df = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_given"))
    here = F.col("_id") == F.col("_trusted_id")
    if ids.limit(held_ids + 1).count() <= held_ids:
        df = df.join(F.broadcast(ids.withColumn("_trusted", F.lit(1))), here, "left")
        return _buckets(df, "_trusted").groupBy("bucket").agg(F.count("*").alias("raw"), F.coalesce(F.sum("_trusted"), F.lit(0)).alias("target"))
    raw = _buckets(df).groupBy("bucket").agg(F.count("*").alias("raw"))
    target = _buckets(df.join(ids.hint("merge"), here, "left_semi")).groupBy("bucket").agg(F.count("*").alias("target"))
    return raw.join(target, "bucket", "left").select("bucket", "raw", F.coalesce("target", F.lit(0)).alias("target"))


def bucket_weights(counts: DataFrame, smoothing: float = SMOOTHING) -> list[float]:
    """log p_target - log p_raw of each bucket, drawn to 0 as by `smoothing` n-grams found as often as expected.

    A bucket that the trusted documents are too few to judge says nothing, so small corpora keep what large ones keep.
    """
    rows = {r["bucket"]: (r["raw"], r["target"]) for r in counts.collect()}  # one row a bucket
    raw, target = (sum(x[k] for x in rows.values()) for k in (0, 1))
    out = [0.0] * BUCKETS
    if target:
        for b, (r, t) in rows.items():
            out[b] = math.log((t + smoothing) / (r * target / raw + smoothing))
    return out


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents that every label calls good and none toxic."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).filter("q = 1 and t = 0").select("doc_id")


def judged(docs: DataFrame, weights: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with _judged: the base counts, base_failed, llr (mean log ratio; 0 without words) and kept of each row.

    A row is judged where it is read and goes nowhere.  Ratios are summed as whole numbers, so the order of the sum cannot
    change a verdict.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    df = base_counts(docs.select(F.struct("*").alias("_all"), F.col(text).alias("_given")), "_given")
    held = f"cast(split('{','.join(str(round(w * UNIT)) for w in weights)}', ',') as array<bigint>)"  # one constant for the planner
    one, two, end = (f"_weights[xxhash64({x}) & {BUCKETS - 1}L]" for x in ("w", "w, get(_words, i + 1)", "element_at(_words, -1)"))
    # the last word has no next one, so its pair hashes as the word alone: taken off again
    ratio = f"case when n_words = 0 then 0L else aggregate(transform(_words, (w, i) -> {one} + {two}), -{end}, (s, x) -> s + x) end".replace("_weights", held)
    df = df.select("_all", *counts, F.expr(ratio).alias("_sum"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    llr = F.col("_sum") / (UNIT * F.greatest(2 * F.col("n_words") - 1, F.lit(1)))
    df = df.select("_all", *counts, failed.alias("base_failed"), llr.alias("llr"))
    verdict = F.struct(*counts, "base_failed", "llr", (~F.col("base_failed") & (F.col("llr") >= F.lit(threshold))).alias("kept"))
    return df.select("_all.*", verdict.alias("_judged"))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The verdict on each row of docs (doc_id, text): doc_id, counts, base_failed, llr and kept."""
    weights = bucket_weights(bucket_counts(docs, trusted_ids(labels)))
    return judged(docs.select("doc_id", "text"), weights, threshold=threshold).select("doc_id", "_judged.*")


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    weights = bucket_weights(bucket_counts(docs, trusted_ids(labels)))
    # exploded, not filtered: a filter would be moved below the columns that it needs and have them computed again and again
    return judged(docs, weights, threshold=threshold).select(*docs.columns, F.explode(F.expr("case when _judged.kept then array(1) end")).alias("_kept")).drop("_kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, read(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )
