"""Spelling variant grouping: one-edit pairs of words by merging the light subtrees of their trie.

The words are the leaves of a trie; the end of a word is a child of its own, `END`.  At each node the child with
most words below it is heavy, the others are light: a word has at most log2(words) light edges on its way down.
Two words one edit apart part at one node, and at least one of them goes on through a light child.  So only light
subtrees are merged, with one character skipped or replaced, into what their node has otherwise:

* without its light character, a word coincides with a word that continues there at once;
* with the heavy character in place of the light one, or put before it, it coincides with a word below the heavy child;
* with any character in its place, it coincides with other light words of that node.

Coinciding terminals are the pairs, each found once.  A character is skipped only if the next one differs: of equal
neighbours the last is where two words part.

In Spark: one row for each node on a word's way, nodes named by a hash of the prefix; counts by node and child give
the heavy children; light edges are joined with them, and merged strings with the words.  Two prefixes of one hash
only share the choice of their heavy child, of which any choice is right, so no result rests on hashes.  Words that
light subtrees of one node share by any character are at most as many as the alphabet has characters.

Words are runs of letters, lower-cased (A-Z), of at least `least` code points that occur `often` times.  Where the
crc32 of `<doc_id>:<run>` is divided by ERRATUM, one code point is missing from the run: errata are part of the
definition.  A word's form is its near word of largest n, if that is `times` its own n; its root follows forms.

Defined results: null texts have no words, a null doc_id counts as an empty one before the colon.  Rows that repeat
or share an id count as often as they are there.  Ties of n: the least word in code-point order.  A very long text or
word is handled whole, in time and rows linear in its length.  An empty table gives an empty result.  Only doc_id
and text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import discard, read, spool
from ._words import mix

LEAST, OFTEN, TIMES = 6, 5, 5
ERRATUM = 199
HELD = 1 << 18  # words that a task counts before it sends them
END = -1  # the child of a node that stands for the end of a word
ANY = "*"  # in place of a character; no letter
_LETTERS = "A-Za-zÀ-ÿ"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CODE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64)  # letters are below 256


def _counted(least: int):
    """From (doc_id, text): (word, n) of the words of some documents."""
    run = re.compile(f"[{_LETTERS}]{{{least},}}")  # shorter runs give no word

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(run.findall(text.lower().decode("utf-8", "replace"))).items():  # of bytes: A-Z only
                    h = zlib.crc32(word.encode(), start)
                    if h % ERRATUM == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
            if len(held) >= HELD:
                yield rows(held)
                held = Counter()
        if held:
            yield rows(held)

    return emit


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, word): (node, child, id, at) for each node on a word's way; at: length of the node's prefix."""
    for batch in batches:
        words = batch.column(1).to_pylist()
        if not words:
            continue
        codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        size = np.array([len(w) for w in words])
        first = np.cumsum(size) - size
        power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(int(size.max()), _BASE, np.uint64))])
        at = np.arange(len(codes)) - np.repeat(first, size)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[codes] * power[at])])
        # one row more than characters for each word
        word = np.repeat(np.arange(len(words)), size + 1)
        place = np.arange(len(word)) - np.repeat(first + np.arange(len(words)), size + 1)
        node = mix(sums[first[word] + place] - sums[first[word]] + place.astype(np.uint64) * _CODE[0])
        ends = place == size[word]
        child = np.where(ends, END, np.append(codes, 0)[np.minimum(first[word] + place, len(codes))])
        columns = [pa.array(node.view(np.int64)), pa.array(child.astype(np.int32)), batch.column(0).take(pa.array(word)), pa.array(place.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["node", "child", "id", "at"])


def variant_words(docs: DataFrame, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """(id, word, n) of the words of docs, written; ids have no meaning."""
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counted(least), "word string, n long")
    counts = parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)
    return spool(counts.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")


def light_edges(words: DataFrame) -> DataFrame:
    """(id, at, heavy): where a word leaves the heavy path, and the character that it leaves behind (END: none)."""
    ways = words.select("id", "word").mapInArrow(_ways, "node long, child int, id long, at int")
    weight = ways.groupBy("node", "child").agg(F.count("*").alias("weight"))
    forks = weight.groupBy("node").agg(F.max_by("child", F.struct("weight", "child")).alias("heavy"), F.count("*").alias("children")).filter("children > 1")
    forks = spool(forks.select("node", "heavy"), "forks")  # written, so that Spark can split the join at the nodes near the root
    return ways.join(forks, "node").filter("child <> heavy").select("id", "at", "heavy")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many near words a word has, and the (-n, word) of the first of them in order of n; without words that have none."""
    light = spool(words.join(light_edges(words), "id"), "light").withColumns({
        "head": F.expr("substr(word, 1, at)"), "own": F.expr("substr(word, at + 1, 1)"), "rest": F.expr("substr(word, at + 2)"),
        "other": F.when(F.col("heavy") != END, F.expr("chr(heavy)")),
    })
    skipped = F.when((F.col("own") != "") & (F.col("own") != F.expr("substr(rest, 1, 1)")), F.concat("head", "rest"))
    replaced = F.when(F.col("own") != "", F.concat("head", "other", "rest"))
    before = F.concat("head", "other", "own", "rest")
    mine = F.struct((-F.col("n")).alias("less"), "word").alias("mine")
    merged = light.select(mine, F.explode(F.array(skipped, replaced, before)).alias("word")).filter("word IS NOT NULL")
    met = merged.join(words.select("word", "n"), "word").select("mine", F.struct((-F.col("n")).alias("less"), "word").alias("theirs"))
    one = met.select(F.explode(F.array(F.struct(F.col("mine.word").alias("word"), F.col("theirs").alias("best")), F.struct(F.col("theirs.word").alias("word"), F.col("mine").alias("best")))).alias("x"))
    one = one.select("x.word", F.lit(1).cast("long").alias("n_near"), "x.best")
    # a node has at most as many light children as there are letters, so these lists are short
    side = light.filter("own <> ''").groupBy(F.concat("head", F.lit(ANY), "rest").alias("merged")).agg(F.collect_list(mine).alias("all")).filter("size(all) > 1")
    two = side.select(F.explode("all").alias("mine"), "all")
    two = two.select("mine.word", (F.size("all") - 1).cast("long").alias("n_near"), F.expr("array_min(filter(all, x -> x.word <> mine.word))").alias("best"))
    return one.unionByName(two).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each chain of forms, by doubling.  n grows from form to form, so chains are short and have no cycle."""
    up = spool(forms.select("word", F.col("form").alias("root")), "up")
    while True:
        on = up.join(up.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        last, up = up, spool(on.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "up")
        discard(last)
        if up.filter("moved").isEmpty():
            return up.select("word", "root")


def spelling_variants(docs: DataFrame, least: int = LEAST, often: int = OFTEN, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs."""
    words = variant_words(docs, least, often)
    found = words.join(near_words(words), "word", "left").withColumn("good", -F.col("best.less") >= times * F.col("n"))
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("good"), F.col("best.word")).alias("form"), F.when(F.col("good"), -F.col("best.less")).alias("form_n"))
    found = spool(found, "forms")
    roots = roots_of(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))
