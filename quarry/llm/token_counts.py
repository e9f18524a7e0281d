"""Token counts: rollups by source, language and tokenizer version, maintained by signed deltas.

A rollup holds additive totals, n_docs and n_tokens.  A batch is a table of signed rows:
+1 for a document that comes or the new count of a revised one, -1 for one that goes or
its old count.  Committing a batch adds its sums, pre-aggregated before the shuffle, to
the totals of the last version, writes them to a folder of their own, and then puts the
entry of the next version into the log: one small file that names the batch and the folder.
It is written under another name and renamed, never over a file that exists, so the log has
whole entries only, and of two writers of one version only one wins; the other deletes what
it wrote and starts over from the version that won.  A batch that is in the log is not added
again, and a commit that failed at any point can be repeated: it deletes what earlier tries
of its batch left.  The log is read as a table.

Defined results: a null text has no tokens but is a document; null sources, languages
and tokenizers are groups of their own; null counts and signs are 0.  Rows that repeat
count as often as they stand.  Groups whose documents and tokens are all gone disappear.
An empty batch commits and changes nothing, also as the first one.  Columns of documents
named tokenizer or n_tokens give way to the counts; other columns are left alone.  Texts of
any length are counted whole.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import fresh_path, read, spool

KEYS = ["source", "lang", "tokenizer"]
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "words-2": r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]"}
_TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def counted(docs: DataFrame, tokenizers: dict[str, str] = TOKENIZERS) -> DataFrame:
    """docs with tokenizer and n_tokens, one row for each tokenizer; a tokenizer is a pattern of one token."""
    text = F.coalesce("text", F.lit(""))
    each = [F.struct(F.lit(name).alias("name"), F.regexp_count(text, F.lit(pattern)).cast("long").alias("n")) for name, pattern in tokenizers.items()]
    rest = [c for c in docs.columns if c not in ("tokenizer", "n_tokens", "text")]
    return docs.select(*rest, F.explode(F.array(*each)).alias("_t")).select(*rest, F.col("_t.name").alias("tokenizer"), F.col("_t.n").alias("n_tokens"))


def signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.select(*KEYS, "n_tokens", F.lit(sign).cast("long").alias("sign"))


def _mark(batch: str) -> str:
    """How the names of all that belongs to a batch begin."""
    return f"{hashlib.sha256(batch.encode()).hexdigest()[:16]}-"


class Rollup:
    """A rollup in a folder that all executors share: `log` holds one entry for each version, `totals` their tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/log"))

    def log(self) -> DataFrame:
        """(version, batch, folder) of every version."""
        return self.spark.read.schema("version long, batch string, folder string").json(f"{self.path}/log")

    def batches(self) -> set[str]:
        return {r[0] for r in self.log().select("batch").collect()}

    def _state(self, batch: str | None = None) -> tuple[int, str | None, bool]:
        """Number and folder of the last version, and whether a batch is in the log, in one reading of it."""
        row = self.log().agg(F.max(F.struct("version", "folder")).alias("x"), F.max(F.col("batch").eqNullSafe(F.lit(batch))).alias("there")).first()
        return (row["x"]["version"], row["x"]["folder"], bool(row["there"])) if row["x"] else (0, None, False)

    def _table(self, folder: str | None) -> DataFrame:
        return self.spark.read.schema(_TOTALS).parquet(f"{self.path}/totals/{folder}") if folder else self.spark.createDataFrame([], _TOTALS)

    def totals(self) -> DataFrame:
        return self._table(self._state()[1])

    def _delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def _publish(self, version: int, batch: str, folder: str) -> bool:
        """Puts the entry of a version into the log, whole or not at all; False if another writer has put one.

        The entry is written under another name first: a crash on the way leaves a file that no reader looks at.
        """
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        pending = self._path(f"{self.path}/pending/{folder}.json")
        out = self._fs.create(pending, True)
        out.write(bytearray(json.dumps({"version": version, "batch": batch, "folder": folder}).encode()))
        out.close()
        at = self._path(f"{self.path}/log/{version:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            context.rename(pending, at, gateway.new_array(rename, 0))  # never over a file that exists
        except Py4JJavaError:
            if self._fs.exists(at):
                self._delete(f"pending/{folder}.json")
                return False
            raise
        return True

    def _orphans(self, batch: str) -> list[str]:
        """Folders and entries that earlier tries of a batch, which is not in the log, have left."""
        mark = _mark(batch)
        found = []
        for kind in ("totals", "pending"):
            path = self._path(f"{self.path}/{kind}")
            if self._fs.exists(path):
                found += [f"{kind}/{s.getPath().getName()}" for s in self._fs.listStatus(path) if s.getPath().getName().startswith(mark)]
        return found

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds a batch of (source, lang, tokenizer, n_tokens, sign); False if it is in already."""
        sign = F.coalesce("sign", F.lit(0))
        new = deltas.groupBy(*KEYS).agg(F.sum(sign).alias("n_docs"), F.sum(sign * F.coalesce("n_tokens", F.lit(0))).alias("n_tokens"))
        version, last, there = self._state(batch)
        if there:
            return False
        for name in self._orphans(batch):
            self._delete(name)
        while not there:
            folder = f"{_mark(batch)}{uuid.uuid4().hex}"
            both = self._table(last).unionByName(new).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            both.filter("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{self.path}/totals/{folder}")
            if self._publish(version + 1, batch, folder):
                return True
            self._delete(f"totals/{folder}")
            version, last, there = self._state(batch)
        return False


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token counts of all documents in full: stale counts come first and are revised, toxic documents go and come again, and two batches are sent again."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rollup = Rollup(spark, fresh_path(spark, "rollup"))
    # texts are counted once; each batch reads the counts
    counts = spool(counted(docs.select("doc_id", "source", "lang", "text")), "counts")
    stale = counts.withColumn("n_tokens", F.least("n_tokens", F.lit(1000).cast("long")))
    toxic = counts.join(labels.filter("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    long = counts.filter("n_tokens > 1000")
    revise = signed(long.withColumn("n_tokens", F.lit(1000).cast("long")), -1).unionByName(signed(long, 1))
    batches = {"insert": signed(stale, 1), "revise": revise, "delete": signed(toxic, -1), "again": signed(toxic, 1)}
    for name in ("insert", "revise", "delete", "revise", "again", "insert"):
        rollup.commit(name, batches[name])
    return rollup.totals()


SQL = r"""
WITH counts AS (
    SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents
    UNION ALL
    SELECT source, lang, 'words-2', len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]')) FROM documents)
SELECT source, lang, tokenizer, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM counts GROUP BY ALL
"""
