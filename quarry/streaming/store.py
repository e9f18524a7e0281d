"""Tables that change together, batch by batch, in versions.

A store is a folder that all executors share.  Each table is cut into buckets by a hash of its key.  A batch reads and
writes only the buckets that its rows fall into; all others stay as they are in the folders of earlier batches.  What
a batch has written counts once its manifest is in the log: one small file that names the folder of each bucket of
each table.  It is written under another name and renamed, never over a file that exists.  So a batch that fails at any
point leaves the last version whole in all tables, a batch that is in the log is not applied again, and of two writers
of one version the second starts over from the version of the first.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, batch string, tables map<string,map<string,string>>"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Table:
    """schema: DDL of its columns; key: columns by which rows are dealt to buckets; buckets: how many, for good."""

    schema: str
    key: tuple[str, ...]
    buckets: int = 64


@dataclass(frozen=True)
class Change:
    """Rows that come with a batch, and what becomes of the stored rows of their buckets and them."""

    rows: DataFrame
    merge: Merge


class Store:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table]):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/log"))

    def log(self) -> DataFrame:
        """(version, batch, tables) of every version."""
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/log")

    def state(self, batch: str | None = None) -> tuple[int, dict[str, dict[str, str]], bool]:
        """Number and folders of the last version, and whether a batch is in the log."""
        row = self.log().agg(F.max_by(F.struct("version", "tables"), "version").alias("x"), F.max(F.col("batch").eqNullSafe(F.lit(batch))).alias("there")).first()
        return (row["x"]["version"], row["x"]["tables"], bool(row["there"])) if row["x"] else (0, {}, False)

    def read(self, table: str, tables: dict | None = None, buckets: set[str] | None = None) -> DataFrame:
        """A table as of the last version, or of these folders; only some buckets of it where they are named."""
        at = (self.state()[1] if tables is None else tables).get(table) or {}
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in sorted(at.items()) if buckets is None or b in buckets]
        schema = self.tables[table].schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, name: str, change: Change, before: dict, folder: str) -> dict[str, str]:
        """The folders of a table's buckets once a change is applied; writes the touched ones."""
        t = self.tables[name]
        columns = self.spark.createDataFrame([], t.schema).columns
        bucket = F.pmod(F.xxhash64(*t.key), F.lit(t.buckets)).cast("string")
        touched = {r[0] for r in change.rows.select(bucket.alias("bucket")).distinct().collect()}  # at most as many as there are buckets
        if not touched:
            return before.get(name) or {}
        merged = change.merge(self.read(name, before, touched), change.rows).select(*columns, bucket.alias("bucket"))
        at = f"{folder}/{name}"
        merged.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/data/{at}")
        left = {s.getPath().getName()[7:] for s in self._fs.listStatus(self._path(f"{self.path}/data/{at}")) if s.getPath().getName().startswith("bucket=")}
        if left - touched:
            raise ValueError(f"{name}: the merge gave rows of buckets that the batch does not touch")
        return {b: f for b, f in (before.get(name) or {}).items() if b not in touched} | {b: at for b in left}

    def _publish(self, version: int, batch: str, tables: dict, folder: str) -> bool:
        """Puts a manifest into the log, whole or not at all; False if another writer has put one of this version."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        pending, at = self._path(f"{self.path}/pending/{folder}"), self._path(f"{self.path}/log/{version:012d}.json")
        out = self._fs.create(pending, True)
        out.write(bytearray(json.dumps({"version": version, "batch": batch, "tables": tables}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(pending, at, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError:
            if self._fs.exists(at):
                return False
            raise
        return True

    def _clear(self, mark: str) -> None:
        """Deletes what earlier tries of a batch, which is not in the log, have left."""
        for kind in ("data", "pending"):
            path = self._path(f"{self.path}/{kind}")
            for s in self._fs.listStatus(path) if self._fs.exists(path) else []:
                if s.getPath().getName().startswith(mark):
                    self._fs.delete(s.getPath(), True)

    def commit(self, batch: str, changes: dict[str, Change]) -> bool:
        """Applies a batch to all its tables at once; False if it is applied already."""
        mark = f"{hashlib.sha256(batch.encode()).hexdigest()[:16]}-"
        version, before, there = self.state(batch)
        while not there:
            self._clear(mark)
            folder = f"{mark}{uuid.uuid4().hex}"
            tables = dict(before) | {name: self._write(name, change, before, folder) for name, change in changes.items()}
            if self._publish(version + 1, batch, tables, folder):
                return True
            version, before, there = self.state(batch)
        return False

    def prune(self, keep: int = 2) -> int:
        """Deletes bucket folders that none of the last `keep` versions has; how many.  The log stays: it knows which batches are in.

        Folders of batches that are not in the log are left alone, as they may be at work.
        """
        log = self.log().select("version", F.explode("tables").alias("t", "m")).select("version", F.explode("m").alias("b", "f"))
        last = self.state()[0]
        gone = log.groupBy("f", "b").agg(F.max("version").alias("v")).filter(F.col("v") <= last - keep)
        n = 0
        for row in gone.toLocalIterator():
            n += self._fs.delete(self._path(f"{self.path}/data/{row.f}/bucket={row.b}"), True)
        return n


def upsert(key: list[str], order: list[str] | None = None) -> Merge:
    """Incoming rows take the place of stored ones of their key; with order, the last row of both stays."""
    from ..operators.merge import latest_per_key

    def merge(stored: DataFrame, rows: DataFrame) -> DataFrame:
        if order:
            return latest_per_key(stored.unionByName(rows), key, *[F.col(c) for c in order])
        return stored.join(rows.select(*key).distinct().hint("merge"), key, "left_anti").unionByName(rows)  # both grow: neither is sent whole to every task

    return merge


def keep_latest_in(stream: DataFrame, store: Store, table: str, key: list[str], order: list[str], checkpoint: str) -> None:
    """Runs a stream to its end; each micro-batch rewrites the buckets that it touches, and one that is sent again changes nothing."""

    def apply(rows: DataFrame, number: int) -> None:
        latest = upsert(key, order)
        store.commit(f"{table}-{number}", {table: Change(latest(rows.limit(0), rows).select(*rows.columns), latest)})
        store.prune()

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
