"""Streams over ledgers of events.

The states here are the latest row of each key by (time, id), which neither order of
arrival nor repeats change: every micro-batch is reduced to a row a key and merged into
the written table, and a batch that is sent again merges to the same.  Event time is the
ledger's own; the windowed counts drop what is later than their watermark.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import latest_per_key

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_ledger(spark: SparkSession, path: str, schema: str = EVENTS, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def status_of(event: Column) -> Column:
    """The status that an event leaves; opening a draft is an event, not a status."""
    return F.when(event == "opened_in_email", "ready").otherwise(event)


def keep_latest(stream: DataFrame, key: list[str], order: list[str], table: str, checkpoint: str) -> None:
    """Runs the stream to its end and keeps the latest row of each key in versions of a table.

    A version is written whole under the number of its batch, so a batch that is run again overwrites what it wrote.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        before = versions(spark, table, below=number)
        rows = batch if before is None else batch.unionByName(before)
        latest_per_key(rows, key, *[F.col(c) for c in order]).write.mode("overwrite").parquet(f"{table}/v={number:012d}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def versions(spark: SparkSession, table: str, below: int | None = None) -> DataFrame | None:
    """The last version of a table, or the last below a number; None for none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(path))
    names = [n for n in names if n.startswith("v=") and (below is None or int(n[2:]) < below)]
    return spark.read.parquet(f"{table}/{names[-1]}") if names else None


def windowed_counts(stream: DataFrame, late: str | None = "1 hour", width: str = "1 day") -> DataFrame:
    """Events and sum of values by type and window; a window ends when the watermark passes it.

    late is None for a stream that has its watermark.
    """
    marked = stream if late is None else stream.withWatermark("ts", late)
    return marked.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def once(stream: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each id once, as far back as the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


JOB_STATES = ["queued", "running", "completed", "completed_with_failures", "not_configured", "failed"]


def job_status(failures: Column, records: Column, configured: Column, error: Column) -> Column:
    """The last state of a job by its counters."""
    return F.when(~configured, "not_configured").when(error.isNotNull(), "failed").when((failures > 0), "completed_with_failures").otherwise("completed")




def job_states(events: DataFrame) -> DataFrame:
    """(run_id, status, at, ended): the state of each job from its events (run_id, status, at), in a table or a stream (output mode update).

    A job is queued, then runs, then ends: an event that comes late never takes a job back, and of two ends the later one counts.
    Unknown states are no events.  The state kept for a job is one row.
    """
    step = F.array_position(F.array(*[F.lit(s) for s in JOB_STATES]), F.col("status"))
    known = events.withColumn("_step", F.least(step, F.lit(3))).filter("_step > 0")
    last = F.max(F.struct("_step", "at", "status"))
    return known.groupBy("run_id").agg(last.alias("x")).select("run_id", "x.status", "x.at", (F.col("x._step") == 3).alias("ended"))
