"""Tables between the jobs of an operator, in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset and the master is local, as in tests, a folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own.setdefault("dir", tempfile.mkdtemp(prefix="quarry-"))
    return f"{base.rstrip('/')}/quarry-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def spool(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later jobs neither recompute it nor lose it with an executor."""
    path = fresh_path(df.sparkSession, name)
    schema = df.schema
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out.spool_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes spooled tables that no later job reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.spool_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def release(spark: SparkSession) -> None:
    """Drops this process's references to finished DataFrames, so that Spark's cleaner may remove their shuffle files."""
    gc.collect()
