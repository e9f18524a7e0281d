"""Readers: Parquet tables by name, and record files of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = "name string, url string, website string, snippet string, country string, state_or_region string, city string, source_type string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows by a hash of the key, in as many partitions as the session's shuffles have: for small rows that are long to work on."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism), key)


def records(spark: SparkSession, path: str, schema: str, fields: tuple[str, ...] = ("records", "stations", "djs"), placed: bool = False) -> DataFrame:
    """Records of JSON files that are a list, or an object with the list under one of the fields.

    placed: with `_file` and `_place`, by which the records of a file are in its order.  A file is read by one task.
    """
    wrapped = ", ".join(f"{f}: array<struct<{schema}>>" for f in fields)
    flat = spark.read.option("multiLine", True).schema(f"{schema}, {wrapped.replace(': array', ' array')}").json(path)
    inner = F.coalesce(*[F.col(f) for f in fields])
    names = [c.strip().split()[0] for c in schema.split(",")]
    each = F.coalesce(inner, F.array(F.struct(*names)))
    if not placed:
        return flat.select(F.explode(each).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in names])
    rows = flat.select(F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_row"), F.posexplode(each).alias("_at", "r"))
    return rows.select(*[F.col(f"r.{c}").alias(c) for c in names], "_file", F.struct("_row", "_at").alias("_place"))


def candidates(rows: DataFrame, country: str | None = None, state: str | None = None, city: str | None = None, limit: int | None = None) -> DataFrame:
    """Seeds with an address that fit the place asked for; a place that is unknown fits.

    A limit takes the first of placed records, file by file in order of name; of rows without places it takes any.
    """
    from ..operators.listing import same_place

    found = rows.withColumn("url", F.coalesce(F.nullif("url", F.lit("")), "website")).filter(F.coalesce("url", F.lit("")) != "")
    for column, wanted in (("country", country), ("state_or_region", state), ("city", city)):
        found = found.filter(same_place(F.col(column), wanted))
    if limit is not None:
        found = (found.orderBy("_file", "_place") if "_place" in rows.columns else found).limit(limit)
    return found.drop("_file", "_place")
