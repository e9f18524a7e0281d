"""Performers on their way into the store: checks of payloads, classes from their own addresses, and the gate after a fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classify import performer_candidate
from .views import CHANNEL_CLASSES

NO_EVIDENCE = "no deterministic non-DJ signature and no stored positive DJ evidence — human review required before any use; never promoted automatically"  # fixed value


def clean_list(items: Column) -> Column:
    """Trimmed values that are not empty, each once, in order."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))


def payload_rules(name: Column, source_urls: Column, channels: Column) -> dict[str, Column]:
    """Rules of a payload for split_valid; channels: array of (channel, value, source_url), NULL for none."""
    has = lambda x, field: F.coalesce(F.trim(x[field]) != "", F.lit(False))
    web = lambda x: F.coalesce(F.trim(x).rlike("^https?://"), F.lit(False))
    every = lambda xs, test: F.coalesce(F.forall(xs, test), F.lit(True))
    pairs = F.transform(channels, lambda c: F.struct(F.trim(c["channel"]).alias("c"), F.trim(c["value"]).alias("v")))
    return {
        "name": F.trim(name) != "",
        "source_urls": every(clean_list(source_urls), web),
        "channel": every(channels, lambda c: F.coalesce(F.trim(c["channel"]).isin(list(CHANNEL_CLASSES)), F.lit(False))),
        "value": every(channels, lambda c: has(c, "value")),
        "channel_source": every(channels, lambda c: web(c["source_url"])),
        "duplicate": F.coalesce(F.size(F.array_distinct(pairs)) == F.size(pairs), F.lit(True)),
    }


def planned_class(rows: DataFrame) -> DataFrame:
    """rows (name, source_urls, verdict, ...) whose stored verdict is another than their own addresses give, with target (verdict, reason, evidence_url).

    The first address that rejects decides; without one a person has to look.  Rows with the target's verdict are done.
    """
    judged = F.transform("source_urls", lambda u: F.struct(u.alias("url"), performer_candidate(u, F.col("name"), F.lit(""), F.lit(None).cast("string")).alias("v")))
    bad = F.get(F.filter(judged, lambda x: x["v"]["verdict"] == "rejected"), F.lit(0))
    rejected = F.struct(F.lit("rejected").alias("verdict"), bad["v"]["reason"].alias("reason"), bad["url"].alias("evidence_url"))
    unknown = F.struct(F.lit("needs_verification").alias("verdict"), F.lit(NO_EVIDENCE).alias("reason"), F.coalesce(F.get("source_urls", F.lit(0)), F.lit("")).alias("evidence_url"))
    df = rows.withColumn("target", F.when(bad.isNotNull(), rejected).otherwise(unknown))
    return df.filter(~F.col("target.verdict").eqNullSafe(F.col("verdict")))


def apply_classes(rows: DataFrame, planned: DataFrame, key: str, run: str) -> DataFrame:
    """rows with the planned verdicts, the one before and the run that changed it (`cleanup`: run, before)."""
    df = rows.join(planned.select(key, F.col("target.verdict").alias("_new")), key, "left")
    mark = F.when(F.col("_new").isNotNull(), F.struct(F.lit(run).alias("run"), F.col("verdict").alias("before")))
    return df.withColumn("cleanup", mark).withColumn("verdict", F.coalesce("_new", "verdict")).drop("_new")


def reverse_classes(rows: DataFrame, run: str) -> DataFrame:
    """rows without what the run changed; changes of other runs stay."""
    ours = F.coalesce(F.col("cleanup.run") == run, F.lit(False))
    return rows.withColumn("verdict", F.when(ours, F.col("cleanup.before")).otherwise(F.col("verdict"))).withColumn("cleanup", F.when(~ours, F.col("cleanup")))


def gate(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates (url, title, snippet, page_title, fetched) that qualify, and the others with their fault.

    A page that could not be fetched is judged by what its result says; a fetched one by its own title.
    """
    v = performer_candidate(F.col("url"), F.col("title"), F.col("snippet"), F.when(F.col("fetched"), F.col("page_title")))
    df = candidates.withColumn("_v", v)
    fault = F.when(F.col("_v.verdict") == "rejected", "not_a_dj").when(F.col("_v.verdict") == "needs_review", "needs_human_review")
    df = df.withColumn("fault", fault).withColumn("kind", F.col("_v.kind")).drop("_v")
    return df.filter("fault is null").drop("fault"), df.filter("fault is not null").drop("kind")
