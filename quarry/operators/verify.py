"""Comparison of independent sources: observations, outcome of each claim, verification states and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.score import source_strength
from ..functions.text import claim_value
from ..functions.url import registrable_domain
from ..functions.vocabulary import OUTCOMES, VERIFICATION_STATES


def observations(facts: DataFrame) -> DataFrame:
    """One row for the first sighting and one for each later one of facts (subject, claim, kind, value, source_url, also_seen_at, ...)."""
    seen = F.concat(F.array("source_url"), F.coalesce("also_seen_at", F.array().cast("array<string>")))
    return facts.withColumn("source_url", F.explode(seen)).drop("also_seen_at")


def evaluate(seen: DataFrame, by: list[str]) -> DataFrame:
    """The outcome of each claim from observations (by..., kind, value, source_url, source_type, discovered_at).

    Values are compared in normal form and the unit of independence is the registrable domain.  More than one value
    conflicts; one value of two domains is corroborated.  The grouping by value comes first, so both steps pre-aggregate.
    """
    seen = seen.withColumns({"original": F.col("value"), "value": claim_value(F.col("kind"), F.col("value")), "domain": F.nullif(registrable_domain(F.col("source_url")), F.lit(""))})
    seen = seen.filter("value is not null").withColumn("strength", source_strength(F.col("source_type")))
    found = F.coalesce("discovered_at", F.lit(""))
    values = seen.groupBy(*by, "kind", "value").agg(
        F.collect_set("domain").alias("domains"),
        F.array_sort(F.collect_set(F.nullif("source_type", F.lit("")))).alias("source_types"),
        F.coalesce(F.min(F.nullif("discovered_at", F.lit(""))), F.lit("")).alias("first_discovered_at"),
        F.max(F.struct("strength", found.alias("at"), "source_url", "original")).alias("strongest"),
        F.count("*").alias("n"),
    )
    row = F.struct(F.coalesce(F.nullif("first_discovered_at", F.lit("")), F.lit("9999")).alias("at"), "value", F.size("domains").alias("independent_domains"), F.col("strongest.strength").alias("strength"), "source_types", "n")
    claims = values.groupBy(*by, "kind").agg(F.array_sort(F.collect_list(row)).alias("values"), F.count("*").alias("n_values"), F.max(F.size("domains")).alias("_domains"), F.sum("n").alias("n_observations"))
    return claims.withColumn("outcome", outcome(F.col("n_values"), F.col("_domains"))).drop("_domains")


def outcome(values: Column, domains: Column) -> Column:
    return F.when(values > 1, "conflicting").when((values == 1) & (domains >= 2), "corroborated").when(values == 1, "single_source").otherwise("unobserved")


def verification_status(of: Column, stale: Column) -> Column:
    """The state of a claim by its outcome; a corroborated one of a stale subject is stale."""
    return F.when((of == "corroborated") & stale, "stale").when(of == "corroborated", "verified").when(of == "conflicting", "conflicting").otherwise("unverified")


def zero_filled(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """(column, n) with a row for every name of the vocabulary."""
    every = rows.sparkSession.createDataFrame([(n,) for n in names], f"{column} string")
    return every.join(rows.groupBy(column).count(), column, "left").select(column, F.coalesce("count", F.lit(0)).alias("n"))


def outcome_summary(claims: DataFrame) -> DataFrame:
    return zero_filled(claims, "outcome", OUTCOMES)


def status_summary(results: DataFrame) -> DataFrame:
    return zero_filled(results, "status", VERIFICATION_STATES)


def unsupported(contacts: DataFrame, facts: DataFrame) -> DataFrame:
    """Contacts (subject, email, provenance) with an address that neither they nor a fact (subject, value, source_url) can source."""
    bare = contacts.filter((F.coalesce("email", F.lit("")) != "") & (F.size(F.coalesce("provenance", F.array())) == 0))
    backed = facts.filter(F.coalesce("source_url", F.lit("")) != "").select("subject", F.col("value").alias("email")).distinct()
    return bare.join(backed, ["subject", "email"], "left_anti")


def history_tail(history: Column, most: int = 20) -> Column:
    """The last entries of an array."""
    return F.slice(history, F.greatest(F.size(history) - most + 1, F.lit(1)), most)
