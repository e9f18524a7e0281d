"""Queries that compare sources and summarise what they verify."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.score import age_days, is_stale, source_strength
from ..functions.text import emails_in, phones_in
from ..functions.vocabulary import MAX_AGE_DAYS, OUTCOMES, SOURCE_STRENGTH, VERIFICATION_STATES
from ..operators import verify as V
from ..operators.dedupe import _written as written
from ..sources import table

_TYPES = ["official_website_page", "contact_page", "directory_source", "search_source", "other"]


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings of documents' language (claim: the whole text, by its digest), one for each document."""
    docs = table(spark, sf_dir, "documents")
    host = F.concat(F.lit("https://www."), F.col("source"), F.lit(".org/"), F.col("doc_id"))
    kind = F.array(*[F.lit(t) for t in _TYPES])[F.pmod(F.col("doc_id"), F.lit(len(_TYPES))).cast("int")]
    return docs.select(
        F.md5(F.col("text").cast("binary")).alias("claim"), F.lit("text").alias("kind"), F.col("lang").alias("value"), host.alias("source_url"), kind.alias("source_type"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("doc_id"), F.lit(100)).cast("int")), "yyyy-MM-dd").alias("discovered_at"),
        F.array(F.concat(F.lit("https://m."), F.col("source"), F.lit(".org/again"))).alias("also_seen_at"),
    )


def claim_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VER1, VER2, AGG6 and AGG7: the outcome of each claim over its observations."""
    claims = V.evaluate(V.observations(_observed(spark, sf_dir)), ["claim"])
    return claims.select("claim", "outcome", "n_values", "n_observations", F.element_at("values", 1)["value"].alias("first_value"), F.element_at("values", 1)["independent_domains"].alias("first_domains"), F.array_max(F.transform("values", lambda v: v["strength"])).alias("strongest"))


_STRENGTH = "CASE t " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SOURCE_STRENGTH.items()) + " ELSE 0 END"
_OBSERVED = f"""
seen AS (SELECT md5(text) AS claim, lang AS value, source || '.org' AS domain, [{", ".join(f"'{t}'" for t in _TYPES)}][doc_id % 5 + 1] AS t,
    strftime(DATE '2024-01-01' + (doc_id % 100)::INT, '%Y-%m-%d') AS day, 2 AS sightings FROM documents),
per_value AS (SELECT claim, value, count(DISTINCT domain) AS domains, max({_STRENGTH}) AS strength, min(day) AS day, sum(sightings) AS n FROM seen GROUP BY claim, value),
claims AS (SELECT claim, count(*) AS n_values, sum(n)::BIGINT AS n_observations, max(domains) AS most, max(strength) AS strongest,
    arg_min(value, day || value) AS first_value, arg_min(domains, day || value) AS first_domains FROM per_value GROUP BY claim),
outcomes AS (SELECT *, CASE WHEN n_values > 1 THEN 'conflicting' WHEN most >= 2 THEN 'corroborated' ELSE 'single_source' END AS outcome FROM claims)
"""
CLAIM_OUTCOMES = f"WITH {_OBSERVED} SELECT claim, outcome, n_values, n_observations, first_value, first_domains::INT AS first_domains, strongest::INT AS strongest FROM outcomes"


def outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG4: claims by outcome, all four outcomes."""
    return V.outcome_summary(claim_outcomes(spark, sf_dir))


OUTCOME_SUMMARY = f"WITH {_OBSERVED} SELECT v.outcome, count(o.claim) AS n FROM (SELECT unnest({OUTCOMES}) AS outcome) v LEFT JOIN outcomes o USING (outcome) GROUP BY v.outcome"

_NOW = "2024-06-15"


def verification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VER3, VER6, AGG5, SCR16 and STR6: states of claims at a given time; a claim was last verified the earlier the more values and domains it has."""
    now = F.lit(_NOW).cast("timestamp")
    claims = claim_outcomes(spark, sf_dir).withColumn("verified_at", F.date_format(F.date_sub(F.lit("2024-04-16").cast("date"), 10 * F.col("n_values").cast("int") + 10 * F.col("first_domains").cast("int")), "yyyy-MM-dd"))
    results = claims.withColumn("status", V.verification_status(F.col("outcome"), is_stale(F.col("verified_at"), now, MAX_AGE_DAYS)))
    return V.status_summary(results)


VERIFICATION_SUMMARY = f"""
WITH {_OBSERVED},
results AS (SELECT CASE WHEN outcome = 'corroborated' AND DATE '{_NOW}' - (DATE '2024-04-16' - (10 * n_values + 10 * first_domains)::INT) > {MAX_AGE_DAYS} THEN 'stale'
    WHEN outcome = 'corroborated' THEN 'verified' WHEN outcome = 'conflicting' THEN 'conflicting' ELSE 'unverified' END AS status FROM outcomes)
SELECT v.status, count(r.status) AS n FROM (SELECT unnest({VERIFICATION_STATES}) AS status) v LEFT JOIN results r USING (status) GROUP BY v.status
"""


def _contact_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings of addresses and phone numbers in the whole text of documents: the fact is the claim, the document's source the domain."""
    docs = table(spark, sf_dir, "documents")
    found = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    facts = docs.select("doc_id", "source", F.explode(F.concat(found("email", emails_in(F.col("text"))), found("phone", phones_in(F.col("text"))))).alias("f"))
    host = F.concat(F.lit("https://www."), F.col("source"), F.lit(".org/"), F.col("doc_id"))
    kind = F.array(*[F.lit(t) for t in _TYPES])[F.pmod(F.col("doc_id"), F.lit(len(_TYPES))).cast("int")]
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("doc_id"), F.lit(100)).cast("int")), "yyyy-MM-dd")
    return facts.select(F.col("f.value").alias("claim"), F.col("f.kind").alias("kind"), F.col("f.value").alias("value"), host.alias("source_url"), kind.alias("source_type"), day.alias("discovered_at"))


def contact_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VER1, VER2, AGG6 and AGG7 over what the texts say: the outcome of each address and phone number."""
    value = F.element_at("values", 1)
    return V.evaluate(_contact_facts(spark, sf_dir), ["claim"]).select("claim", "kind", "outcome", "n_observations", value["independent_domains"].alias("domains"), value["strength"].alias("strongest"))


def contact_outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG4 over contact_outcomes."""
    return V.outcome_summary(contact_outcomes(spark, sf_dir))


def contact_verification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VER3, VER6, AGG5, SCR16 and STR6: states of addresses and phone numbers at a given time; each was verified when last seen."""
    facts = written(_contact_facts(spark, sf_dir))  # texts are searched once
    last = facts.groupBy("claim", "kind").agg(F.max("discovered_at").alias("verified_at"))
    claims = V.evaluate(facts, ["claim"]).select("claim", "kind", "outcome").join(last, ["claim", "kind"])
    stale = is_stale(F.col("verified_at"), F.lit(_NOW).cast("timestamp"), MAX_AGE_DAYS)
    return V.status_summary(claims.withColumn("status", V.verification_status(F.col("outcome"), stale)))


def user_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG6 over events: each user's event types as values of a claim, the day of the month as source."""
    e = table(spark, sf_dir, "events")
    seen = e.select(F.col("user_id").alias("claim"), F.lit("text").alias("kind"), F.col("event_type").alias("value"), F.concat(F.lit("https://day"), F.dayofmonth("ts"), F.lit(".com")).alias("source_url"), F.lit("contact_page").alias("source_type"), F.date_format("ts", "yyyy-MM-dd").alias("discovered_at"))
    return V.evaluate(seen, ["claim"]).select(F.col("claim").alias("user_id"), "outcome", "n_values", "n_observations", F.array_join(F.transform("values", lambda v: F.concat_ws(":", v["value"], v["independent_domains"])), ",").alias("per_value"))


USER_CLAIMS = """
WITH per_value AS (SELECT user_id, event_type AS value, count(DISTINCT day(ts)) AS domains, count(*) AS n, min(strftime(ts, '%Y-%m-%d')) AS day FROM events GROUP BY ALL)
SELECT user_id, CASE WHEN count(*) > 1 THEN 'conflicting' WHEN max(domains) >= 2 THEN 'corroborated' ELSE 'single_source' END AS outcome,
    count(*) AS n_values, sum(n)::BIGINT AS n_observations, string_agg(value || ':' || domains, ',' ORDER BY day, value) AS per_value FROM per_value GROUP BY user_id
"""


def unsupported_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VER4 and JON13: customers of a market segment (addresses) that no order (fact) of theirs above a price backs."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    contacts = c.select(F.col("c_nationkey").alias("subject"), F.col("c_name").alias("email"), F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("page"))).alias("provenance"))
    facts = o.filter("o_totalprice > 300000").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("subject"), F.col("c_name").alias("value"), F.col("o_orderpriority").alias("source_url"))
    return V.unsupported(contacts, facts).select("subject", "email")


UNSUPPORTED_CONTACTS = """
SELECT c_nationkey AS subject, c_name AS email FROM customer c WHERE c_mktsegment <> 'BUILDING'
AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 300000)
"""


def strength_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR17: mean strength of the types of source that each source's documents carry."""
    return _observed(spark, sf_dir).groupBy("source_type").agg(F.max(source_strength(F.col("source_type"))).alias("strength"), F.count("*").alias("n"))


STRENGTH_BY_SOURCE = f"WITH {_OBSERVED} SELECT t AS source_type, max({_STRENGTH})::INT AS strength, count(*) AS n FROM seen GROUP BY t"


def event_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR16: whole days since each user's last event."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    return last.select("user_id", F.floor(age_days(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("2024-02-15").cast("timestamp"))).alias("days"))


EVENT_AGES = "SELECT user_id, greatest(0, floor((epoch(TIMESTAMP '2024-02-15') - epoch(date_trunc('second', max(ts)))) / 86400))::BIGINT AS days FROM events GROUP BY user_id"

QUERIES = {
    "claim_outcomes": (claim_outcomes, CLAIM_OUTCOMES),
    "outcome_summary": (outcome_summary, OUTCOME_SUMMARY),
    "verification_summary": (verification_summary, VERIFICATION_SUMMARY),
    "contact_outcomes": (contact_outcomes, None),
    "contact_outcome_summary": (contact_outcome_summary, None),
    "contact_verification_summary": (contact_verification_summary, None),
    "user_claims": (user_claims, USER_CLAIMS),
    "unsupported_contacts": (unsupported_contacts, UNSUPPORTED_CONTACTS),
    "strength_by_source": (strength_by_source, STRENGTH_BY_SOURCE),
    "event_ages": (event_ages, EVENT_AGES),
}
