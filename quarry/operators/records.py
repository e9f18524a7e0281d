"""Records on their way into the store: validation, normal form, merge, verification written back, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.url import registrable_domain

# fixed values: fields that may be unknown
OPTIONAL_FIELDS = ["website", "domain", "country", "state_or_region", "city", "market_area", "language", "description", "last_verified_at"]


def normal_record(rows: DataFrame) -> DataFrame:
    """rows with domain from the website where it has none, the default type of organization, empty lists for none and scores of two digits."""
    domain = F.coalesce("domain", F.nullif(registrable_domain(F.coalesce("website", F.lit(""))), F.lit("")))
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("source_urls",) if c in rows.columns}
    scores = {c: F.bround(c, 2) for c in ("confidence_score", "classification_confidence") if c in rows.columns}
    return rows.withColumns({"domain": domain, "organization_type": F.coalesce("organization_type", F.lit("radio_station")), **lists, **scores})


def unknown_fields(emails: Column, contacts: Column, has_submission: Column, submission_email: Column) -> Column:
    """Names of what is not known of a station, in order; a known city or market makes country and region no gap."""
    local = (F.coalesce("city", F.lit("")) != "") | (F.coalesce("market_area", F.lit("")) != "")
    gaps = [F.when(F.col(c).isNull() & (~local if c in ("country", "state_or_region") else F.lit(True)), F.lit(c)) for c in OPTIONAL_FIELDS]
    gaps.append(F.when(F.coalesce("station_type", F.lit("unknown")).isin("", "unknown"), F.lit("station_type")))
    gaps += [F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(name)) for n, name in ((emails, "emails"), (contacts, "contacts"))]
    gaps += [F.when(~has_submission, F.lit("submission")), F.when(has_submission & submission_email.isNull(), F.lit("submission.submission_email"))]
    return F.array_sort(F.array_compact(F.array(*gaps)))


def fixture_station(key: Column, domain: Column, website: Column) -> Column:
    """A station without a host, or with one that is reserved for tests."""
    host = F.lower(F.coalesce(F.nullif(domain, F.lit("")), F.nullif(website, F.lit(""))))
    return key.startswith("namegeo:") | F.coalesce(host.rlike(r"\.(example|test|invalid|localhost|local)$"), F.lit(True))


def names_reserved(text: Column) -> Column:
    """A suffix reserved for tests stands anywhere in the text."""
    return F.lower(F.coalesce(text.cast("string"), F.lit(""))).rlike(r"\.(example|test|invalid|localhost|local)")


def fixture_outreach(urls: list[Column], body: Column, recipient: Column, organization: Column) -> Column:
    """A message to a reserved host, with the marks of a test in it, or to a test recipient."""
    text = F.lower(body)
    out = (text.contains(" e2e ") & text.contains("test")) | F.lower(F.coalesce(recipient, F.lit(""))).startswith("test-dj-") | F.lower(F.coalesce(organization, F.lit(""))).startswith("test-dj-")
    for u in urls:
        out = out | names_reserved(u)
    return out


def reject_known(incoming: DataFrame, rejected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """incoming (id, source_urls, ...) without the rows that name a source of a rejected record (source_urls), and those rows."""
    bad = rejected.select(F.explode("source_urls").alias("url")).distinct()
    ids = incoming.select("id", F.explode("source_urls").alias("url")).join(bad, "url", "left_semi").select("id").distinct()
    return incoming.join(ids, "id", "left_anti"), incoming.join(ids, "id", "left_semi")


def ingest(stored: DataFrame, incoming: DataFrame, key: str, valid: Column, order: str) -> tuple[DataFrame, DataFrame]:
    """(rows with `state` created, merged, duplicate or failed; one row of counts) of an incoming batch against the stored keys.

    Of valid rows with one key the first in order is the record and the others are duplicates of it.
    """
    first = incoming.filter(valid).groupBy(key).agg(F.min(order).alias("_first"))
    known = stored.select(key).distinct().withColumn("_known", F.lit(True))
    df = incoming.withColumn("_ok", F.coalesce(valid, F.lit(False))).join(first, key, "left").join(known, key, "left")
    state = F.when(~F.col("_ok"), "failed").when(F.col(order) != F.col("_first"), "duplicate").when(F.col("_known"), "merged").otherwise("created")
    rows = df.withColumn("state", state).drop("_ok", "_first", "_known")
    return rows, rows.agg(F.count("*").alias("candidates"), *[F.count_if(F.col("state") == s).alias(s) for s in ("created", "merged", "duplicate", "failed")])


def replace_rows(stored: DataFrame, incoming: DataFrame, key: str, kept: str, order: str) -> DataFrame:
    """The last row of each key of both, with the first `kept` time of that key."""
    both = stored.unionByName(incoming)
    rest = [c for c in stored.columns if c not in (key, kept)]
    out = both.groupBy(key).agg(F.min(kept).alias(kept), F.max_by(F.struct(*rest), F.col(order)).alias("x"))
    return out.select(key, kept, *[F.col(f"x.{c}").alias(c) for c in rest])


def verified(records: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """records (record, last_verified_at, ...) with counts of their results (record, status); a verified claim moves last_verified_at to `at`.

    Records without results are left as they are, with counts of 0.
    """
    states = ["verified", "conflicting", "stale", "unverified", "unsupported"]
    counts = results.groupBy("record").agg(F.count("*").alias("claims_checked"), *[F.count_if(F.col("status") == s).alias(s) for s in states])
    df = records.join(counts, "record", "left")
    df = df.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("claims_checked", *states)})
    return df.withColumn("last_verified_at", F.when(F.col("verified") > 0, at).otherwise(F.col("last_verified_at")))


def persist_results(records: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results of known records, and one row with how many were stored and how many skipped."""
    known = records.select("record").distinct().withColumn("_known", F.lit(True))
    df = results.join(known, "record", "left")
    counts = df.agg(F.count_if(F.col("_known")).alias("stored"), F.count_if(F.col("_known").isNull()).alias("skipped"))
    return df.filter("_known").drop("_known"), counts


def conflict_reason(values: Column) -> Column:
    """From an array of (value, strength): both sides of a conflict, the strongest first."""
    ordered = F.array_sort(F.transform(values, lambda v: F.struct((-v["strength"]).alias("s"), v["value"].alias("value"))))
    return F.concat(F.lit("sources disagree; both sides preserved: "), F.array_join(F.transform(ordered, lambda v: F.concat(F.lit("'"), v["value"], F.lit("' (evidence strength "), -v["s"], F.lit(")"))), "; "))


def fetch_targets(pages: list[Column], website: Column, source_urls: Column) -> Column:
    """Distinct http(s) addresses worth reading again: dedicated pages, then the website, then earlier sources."""
    urls = F.concat(F.array(*pages, website), F.coalesce(source_urls, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(urls, lambda u: F.coalesce(u.rlike("^https?://"), F.lit(False))))


def fetched(pages: DataFrame, fetches: DataFrame) -> DataFrame:
    """pages (url, ...) with ok of the first of fetches (url, ok, ord) of the same address, slashes at the end aside."""
    bare = F.regexp_replace("url", "/+$", "")
    first = fetches.groupBy(bare.alias("_bare")).agg(F.min_by("ok", "ord").alias("ok"))
    return pages.withColumn("_bare", bare).join(first, "_bare", "left").drop("_bare")
