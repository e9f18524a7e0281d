"""Queries on the text of documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.votes import votes
from ..functions.vocabulary import FORMATS, FREE_PROVIDERS, GENRES, RESTRICTIONS, ROLE_INBOXES, ROLE_RULES, STATION_TYPES
from ..sources import table


def document_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT1, TXT4 and TXT6: addresses in documents with their quality."""
    df = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.emails_in(F.col("text"))).alias("place", "email"))
    q = T.email_quality(F.col("email"), F.array(F.lit("example.com")))
    return df.select("doc_id", "place", "email", q["tier"].alias("tier"), q["inbox_kind"].alias("inbox_kind"), F.array_join(q["signals"], ",").alias("signals"))


def _quoted(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_BAD = r"^\.|\.$|\.\."
DOCUMENT_EMAILS = rf"""
WITH raw AS (SELECT doc_id, regexp_extract_all(text, '{_EMAIL}') AS xs FROM documents),
one AS (SELECT doc_id, unnest(range(1, len(xs) + 1)) AS i, unnest(xs) AS x FROM raw),
clean AS (SELECT doc_id, i, rtrim(lower(x), '.') AS email FROM one),
valid AS (SELECT doc_id, i, email, string_split(email, '@')[1] AS local, string_split(email, '@')[2] AS domain FROM clean
    WHERE regexp_full_match(email, '{_EMAIL}') AND NOT regexp_matches(string_split(email, '@')[1], '{_BAD}') AND NOT regexp_matches(string_split(email, '@')[2], '{_BAD}')),
firsts AS (SELECT doc_id, email, local, domain, min(i) AS i FROM valid GROUP BY ALL),
flags AS (SELECT *, domain = 'example.com' OR ends_with(domain, '.example.com') AS own, domain IN ({_quoted(FREE_PROVIDERS)}) AS free,
    local IN ({_quoted(ROLE_INBOXES)}) OR rtrim(local, '0123456789') IN ({_quoted(ROLE_INBOXES)}) AS role FROM firsts)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS place, email,
    CASE WHEN own AND role THEN 'professional' WHEN own OR role THEN 'generic' WHEN free THEN 'weak' ELSE 'unclassified' END AS tier,
    CASE WHEN role THEN 'role_based' ELSE 'personal_or_other' END AS inbox_kind,
    'valid_format,' || CASE WHEN own THEN 'own_domain' ELSE 'domain_mismatch' END || CASE WHEN free AND NOT own THEN ',free_provider' ELSE '' END
        || CASE WHEN role THEN ',role_inbox' ELSE '' END AS signals
FROM flags
"""


def document_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT7 and TXT8."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.phones_in(F.col("text"))).alias("phone"))


DOCUMENT_PHONES = r"""
WITH found AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:\+?1[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]\d{3}[\s.-]\d{4}')) AS x FROM documents),
digits AS (SELECT doc_id, regexp_replace(regexp_replace(x, '\D', '', 'g'), '^1(\d{10})$', '\1') AS d FROM found)
SELECT DISTINCT doc_id, '(' || d[1:3] || ') ' || d[4:6] || '-' || d[7:10] AS phone FROM digits WHERE len(d) = 10 AND d[1] NOT IN ('0', '1')
"""


def document_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT10 and TXT19: role words and restrictions in documents."""
    df = table(spark, sf_dir, "documents")
    return df.select("doc_id", T.role_of(F.col("text")).alias("role"), F.array_join(F.transform(T.restrictions_in(F.col("text")), lambda s: s["restriction"]), ",").alias("restrictions"))


_ROLES = " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{r}'" for p, r in ROLE_RULES)
_RESTRICTED = ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{n}' END" for n, p in RESTRICTIONS)
DOCUMENT_ROLES = f"SELECT doc_id, CASE {_ROLES} ELSE 'unknown' END AS role, concat_ws(',', {_RESTRICTED}) AS restrictions FROM documents"


def document_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15, AGG16, TXT15 and TXT16: votes on genres, formats and station type by counted words, with confidence and evidence."""
    df = table(spark, sf_dir, "documents").select("doc_id", votes(F.col("text")).alias("v"))
    names = lambda c: F.array_join(f"v.{c}.name", ",")
    words = F.array_join(F.transform("v.genres", lambda g: F.concat(g["name"], F.lit(":"), F.array_join(g["evidence"], "|"))), ",")
    return df.select("doc_id", names("genres").alias("genres"), names("formats").alias("formats"), words.alias("genre_words"), "v.station_type", "v.confidence", F.array_join("v.evidence", ",").alias("evidence"))


def _hits(words: list[str]) -> str:
    return " + ".join("least(3, len(regexp_extract_all(t, '{}')))".format(re.escape(w).replace(r"\ ", " ").replace("'", "''")) for w in words)


def _said(words: list[str]) -> str:
    """The words found, each as often as it counts."""
    return "flatten([" + ", ".join("[{0} for i in range(least(3, len(regexp_extract_all(t, {1}))))]".format("'" + w.replace("'", "''") + "'", "'" + re.escape(w).replace(r"\ ", " ").replace("'", "''") + "'") for w in words) + "])"


def _votes(vocabulary: list[tuple[str, list[str]]], by_name: bool) -> str:
    return "[" + ", ".join(f"{{'h': -({_hits(ws)}), 'tie': {repr(n) if by_name else k}, 'name': '{n}', 'said': {_said(ws)}}}" for k, (n, ws) in enumerate(vocabulary)) + "]"


DOCUMENT_VOTES = f"""
WITH low AS (SELECT doc_id, lower(text) AS t FROM documents),
votes AS (SELECT doc_id, list_sort(list_filter({_votes(GENRES, True)}, lambda s: s.h < 0)) AS g, list_sort(list_filter({_votes(FORMATS, True)}, lambda s: s.h < 0)) AS f,
    list_sort(list_filter({_votes(STATION_TYPES, False)}, lambda s: s.h < 0)) AS y FROM low)
SELECT doc_id, array_to_string([s.name for s in g[1:8]], ',') AS genres, array_to_string([s.name for s in f[1:4]], ',') AS formats, array_to_string([s.name || ':' || array_to_string(list_sort(list_distinct(s.said)), '|') for s in g[1:8]], ',') AS genre_words,
    coalesce(y[1].name, 'unknown') AS station_type, CASE WHEN len(y) = 0 THEN 0.1::DOUBLE ELSE round(least(0.4::DOUBLE + 0.15::DOUBLE * -y[1].h, 0.9::DOUBLE), 2) END AS confidence, coalesce(array_to_string(y[1].said[1:10], ','), '') AS evidence FROM votes
"""

QUERIES = {
    "document_emails": (document_emails, DOCUMENT_EMAILS),
    "document_phones": (document_phones, DOCUMENT_PHONES),
    "document_roles": (document_roles, DOCUMENT_ROLES),
    "document_votes": (document_votes, DOCUMENT_VOTES),
}
