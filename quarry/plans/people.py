"""Queries on people of pages: staff lists, contacts, drafts and submission paths, over texts made of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import html as H
from ..operators import people as O
from ..operators.dedupe import _written as written
from ..sources import dealt, table
from .contacts import _CONTACTS, _FIRST, _LAST, _contacts, _names, _pick, _sql_pick

_NAME_SQL = f"({_sql_pick(_FIRST, 'c_custkey')} || ' ' || {_sql_pick(['Lee', 'Ray', 'Stone', 'Hill'], 'c_custkey')})"


def _staff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with four people: by line, by role before and after the name, with and without an address.

    Keys are few bytes and pages are long to read, so keys are dealt to as many tasks as a shuffle has before texts are made of them.
    """
    k = F.col("c_custkey")
    name = F.concat_ws(" ", _pick(_FIRST, "c_custkey"), _pick(["Lee", "Ray", "Stone", "Hill"], "c_custkey"))
    text = F.concat(
        F.lit("Our station\n\n"), name, F.lit(" - Music Director\nm"), k, F.lit("@x.org (203) 555-0"), F.lpad(k % 1000, 3, "0"), F.lit("\n\nZed Young\nAccountant\n\n"),
        F.lit("Kim Moss\nsome words\nk"), k, F.lit("@x.org\n\nProgram Director\nTom Oak\n\nHost: Una Pine\nUna Pine, DJ\n\n"), F.when(k % 2 == 0, "Ivy Ash\nStation Manager\n").otherwise("Ivy Ash\n\nStation Manager\n"),
    )
    return dealt(table(spark, sf_dir, "customer").select(k), "c_custkey").select(k, F.when(k % 3 > 0, "https://x.org/staff").otherwise("https://x.org/email.php?id=1").alias("url"), F.lit("Page").alias("title"), text.alias("text"), F.array(F.lit("z@x.org?subject=a"), F.concat(F.lit("M"), k, F.lit("@x.org"))).alias("mailtos"))


def staff_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT23: people of staff pages with role, address and number."""
    return O.staff_entries(_staff(spark, sf_dir), "c_custkey").select("c_custkey", "name", "role", "email", "phone", "percent")


STAFF_ENTRIES = f"""
SELECT c_custkey, {_NAME_SQL} AS name, 'music_director' AS role, 'm' || c_custkey || '@x.org' AS email, '(203) 555-0' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS phone, 55 AS percent FROM customer
UNION ALL SELECT c_custkey, 'Kim Moss', 'unknown', 'k' || c_custkey || '@x.org', NULL, 55 FROM customer UNION ALL SELECT c_custkey, 'Tom Oak', 'program_director', NULL, NULL, 30 FROM customer
UNION ALL SELECT c_custkey, 'Una Pine', 'host', NULL, NULL, 30 FROM customer UNION ALL SELECT c_custkey, 'Ivy Ash', 'station_manager', NULL, NULL, 30 FROM customer WHERE c_custkey % 2 = 0
"""


def page_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT14: contacts of pages from staff lists, texts and links."""
    return O.page_contacts(_staff(spark, sf_dir), "c_custkey").select("c_custkey", "contact", "name", "role", "email", "percent")


PAGE_CONTACTS = f"""
WITH c AS (SELECT c_custkey, c_custkey % 3 > 0 AS listed, {_NAME_SQL} AS n FROM customer)
SELECT c_custkey, 'm' || c_custkey || '@x.org' AS contact, n AS name, 'music_director' AS role, 'm' || c_custkey || '@x.org' AS email, 30 AS percent FROM c
UNION ALL SELECT c_custkey, 'k' || c_custkey || '@x.org', NULL, 'program_director', 'k' || c_custkey || '@x.org', 30 FROM c UNION ALL SELECT c_custkey, 'z@x.org', NULL, 'music_director', 'z@x.org', 25 FROM c
UNION ALL SELECT c_custkey, 'name:tom oak', 'Tom Oak', 'program_director', NULL, 30 FROM c WHERE listed UNION ALL SELECT c_custkey, 'name:una pine', 'Una Pine', 'host', NULL, 30 FROM c WHERE listed
UNION ALL SELECT c_custkey, 'name:ivy ash', 'Ivy Ash', 'station_manager', NULL, 30 FROM c WHERE listed AND c_custkey % 2 = 0
"""


def crawled_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT14 over the crawled pages (no SQL: parsing HTML has none); pages are parsed once and written, and what is read of them reads that."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", H.parse_page(F.col("url"), F.col("html")).alias("p"))
    return O.page_contacts(written(p.select("page_id", "url", "p.title", "p.text", "p.mailtos")), "page_id")


def contact_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN13: contacts of each station in the order in which a reader sees them."""
    df = _contacts(spark, sf_dir).withColumn("preferred", F.col("o_orderkey") % 6 == 0)
    return O.ranked_contacts(df, "station", "o_orderkey").select("o_orderkey", "station", F.col("place").cast("long").alias("place"))


CONTACT_PLACES = f"""
WITH {_CONTACTS} SELECT o_orderkey, station, row_number() OVER (PARTITION BY station ORDER BY coalesce(list_position({[*O.DECISION_ROLES, *O.MORE_ROLES]}, role), 99), o_orderkey % 6 = 0 DESC, email IS NOT NULL DESC, confidence DESC, o_orderkey) AS place FROM contacts
"""


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT30: drafts of messages to customers about parts."""
    k = F.col("c_custkey")
    recipient = F.struct(F.when(k % 2 > 0, _names("c_custkey", "c_custkey")).alias("name"), F.when(k % 3 > 0, "music_director").alias("role"), F.when(k % 5 > 0, F.col("c_name")).alias("organization"))
    track = F.struct(F.when(k % 7 > 0, F.concat(F.lit("T"), k)).otherwise(" ").alias("title"), F.when(k % 11 > 0, F.concat(F.lit("https://x.org/"), k)).alias("listen_url"), F.when(k % 13 > 0, F.repeat(F.lit("ab"), (k % 200).cast("int"))).alias("description"))
    return table(spark, sf_dir, "customer").select(k, O.draft(recipient, track, F.struct(F.when(k % 4 > 0, "Ann Lee").alias("name"))).alias("d")).select("c_custkey", "d.*")


DRAFTS = f"""
WITH c AS (SELECT c_custkey, c_custkey AS k, CASE WHEN c_custkey % 2 > 0 THEN {_sql_pick(_FIRST, "c_custkey")} || ' ' || {_sql_pick(_LAST, "c_custkey")} END AS name, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS org,
    CASE WHEN c_custkey % 7 > 0 THEN '"T' || c_custkey || '"' END AS t, CASE WHEN c_custkey % 4 > 0 THEN 'Ann Lee' END AS artist, CASE WHEN c_custkey % 13 > 0 AND c_custkey % 200 > 0 THEN repeat('ab', (c_custkey % 200)::INT) END AS d FROM customer),
g AS (SELECT *, 'Hello' || coalesce(' ' || name, '') || ',' AS greeting FROM c)
SELECT c_custkey, greeting, coalesce(artist || ' — ' || t, t, artist, 'New music submission') || coalesce(' for ' || org, '') AS subject,
    concat_ws(chr(10) || chr(10), greeting, CASE WHEN org IS NULL THEN 'I''m writing to share a piece of music with the hope it fits what you feature.' ELSE 'I''m writing to the ' || CASE WHEN k % 3 > 0 THEN 'music director' ELSE 'music team' END || ' at ' || org || ' to share a piece of music with the hope it fits what you feature.' END,
    'I''d love for you to hear ' || coalesce('the track ' || t, artist || '''s music', 'a new track') || ' and consider it for airplay.', CASE WHEN k % 11 > 0 THEN 'You can listen here:' || chr(10) || 'https://x.org/' || k END,
    CASE WHEN len(d) > 260 THEN d[:260] || '…' ELSE d END, 'Thank you for your time and for all you do for music.', 'Warm regards,' || chr(10) || artist) AS message FROM g
"""


def submission_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS16 and WIN9: what is known of the way to submit, how sure it is, and the page promoted where nothing else is known."""
    k = F.col("c_custkey")
    methods = F.when(k % 5 == 0, F.array(F.lit("email"), F.lit("web_form"))).when(k % 5 == 1, F.array().cast("array<string>"))
    df = table(spark, sf_dir, "customer").select(
        k, F.when(k % 2 == 0, F.concat(F.lit("u"), k)).alias("submission_url"), F.when(k % 3 == 0, "m@x.org").alias("submission_email"), F.when(k % 7 == 0, "send").alias("instructions"), methods.alias("methods"),
        F.when(k % 11 == 0, F.array(F.lit("no_attachments"))).alias("restrictions"), (k % 13 == 0).alias("music_contact"), F.when(k % 4 > 0, F.concat(F.lit("p"), k)).alias("send_page"),
    )
    return O.submission_path(df).select("c_custkey", "submission_url", F.col("percent").alias("percent"), F.array_join("reasons", "; ").alias("reasons"))


SUBMISSION_PATHS = """
WITH c AS (SELECT c_custkey, c_custkey AS k, c_custkey % 2 > 0 AND c_custkey % 3 > 0 AND c_custkey % 7 > 0 AND c_custkey % 13 > 0 AS bare FROM customer)
SELECT c_custkey, CASE WHEN k % 2 = 0 THEN 'u' || k WHEN bare THEN 'p' || k END AS submission_url,
    least(95, CASE WHEN k % 2 = 0 OR bare THEN 35 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 30 ELSE 0 END + CASE WHEN k % 7 = 0 THEN 15 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 10 ELSE 0 END + CASE WHEN k % 11 = 0 THEN 5 ELSE 0 END)::INT AS percent,
    concat_ws('; ', CASE WHEN k % 2 = 0 THEN 'dedicated submission URL discovered' END, CASE WHEN k % 3 = 0 THEN 'submission email supported by page evidence' END, CASE WHEN k % 7 = 0 THEN 'explicit submission instructions captured' END,
    CASE WHEN k % 5 = 0 THEN 'submission method(s) inferred (email, web_form)' END, CASE WHEN k % 11 = 0 THEN 'submission restrictions documented' END, CASE WHEN bare THEN 'published send-music page identified' END) AS reasons FROM c
"""

QUERIES = {
    "staff_entries": (staff_entries, STAFF_ENTRIES), "page_contacts": (page_contacts, PAGE_CONTACTS), "crawled_contacts": (crawled_contacts, None), "contact_places": (contact_places, CONTACT_PLACES), "drafts": (drafts, DRAFTS),
    "submission_paths": (submission_paths, SUBMISSION_PATHS),
}
