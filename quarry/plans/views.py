"""Queries on views of stored rows: details, channels, pages, recipients, queues, classes of performers, JSON in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import people
from ..functions import url as U
from ..functions.vocabulary import LINK_WEIGHTS
from ..operators import merge as M
from ..operators import performers as P
from ..operators import views as V
from ..operators.classify import classification_status, location_status
from ..sources import table
from ..streaming.ledger import JOB_STATES, job_states
from .contacts import _pick, _sql_pick
from .records import _STATIONS, _stations
from .urls import _DOMAIN, _HOST


def station_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ2, PRJ3 and CLS4: stations with their place, states and links."""
    df = V.station_detail(_stations(spark, sf_dir), F.col("description").isNotNull())
    return df.select("c_custkey", "name", F.to_json("location").alias("location"), "research_status", F.col("links.self").alias("self"), F.col("links.contacts").alias("contacts"))


STATION_DETAILS = f"""
WITH {_STATIONS} SELECT c_custkey, name, '{{' || concat_ws(',', '"city":"' || city || '"', '"country":"' || country || '"', '"status":"' || CASE WHEN country IS NULL AND city IS NULL THEN 'unavailable' ELSE 'unverified' END || '"') || '}}' AS location,
    CASE WHEN described AND c_acctbal >= 7000 THEN 'verified' WHEN described THEN 'partially_researched' ELSE 'needs_research' END AS research_status,
    '/api/v1/stations/' || identity_key AS self, '/api/v1/stations/' || identity_key || '/contacts' AS contacts FROM stations
"""
_CHANNELS = [*V.CHANNEL_CLASSES, "fax"]


def _sql_map(column: str, names: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v if isinstance(v, int) else repr(v)}" for k, v in names.items()) + f" ELSE {default} END"


def channel_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ5: what the channel of each order is good for."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", _pick(_CHANNELS, "o_orderkey").alias("channel"))
    return o.select("o_orderkey", "channel", V.channel_view(F.col("channel")).alias("v")).select("o_orderkey", "channel", "v.*")


CHANNEL_VIEWS = f"""
WITH o AS (SELECT o_orderkey, {_sql_pick(_CHANNELS, "o_orderkey")} AS channel FROM orders)
SELECT *, {_sql_map("channel", V.CHANNEL_KINDS, "'website'")} AS kind, {_sql_map("channel", V.CHANNEL_CLASSES, "'other'")} AS route_class, {_sql_map("channel", V.CHANNEL_LABELS, "channel")} AS route_label FROM o
"""
_VERDICTS = ["qualified", "rejected", "needs_review"]


def performer_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ4: performers with states and what their channels offer."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dj"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey").cast("string")).alias("country"), _pick(_VERDICTS, "c_custkey").alias("verdict"))
    channels = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dj"), _pick(_CHANNELS, "o_orderkey").alias("channel"), F.col("o_orderkey").alias("value"))
    none = F.lit(None).cast("string")
    df = V.performer_detail(c, channels, "dj")
    return df.select("dj", "name", location_status(F.col("country"), none, none, none, none).alias("location_status"), classification_status(F.col("verdict")).alias("classification_status"), "has_email", "submission_routes", "social_channels", "has_submission_route")


PERFORMER_DETAILS = f"""
WITH o AS (SELECT o_custkey AS dj, {_sql_pick(_CHANNELS, "o_orderkey")} AS channel FROM orders),
n AS (SELECT dj, count(*) FILTER (channel IN ('email', 'submission_email')) AS mail, count(*) FILTER (channel IN ('submission_email', 'submission_page', 'contact_page')) AS routes,
    count(*) FILTER (channel IN ('instagram', 'x', 'facebook', 'youtube')) AS social FROM o GROUP BY dj)
SELECT c_custkey AS dj, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN 'unverified' ELSE 'unavailable' END AS location_status, ['verified', 'not_qualified', 'needs_verification'][c_custkey % 3 + 1] AS classification_status,
    coalesce(mail, 0) > 0 AS has_email, coalesce(routes, 0) AS submission_routes, coalesce(social, 0) AS social_channels, coalesce(routes, 0) > 0 AS has_submission_route FROM customer LEFT JOIN n ON dj = c_custkey
"""


def track_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ6: the fields of a track that a listing shows, and its link."""
    p = table(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    rows = p.select(F.col("p_partkey").cast("string").alias("track_id"), F.sha2("p_name", 256).alias("sha256"), F.concat("p_name", F.lit(".mp3")).alias("original_filename"), F.col("p_size").alias("size_bytes"), F.lit("audio/mpeg").alias("content_type"), F.lower("p_brand").alias("status"), none.alias("reject_reason"), F.col("p_type").alias("notes"), none.alias("created_at"), none.alias("updated_at"), F.lit("/data").alias("path"))
    return V.track_view(rows).drop("reject_reason", "created_at", "updated_at")


TRACK_VIEWS = """
SELECT p_partkey::VARCHAR AS track_id, sha256(p_name) AS sha256, p_name || '.mp3' AS original_filename, p_size AS size_bytes, 'audio/mpeg' AS content_type, lower(p_brand) AS status, p_type AS notes, '/api/v1/tracks/' || p_partkey AS link FROM part
"""


def page_route_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS14: what each crawled page is good for, and what is known of it."""
    k = F.col("page_id") % 3
    p = table(spark, sf_dir, "pages").select("page_id", U.page_category(F.lit(""), F.col("url")).alias("category"), F.when(k == 0, True).when(k == 1, False).alias("reachable"))
    return V.page_view(p).drop("reachable")


_TEXT_CATEGORY = "CASE " + " ".join("WHEN regexp_matches(lower(trim(url)), '" + p.replace("'", "''") + f"') THEN '{n}'" for n, p in U.PAGE_CATEGORIES) + " ELSE 'other' END"
_SEMANTICS = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in V.PAGE_SEMANTICS)
PAGE_ROUTE_VIEWS = f"""
WITH known(category, route_class, kind, why, actionability, next_step) AS (VALUES {_SEMANTICS}), p AS (SELECT page_id, {_TEXT_CATEGORY} AS category FROM pages)
SELECT page_id, category, CASE WHEN page_id % 3 = 0 THEN 'VERIFIED' ELSE 'DISCOVERED' END AS evidence_state,
    ['verified reachable', 'discovered link; currently unreachable', 'discovered link; reachability not yet confirmed'][page_id % 3 + 1] AS evidence_note, route_class, kind, why, actionability, next_step FROM p JOIN known USING (category)
"""

_MARKERS = {"contact": "contact", "submission": "submi", "programming": "program|shows|schedule"}


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN8: the page of each domain for contact, submissions and programming with the largest weight of its path, the first on ties."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", U.registrable_domain(F.col("url")).alias("domain"), U.path(F.col("url")).alias("path"))
    p = p.withColumn("weight", U.link_weight(F.col("path"), F.lit("")))
    best = lambda m: F.max_by("url", F.when(F.col("path").rlike(f"(?i){m}") & (F.col("weight") > 0), F.struct("weight", -F.col("page_id"))))
    return p.groupBy("domain").agg(*[best(m).alias(name) for name, m in _MARKERS.items()])


_PATH_WEIGHT = ", ".join(f"CASE WHEN regexp_matches(p || ' ', '(?i){p}') THEN {w} ELSE 0 END" for p, w in LINK_WEIGHTS)
MARKED_PAGES = f"""
WITH parts AS (SELECT page_id, url, {_HOST} AS h, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages), w AS (SELECT *, {_DOMAIN} AS domain, greatest({_PATH_WEIGHT}) AS weight FROM parts)
SELECT domain, {", ".join(f"first(url ORDER BY weight DESC, page_id) FILTER (weight > 0 AND regexp_matches(p, '(?i){m}')) AS {name}" for name, m in _MARKERS.items())} FROM w GROUP BY domain
"""


def check_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT13: the pages of each domain to check next, eight at most."""
    p = table(spark, sf_dir, "pages")
    pages = p.select(U.registrable_domain(F.col("url")).alias("station"), U.page_category(F.lit(""), F.col("url")).alias("category"), "url", (F.col("page_id") % 7 == 0).alias("reachable"))
    return V.check_queue(pages, p.select("url", (F.col("page_id") % 5 == 0).alias("ok"))).select("station", "category", "url", F.col("place").cast("long").alias("place"))


CHECK_QUEUE = f"""
WITH parts AS (SELECT page_id, url, {_HOST} AS h FROM pages), x AS (SELECT DISTINCT {_DOMAIN} AS station, {_TEXT_CATEGORY} AS category, url FROM parts WHERE page_id % 7 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 5 = 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY {_sql_map("category", {c: k for k, c in enumerate(V.CHECK_ORDER)}, "6")}, url, category) AS place FROM x)
SELECT station, category, url, place FROM r WHERE place <= 8
"""

_TYPES = [*V.RECIPIENT_KINDS, "unheard_of"]


def recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ8 and PRJ9: whom a message goes to for each order's route; orders whose route leads nowhere are left out."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    df = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    value = F.when(k % 4 == 0, F.concat(F.lit("mailto:r"), k, F.lit("@x.org"))).when(k % 4 == 1, F.concat(F.lit("https://x.org/"), k)).otherwise("tel")
    station = F.struct(F.concat(F.lit("id"), "c_custkey").alias("identity_key"), F.col("c_name").alias("name"), F.when(k % 3 > 0, F.concat(F.lit("-S"), "c_custkey", F.lit(".Org"))).alias("domain"))
    route = F.struct(_pick(_TYPES, "m").alias("type"), value.alias("value"), F.when(k % 5 > 0, "Title").alias("title"), none.alias("class"), F.lit("https://s.org").alias("source_url"))
    contact = F.when(F.col("o_orderstatus") == "F", F.struct(F.concat(F.lit("u"), k).alias("contact_uid"), none.alias("name"), F.lit("host").alias("role"), F.when(k % 2 > 0, "c@x.org").alias("email"), none.alias("source_url")))
    df = df.withColumn("m", k + F.col("o_custkey"))
    return df.select("o_orderkey", V.recipient(station, route, contact).alias("r")).filter("r is not null").select("o_orderkey", "r.*")


RECIPIENTS = f"""
WITH o AS (SELECT o_orderkey, o_orderkey AS k, c_custkey, c_name, o_orderstatus = 'F' AS has, {_sql_pick(_TYPES, "(o_orderkey + o_custkey)")} AS t,
    CASE o_orderkey % 4 WHEN 0 THEN 'mailto:r' || o_orderkey || '@x.org' WHEN 1 THEN 'https://x.org/' || o_orderkey ELSE 'tel' END AS value FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT *, {_sql_map("t", V.RECIPIENT_KINDS, "'webform'")} AS kind, CASE WHEN k % 5 > 0 THEN 'Title' END AS title FROM o),
e AS (SELECT *, CASE WHEN kind = 'email' THEN CASE WHEN k % 4 = 0 THEN value[8:] WHEN has AND k % 2 > 0 THEN 'c@x.org' END END AS mail, CASE WHEN kind IN ('webform', 'contact', 'dj') AND k % 4 = 1 THEN value END AS submission_url FROM s)
SELECT o_orderkey, CASE WHEN has THEN 'u' || k WHEN k % 3 > 0 THEN 'wf_s' || c_custkey || '_org' WHEN k % 5 > 0 THEN 'wf_title' ELSE 'wf_station' END AS contact_uid, 'id' || c_custkey AS identity_key,
    coalesce(title, c_name || ' submission') AS name, CASE WHEN has THEN 'host' ELSE 'station' END AS role, coalesce(mail, '') AS email, 'https://s.org' AS source_url, CASE WHEN mail IS NULL THEN 'webform' ELSE 'email' END AS outreach_class,
    submission_url, kind AS route_kind, CASE WHEN mail IS NULL THEN coalesce(title, kind) END AS route_label FROM e WHERE mail IS NOT NULL OR submission_url IS NOT NULL
"""

_ROUTE_KINDS = [*V.FALLBACK_LEVELS, "page_about", "contact_host"]


def contact_best_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN4: the best way to each contact (customers): an own address, else the best route of the station."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).alias("station"), _pick(_ROUTE_KINDS, "o_orderkey").alias("kind"), F.when(F.col("o_orderstatus") == "O", "DISCOVERED").otherwise("ACTIONABLE").alias("state"), F.concat(F.lit("https://r"), "o_orderkey").alias("value"), F.col("o_orderkey").alias("rank"))
    k = F.col("c_custkey")
    mail = F.when(k % 3 == 0, F.concat(F.lit("a"), k, F.lit("@x.org"))).when(k % 3 == 1, F.concat(F.lit("a"), k, F.lit("@x.test")))
    contacts = table(spark, sf_dir, "customer").select(k, (k % 120).alias("station"), mail.alias("email"))
    return V.best_contact_route(contacts, o).select("c_custkey", F.coalesce("route_level", F.lit(0)).alias("route_level"), "route_value")


CONTACT_BEST_ROUTES = f"""
WITH o AS (SELECT o_custkey % 97 AS station, {_sql_map(_sql_pick(_ROUTE_KINDS, "o_orderkey"), V.FALLBACK_LEVELS, "NULL")} AS lv, o_orderkey FROM orders WHERE o_orderstatus <> 'O'),
b AS (SELECT station, first(lv ORDER BY lv, o_orderkey) AS lv, first(o_orderkey ORDER BY lv, o_orderkey) AS k FROM o WHERE lv IS NOT NULL GROUP BY station)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE coalesce(lv, 0) END AS route_level, CASE WHEN c_custkey % 3 = 0 THEN 'mailto:a' || c_custkey || '@x.org' ELSE 'https://r' || k END AS route_value FROM customer LEFT JOIN b ON station = c_custkey % 120
"""


def enriched_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR3: scores after enrichment."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    genres = F.when(k % 2 == 0, F.array(F.lit("jazz")))
    return c.select(k, V.enriched_score((F.col("c_acctbal") / 8000), genres, F.when(k % 3 == 0, "send it"), k % 5 == 0).alias("score"))


ENRICHED_SCORES = """
SELECT c_custkey, greatest(0.0, least(1.0, round_even(c_acctbal / 8000 + CASE WHEN c_custkey % 2 = 0 THEN 0.03::DOUBLE + CASE WHEN c_custkey % 3 = 0 THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 0.03::DOUBLE ELSE 0 END
    ELSE CASE WHEN c_custkey % 3 = 0 THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 0.03::DOUBLE ELSE 0 END END, 2)))::DOUBLE AS score FROM customer
"""
_NAMED = ["host", "dj", "music_director"]


def assigned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON15: names of customers given to contacts without one, in order within page and role."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    page = F.col("o_custkey") % 50
    contacts = o.select(page.alias("page"), _pick(_NAMED, "o_orderkey").alias("role"), F.when(F.col("o_orderpriority") == "1-URGENT", "Known").alias("name"), "o_orderkey")
    names = c.select((F.col("c_custkey") % 50).alias("page"), _pick(_NAMED, "c_nationkey").alias("role"), F.concat(F.lit("N"), F.col("c_custkey") % 400).alias("name"), "c_custkey")
    return V.assign_names(contacts, names, "page", "o_orderkey", "c_custkey").select("o_orderkey", "role", "name")


ASSIGNED_NAMES = f"""
WITH c AS (SELECT o_custkey % 50 AS page, {_sql_pick(_NAMED, "o_orderkey")} AS role, o_orderpriority = '1-URGENT' AS known, o_orderkey FROM orders),
n AS (SELECT c_custkey % 50 AS page, {_sql_pick(_NAMED, "c_nationkey")} AS role, 'N' || c_custkey % 400 AS name, min(c_custkey) AS p FROM customer GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY page, role ORDER BY o_orderkey) AS i FROM c WHERE NOT known), b AS (SELECT *, row_number() OVER (PARTITION BY page, role ORDER BY p) AS i FROM n)
SELECT o_orderkey, a.role, name FROM a LEFT JOIN b USING (page, role, i) UNION ALL SELECT o_orderkey, role, 'Known' FROM c WHERE known
"""


def payload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG21: payloads of performers with the rules that they break."""
    k = F.col("c_custkey")
    channel = lambda name, value, source: F.struct(name.alias("channel"), value.alias("value"), source.alias("source_url"))
    first = channel(_pick(_CHANNELS, "c_custkey"), F.when(k % 7 > 0, "v"), F.when(k % 11 > 0, "https://x.org").otherwise("ftp://x"))
    second = channel(F.when(k % 13 > 0, "website").otherwise(_pick(_CHANNELS, "c_custkey")), F.when(k % 7 > 0, " v "), F.lit("http://x.org"))
    df = table(spark, sf_dir, "customer").select(k, F.when(k % 5 > 0, F.col("c_name")).otherwise(" ").alias("name"), F.array(F.lit(" "), F.when(k % 3 > 0, "https://x.org").otherwise("x.org")).alias("urls"), F.when(k % 17 > 0, F.array(first, second)).alias("channels"))
    good, bad = M.split_valid(df, P.payload_rules(F.col("name"), F.col("urls"), F.col("channels")))
    both = good.withColumn("failed", F.array().cast("array<string>")).unionByName(bad)
    return both.select("c_custkey", F.array_join("failed", ",").alias("failed"))


PAYLOAD_CHECKS = f"""
WITH c AS (SELECT c_custkey AS k, {_sql_pick(_CHANNELS, "c_custkey")} AS ch, c_custkey % 17 > 0 AS has FROM customer)
SELECT k AS c_custkey, concat_ws(',', CASE WHEN k % 5 = 0 THEN 'name' END, CASE WHEN k % 3 = 0 THEN 'source_urls' END, CASE WHEN has AND ch = 'fax' THEN 'channel' END,
    CASE WHEN has AND k % 7 = 0 THEN 'value' END, CASE WHEN has AND k % 11 = 0 THEN 'channel_source' END, CASE WHEN has AND (k % 13 = 0 OR ch = 'website') THEN 'duplicate' END) AS failed FROM c
"""


def planned_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG22: performers whose own addresses give another class than the stored one; applied, and taken back again."""
    k = F.col("c_custkey")
    urls = F.when(k % 4 == 0, F.array(F.lit("https://dj.org/"), F.lit("https://www.eventbrite.com/e/1"))).when(k % 4 == 1, F.array(F.lit("https://x.org/tickets/1"))).when(k % 4 == 2, F.array(F.concat(F.lit("https://x.org/"), k)))
    stored = F.when(k % 3 == 0, "rejected").when(k % 3 == 1, "needs_verification")
    rows = table(spark, sf_dir, "customer").select(k, F.lit("Ann").alias("name"), F.coalesce(urls, F.array().cast("array<string>")).alias("source_urls"), stored.alias("verdict"))
    plan = P.planned_class(rows)
    after = P.apply_classes(rows, plan, "c_custkey", "run-1")
    before = P.reverse_classes(after, "run-1").select("c_custkey", F.col("verdict").alias("before"))
    target = plan.select("c_custkey", F.col("target.evidence_url").alias("evidence_url"))
    return after.select("c_custkey", "verdict").join(before, "c_custkey").join(target, "c_custkey", "left")


PLANNED_CLASSES = """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN 'rejected' ELSE 'needs_verification' END AS verdict, ['rejected', 'needs_verification', NULL][c_custkey % 3 + 1] AS before,
    ['https://www.eventbrite.com/e/1', 'https://x.org/tickets/1', 'https://x.org/' || c_custkey, ''][c_custkey % 4 + 1] AS url FROM customer)
SELECT c_custkey, verdict, before, CASE WHEN before IS DISTINCT FROM verdict THEN url END AS evidence_url FROM c
"""


def performer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT17: candidates after the fetch: those that qualify, and the faults of the others."""
    k = F.col("c_custkey")
    url = F.when(k % 5 == 0, "https://www.songkick.com/a").otherwise(F.concat(F.lit("https://p"), k, F.lit(".org/")))
    df = table(spark, sf_dir, "customer").select(k, url.alias("url"), F.when(k % 3 == 0, "dj ann official site").otherwise("Ann").alias("title"), F.lit("").alias("snippet"), F.when(k % 2 == 0, "Buy tickets").alias("page_title"), (k % 7 > 0).alias("fetched"))
    good, bad = P.gate(df)
    return good.select("c_custkey", F.lit("").alias("fault")).unionByName(bad.select("c_custkey", "fault"))


PERFORMER_GATE = """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'not_a_dj' WHEN c_custkey % 2 = 0 AND c_custkey % 7 > 0 THEN 'not_a_dj' WHEN c_custkey % 3 = 0 THEN '' ELSE 'needs_human_review' END AS fault FROM customer
"""


def merged_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG3: customers with one key merged to one record, the first of them in order."""
    k = F.col("c_custkey")
    at = lambda n: F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(k * n, F.lit(300)).cast("int")), "yyyy-MM-dd")
    rows = table(spark, sf_dir, "customer").select(
        (k % 40).alias("key"), k, F.concat(F.lit("S"), k % 7).alias("name"), F.array(F.concat(F.lit("u"), k % 9), F.concat(F.lit("u"), k % 4)).alias("source_urls"),
        F.when(k % 3 == 0, F.create_map(F.lit("x"), F.concat(F.lit("x"), k))).when(k % 3 == 1, F.create_map(F.lit("f"), F.concat(F.lit("f"), k))).alias("social_urls"), F.when(k % 80 > 60, F.concat(F.lit("p"), k)).alias("submission_url"), F.lit(None).cast("string").alias("contact_url"),
        F.when(k % 120 > 70, F.concat(F.lit("c"), k)).otherwise("").alias("city"), F.col("c_nationkey").cast("string").alias("country"), F.lit(None).cast("string").alias("description"), F.when(k % 200 > 150, "college").when(k % 2 == 0, "unknown").alias("station_type"),
        F.when(k % 6 > 0, at(7)).otherwise("").alias("discovered_at"), at(11).alias("last_observed_at"),
    )
    df = M.merge_duplicates(rows, "key", "c_custkey")
    lists = [F.array_join(c, ",").alias(c) for c in ("alternate_names", "source_urls")]
    return df.select("key", "records", "name", *lists, F.to_json("social_urls").alias("social_urls"), "submission_url", "city", "country", "station_type", "discovered_at", "last_observed_at")


MERGED_STATIONS = """
WITH c AS (SELECT c_custkey % 40 AS key, c_custkey AS k, c_nationkey AS n FROM customer), names AS (SELECT key, k % 7 AS v, min(k) AS o FROM c GROUP BY ALL),
u AS (SELECT key, v, min(o) AS o FROM (SELECT key, k % 9 AS v, k * 2 AS o FROM c UNION ALL SELECT key, k % 4, k * 2 + 1 FROM c) GROUP BY ALL)
SELECT key, count(*) AS records, 'S' || min(k) % 7 AS name, coalesce((SELECT string_agg('S' || v, ',' ORDER BY o) FROM names x WHERE x.key = c.key AND x.v <> min(c.k) % 7), '') AS alternate_names,
    (SELECT string_agg('u' || v, ',' ORDER BY o) FROM u WHERE u.key = c.key) AS source_urls, '{' || concat_ws(',', '"f":"f' || min(k) FILTER (k % 3 = 1) || '"', '"x":"x' || min(k) FILTER (k % 3 = 0) || '"') || '}' AS social_urls,
    'p' || min(k) FILTER (k % 80 > 60) AS submission_url, 'c' || min(k) FILTER (k % 120 > 70) AS city, arg_min(n, k)::VARCHAR AS country, CASE WHEN bool_or(k % 200 > 150) THEN 'college' WHEN bool_or(k % 2 = 0) THEN 'unknown' END AS station_type,
    strftime(DATE '2024-01-01' + min(k * 7 % 300) FILTER (k % 6 > 0)::INT, '%Y-%m-%d') AS discovered_at, strftime(DATE '2024-01-01' + max(k * 11 % 300)::INT, '%Y-%m-%d') AS last_observed_at FROM c GROUP BY key
"""


def staff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT22: whether a page lists staff, by title, address or lines of names with roles."""
    k = F.col("c_custkey")
    lines = F.array_join(F.transform(F.sequence(F.lit(0), (k % 5).cast("int")), lambda i: F.when(i == 0, "Welcome here").otherwise(F.concat(F.lit("Ann Lee"), F.lit("\nHost\nabout music\n")))), "\n")
    url = F.when(k % 6 == 0, "https://x.org/about/team").when(k % 6 == 1, "https://x.org/email.php?id=4").otherwise("https://x.org/a")
    return table(spark, sf_dir, "customer").select(k, people.is_directory(url, F.when(k % 7 == 0, "Meet the Team"), F.when(k % 11 > 0, lines)).alias("staff"))


STAFF_PAGES = "SELECT c_custkey, c_custkey % 6 <> 1 AND (c_custkey % 6 = 0 OR c_custkey % 7 = 0 OR (c_custkey % 11 > 0 AND c_custkey % 5 >= 3)) AS staff FROM customer"

_EVENT = {
    "required": ["kind", "users"],
    "properties": {"kind": {"type": "string", "enum": ["click", "purchase", "view"]}, "value": {"type": "integer"}, "users": {"type": "array", "maxItems": 2, "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}}}},
}


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN3 and JSN4: the JSON value of a free text about an event, and its first fault by a schema."""
    e = table(spark, sf_dir, "events")
    amount = F.concat(F.floor("value").cast("string"), F.when(F.col("event_id") % 4 == 0, ".5").otherwise(""))
    users = F.array_join(F.transform(F.sequence(F.lit(0), F.pmod("user_id", F.lit(3)).cast("int")), lambda i: F.concat(F.lit('{"n": '), F.col("user_id").cast("string"), F.lit("}"))), ", ")
    given = F.when(F.col("user_id") % 7 > 0, F.concat(F.lit(', "users": ['), users, F.lit("]"))).otherwise("")
    text = F.concat(F.lit("Event "), "event_id", F.lit(' {says}: {"kind": "'), "event_type", F.lit('", "value": '), amount, given, F.lit("} and "), "props")
    found = e.select("event_id", J.first_json(text).alias("value"))
    return found.withColumn("fault", J.schema_error(F.try_parse_json("value"), _EVENT))


MODEL_ANSWERS = """
WITH e AS (SELECT *, floor(value)::BIGINT || CASE WHEN event_id % 4 = 0 THEN '.5' ELSE '' END AS amount, array_to_string(['{"n": ' || user_id || '}' for i in range(0, user_id % 3 + 1)], ', ') AS users FROM events)
SELECT event_id, '{"kind": "' || event_type || '", "value": ' || amount || CASE WHEN user_id % 7 > 0 THEN ', "users": [' || users || ']' ELSE '' END || '}' AS value,
    CASE WHEN user_id % 7 = 0 THEN 'output missing required key ''users''' WHEN event_type NOT IN ('click', 'purchase', 'view') THEN 'output.kind must be one of [''click'', ''purchase'', ''view'']'
        WHEN event_id % 4 = 0 THEN 'output.value must be an integer' WHEN user_id % 3 = 2 THEN 'output.users exceeds 2 items' END AS fault FROM e
"""


def keyed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN5: lists of facts of line items as maps by value, the last one of a value."""
    fact = lambda value, source: F.struct(value.cast("string").alias("value"), F.lit(source).alias("source"))
    q = F.col("l_quantity").cast("long") % 7
    facts = F.array(fact(F.col("l_linenumber"), "line"), fact(F.col("l_suppkey") % 7, "supplier"), fact(F.when(q > 0, q), "quantity"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", J.keyed(facts, "value").alias("m"))
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", F.array_join(F.map_keys("m"), ",").alias("keys"), F.array_join(F.transform(F.map_values("m"), lambda x: x["source"]), ",").alias("sources"))


KEYED_FACTS = """
WITH x AS (SELECT *, [l_linenumber::VARCHAR, (l_suppkey % 7)::VARCHAR, CASE WHEN l_quantity::BIGINT % 7 > 0 THEN (l_quantity::BIGINT % 7)::VARCHAR END] AS v FROM lineitem),
k AS (SELECT *, list_filter(v, lambda a, i: a IS NOT NULL AND list_position(v, a) = i) AS names FROM x)
SELECT l_orderkey, l_linenumber, l_suppkey, array_to_string(names, ',') AS keys,
    array_to_string([CASE WHEN v[3] = n THEN 'quantity' WHEN v[2] = n THEN 'supplier' ELSE 'line' END for n in names], ',') AS sources FROM k
"""


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR2: states of jobs (customers) from their events (orders), in whatever order they come."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), _pick([*JOB_STATES[:2], *JOB_STATES, "lost"], "o_orderkey").alias("status"), F.col("o_orderkey").alias("at"))
    return job_states(o)


RUN_STATES = f"""
WITH o AS (SELECT o_custkey AS run_id, {_sql_pick([*JOB_STATES[:2], *JOB_STATES, "lost"], "o_orderkey")} AS status, o_orderkey AS "at" FROM orders), s AS (SELECT *, CASE status WHEN 'queued' THEN 1 WHEN 'running' THEN 2 ELSE 3 END AS step FROM o WHERE status <> 'lost')
SELECT run_id, first(status ORDER BY step DESC, "at" DESC) AS status, first("at" ORDER BY step DESC, "at" DESC) AS "at", max(step) = 3 AS ended FROM s GROUP BY run_id
"""

QUERIES = {
    "station_details": (station_details, STATION_DETAILS), "channel_views": (channel_views, CHANNEL_VIEWS), "performer_details": (performer_details, PERFORMER_DETAILS), "track_views": (track_views, TRACK_VIEWS),
    "page_route_views": (page_route_views, PAGE_ROUTE_VIEWS), "marked_pages": (marked_pages, MARKED_PAGES), "check_queue": (check_queue, CHECK_QUEUE), "recipients": (recipients, RECIPIENTS),
    "contact_best_routes": (contact_best_routes, CONTACT_BEST_ROUTES), "enriched_scores": (enriched_scores, ENRICHED_SCORES), "assigned_names": (assigned_names, ASSIGNED_NAMES), "payload_checks": (payload_checks, PAYLOAD_CHECKS),
    "planned_classes": (planned_classes, PLANNED_CLASSES), "performer_gate": (performer_gate, PERFORMER_GATE), "merged_stations": (merged_stations, MERGED_STATIONS), "staff_pages": (staff_pages, STAFF_PAGES),
    "model_answers": (model_answers, MODEL_ANSWERS), "keyed_facts": (keyed_facts, KEYED_FACTS), "run_states": (run_states, RUN_STATES),
}
