"""Scores of stations and contacts, and the ranking of opportunities end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import score as S
from ..sources import table

# Customers stand for stations, their orders for routes and outreach history, nations for places, market segments for
# genres and formats.  `release` is a track with the genres building and furniture.


def station_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR1: additive station confidence; each flag is a digit of the key."""
    k = F.col("c_custkey")
    flag = lambda d: F.pmod(k, F.lit(d)) == 0
    text = lambda d: F.when(flag(d), F.lit("x"))
    score = S.station_score(~flag(3), text(2), flag(4), text(5), flag(2) | flag(7), flag(14), flag(7), text(6), F.when(flag(5), F.lit("community")).otherwise("unknown"), F.pmod(k, F.lit(4)))
    return table(spark, sf_dir, "customer").select("c_custkey", score.alias("score"))


STATION_SCORES = """
WITH f AS (SELECT c_custkey, c_custkey % 3 <> 0 AS up, c_custkey % 2 = 0 AS site, c_custkey % 4 = 0 AS same, c_custkey % 5 = 0 AS contact, c_custkey % 2 = 0 OR c_custkey % 7 = 0 AS mail,
    c_custkey % 14 = 0 AS own, c_custkey % 7 = 0 AS free, c_custkey % 6 = 0 AS submit, c_custkey % 4 >= 2 AS sources FROM customer)
SELECT c_custkey, greatest(0, least(100, CASE WHEN up THEN 25 ELSE -30 END + CASE WHEN site THEN 10 ELSE 0 END + CASE WHEN same THEN 15 WHEN up THEN -15 ELSE 0 END
    + CASE WHEN contact THEN 15 ELSE 0 END + CASE WHEN mail AND own THEN 20 WHEN mail AND free THEN 3 WHEN mail THEN 10 ELSE 0 END + CASE WHEN submit THEN 15 ELSE 0 END
    + CASE WHEN contact THEN 5 ELSE 0 END + CASE WHEN sources THEN 10 ELSE 0 END)) / 100 AS score FROM f
"""


def contact_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR2 and SCR4: confidence and relevance of contacts."""
    k = F.col("s_suppkey")
    role = F.element_at(F.array(*[F.lit(r) for r in ("music_director", "host", "general", "programming")]), F.pmod(k, F.lit(4)).cast("int") + 1)
    email = F.when(F.pmod(k, F.lit(3)) == 0, "a@gmail.com").when(F.pmod(k, F.lit(3)) == 1, "b@mail.radio.org")
    name = F.when(F.pmod(k, F.lit(5)) == 0, F.col("s_name"))
    url = F.when(F.pmod(k, F.lit(2)) == 0, "https://radio.org/contact").otherwise("https://radio.org/submit")
    rel = S.relevance(role, F.pmod(k, F.lit(8)) == 1, name)
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.contact_score(url, email, name, role, F.array(F.lit("radio.org"))).alias("confidence"), rel["score"].alias("relevance"), rel["label"].alias("label"))


CONTACT_SCORES = """
WITH f AS (SELECT s_suppkey AS k, s_suppkey % 4 AS r, s_suppkey % 3 AS e, s_suppkey % 5 = 0 AS named, s_suppkey % 2 = 0 AS page, s_suppkey % 8 = 1 AS preferred FROM supplier),
g AS (SELECT *, least(100, greatest(CASE WHEN r IN (0, 3) THEN 80 WHEN r = 1 THEN 50 ELSE 30 END, CASE WHEN preferred THEN 90 ELSE 0 END) + CASE WHEN named THEN 5 ELSE 0 END) AS rel FROM f)
SELECT k AS s_suppkey, greatest(5, least(95, 30 + CASE WHEN page THEN 12 ELSE 15 END + CASE e WHEN 1 THEN 25 WHEN 0 THEN -10 ELSE 0 END + CASE WHEN named THEN 15 ELSE 0 END
    + CASE WHEN r IN (0, 3) THEN 15 ELSE 0 END)) / 100 AS confidence, rel AS relevance, CASE WHEN rel >= 75 THEN 'High' WHEN rel >= 45 THEN 'Medium' ELSE 'Low' END AS label FROM g
"""


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR5 to SCR14, WIN3, FLT14 and SRT6: every station scored for a release, with its best route, tier and signs.

    One plan: routes and history are reduced to a row for each station before they meet the stations.
    """
    c, n, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    priority = F.least(F.substring("o_orderpriority", 1, 1).cast("int"), F.lit(4))
    usable = F.col("o_orderstatus") == "F"
    kind = F.when(F.col("o_orderkey") % 10 == 0, "submission_url").when(F.col("o_orderkey") % 10 == 1, "submission_page").otherwise("contact")
    by_station = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min(F.when(usable, F.struct(priority.alias("priority"), (-F.col("o_totalprice")).alias("c"), "o_orderkey", kind.alias("kind")))).alias("best"),
        F.count("*").alias("routes"), F.max("o_orderdate").alias("last"), F.count_if(F.col("o_orderpriority") == "2-HIGH").alias("contacts"),
    )
    df = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(by_station, "c_custkey", "left")
    genres, formats = S.as_list(F.concat_ws(",", "c_mktsegment", "n_name")), F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("music"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("talk")))
    domain = F.when(F.col("c_custkey") % 5 == 0, "radio.test").when(F.col("c_custkey") % 5 != 1, "radio.org")
    contacted = F.col("last") >= F.lit("1998-06-01").cast("timestamp")
    market, status = F.when(F.col("c_nationkey") % 2 == 0, F.col("n_name")), F.when(F.col("c_acctbal") > 5000, "enriched").otherwise("found")
    checks = [domain.isNotNull(), F.col("c_custkey") % 2 == 0, market.isNotNull(), F.col("c_acctbal") > 0, F.size(genres) > 0, S.truthy(formats, "array"), F.col("c_acctbal") > 1000, F.col("c_acctbal") > 7000, F.col("contacts") > 0, F.col("routes") > 0, F.col("best").isNotNull()]
    components = {
        "route": S.route_component(F.col("best").isNotNull(), F.col("best.priority"), F.col("best.kind"), F.col("routes") > 0),
        "contact": S.contact_component(F.coalesce(F.col("contacts"), F.lit(0)) > 0, F.when(F.col("contacts") > 0, F.least(F.col("contacts"), F.lit(6)))),
        "genre": S.genre_component(S.as_list(F.lit("building; Furniture")), genres),
        "record": S.record_component(*checks),
        "identity": S.identity_component(domain, status),
        "format": S.format_component(formats),
        "location": S.location_component(market, F.lit(None).cast("string")),
        "release": S.release_component(F.lit("ready")),
    }
    scored = df.select("c_custkey", "c_name", "n_name", S.opportunity(components, contacted).alias("s"), F.coalesce("best.priority", F.lit(0)).alias("priority"))
    out = scored.select("c_custkey", "c_name", F.col("n_name").alias("country"), "priority", "s.*").filter(F.col("tier") != "LOW")
    return out.orderBy(F.desc("score"), F.lower("c_name"), "c_custkey")


OPPORTUNITIES = """
WITH r AS (
    SELECT o_custkey AS k, count(*) AS routes, max(o_orderdate) AS last, count(*) FILTER (o_orderpriority = '2-HIGH') AS contacts,
        min({'p': least(o_orderpriority[1]::INT, 4), 'c': -o_totalprice, 'o': o_orderkey, 't': CASE o_orderkey % 10 WHEN 0 THEN 'u' WHEN 1 THEN 'p' ELSE 'c' END}) FILTER (o_orderstatus = 'F') AS best
    FROM orders GROUP BY o_custkey),
s AS (
    SELECT c_custkey, c_name, n_name, c_acctbal, c_custkey % 5 AS d, c_custkey % 3 AS f, c_nationkey % 2 = 0 AS placed, coalesce(routes, 0) AS routes, coalesce(contacts, 0) AS contacts, best,
        coalesce(last >= TIMESTAMP '1998-06-01', false) AS contacted, list_distinct([lower(c_mktsegment), lower(n_name)]) AS g
    FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN r ON k = c_custkey),
x AS (
    SELECT *,
        CASE WHEN best IS NOT NULL THEN CASE WHEN best.t = 'u' THEN 1.0 WHEN best.t = 'p' THEN 0.9 WHEN best.p = 1 THEN 1.0 WHEN best.p = 2 THEN 0.75 WHEN best.p = 3 THEN 0.5 ELSE 0.3 END
            WHEN routes > 0 THEN 0.25 ELSE 0.1 END::DOUBLE AS route,
        CASE contacts WHEN 0 THEN 0.1 WHEN 1 THEN 1.0 WHEN 2 THEN 0.85 WHEN 3 THEN 0.6 WHEN 4 THEN 0.45 WHEN 5 THEN 0.4 ELSE 0.35 END::DOUBLE AS contact,
        CASE WHEN len(list_intersect(g, ['building', 'furniture'])) = 0 THEN 0.0
            ELSE least(1.0, 0.5 + len(list_intersect(g, ['building', 'furniture']))::DOUBLE / len(list_distinct(list_concat(g, ['building', 'furniture'])))) END::DOUBLE AS genre,
        ((d <> 1)::INT + (c_custkey % 2 = 0)::INT + placed::INT + (c_acctbal > 0)::INT + 1 + (f <> 2)::INT + (c_acctbal > 1000)::INT + (c_acctbal > 7000)::INT + (contacts > 0)::INT + (routes > 0)::INT
            + (best IS NOT NULL)::INT)::DOUBLE / 11 AS record,
        CASE WHEN d = 1 THEN 0.4 WHEN d = 0 THEN 0.6 WHEN c_acctbal > 5000 THEN 1.0 ELSE 0.8 END::DOUBLE AS identity,
        CASE f WHEN 0 THEN 1.0 WHEN 1 THEN 0.3 ELSE 0.5 END::DOUBLE AS format, CASE WHEN placed THEN 0.9 ELSE 0.5 END::DOUBLE AS location FROM s),
y AS (SELECT *, round_even(round(round(route, 4) * 22 + round(contact, 4) * 17 + round(genre, 4) * 13 + round(record, 4) * 13 + identity * 9 + format * 8 + location * 6 + 12, 6), 0)::INT AS raw FROM x),
z AS (SELECT *, CASE WHEN contacted THEN least(12, raw) ELSE 0 END AS penalty FROM y)
SELECT c_custkey, c_name, n_name AS country, coalesce(best.p, 0)::INT AS priority, raw - penalty AS score, CASE WHEN raw - penalty >= 70 THEN 'HIGH' ELSE 'MEDIUM' END AS tier, penalty,
    (SELECT string_agg(CASE WHEN v >= 0.75 THEN '+' WHEN v <= 0.35 THEN '-' ELSE 'i' END, '' ORDER BY i) FROM (SELECT unnest([route, contact, genre, record, 1.0, identity, format, location]) AS v, unnest(range(8)) AS i)) AS signs
FROM z WHERE raw - penalty >= 40
"""

QUERIES = {"station_scores": (station_scores, STATION_SCORES), "contact_scores": (contact_scores, CONTACT_SCORES), "opportunities": (opportunities, OPPORTUNITIES)}
