"""Listings, semi and anti joins, nested children, counts by vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import OUTREACH_STATUSES
from ..operators import listing as L
from ..operators.verify import zero_filled
from ..sources import table


def _stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    df = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return df.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("format"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), (F.col("c_acctbal") / 10000).alias("confidence"))


def station_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1 to FLT5, SRT1, PRJ2 and LIM1: a page of a filtered list by name and id."""
    df = _stations(spark, sf_dir)
    df = df.filter(L.contains_text(F.col("name"), "#00") & L.in_list_text(F.array("format"), "build") & (F.col("confidence") >= 0.2))
    return L.page(df.select("id", "name", "country", "confidence"), [F.lower("name"), F.col("id")], limit=40, offset=10)


STATION_PAGE = """
SELECT c_custkey AS id, c_name AS name, n_name AS country, c_acctbal / 10000 AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE contains(lower(c_name), '#00') AND contains(lower(c_mktsegment), 'build') AND c_acctbal / 10000 >= 0.2 ORDER BY lower(c_name), c_custkey LIMIT 40 OFFSET 10
"""


def station_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1 and AGG2: visible, full and excluded counts in one pass, with counts of each reason, which may overlap."""
    df = _stations(spark, sf_dir)
    hidden, rejected = F.col("confidence") < 0, F.col("format") == "MACHINERY"
    return L.totals(df, ~hidden & ~rejected, {"hidden": hidden, "rejected": rejected})


STATION_TOTALS = """
SELECT count(*) FILTER (c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY') AS total, count(*) AS full_total, count(*) FILTER (NOT (c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY')) AS excluded,
    count(*) FILTER (c_acctbal < 0) AS hidden, count(*) FILTER (c_mktsegment = 'MACHINERY') AS rejected FROM customer
"""


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT11, FLT12 and FLT15: a text in any of several columns, and a place that may be unknown."""
    df = _stations(spark, sf_dir).withColumn("place", F.when(F.col("id") % 4 != 0, F.col("region")))
    return df.filter(L.search([F.col("name"), F.col("country"), F.col("format")], "on_1") & L.same_place(F.col("place"), " asia ")).select("id", "country", "format", "place")


SEARCHED = """
SELECT c_custkey AS id, n_name AS country, c_mktsegment AS format, CASE WHEN c_custkey % 4 <> 0 THEN r_name END AS place
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE contains(lower(c_name) || '|' || lower(n_name) || '|' || lower(c_mktsegment), 'on_1') AND (c_custkey % 4 = 0 OR lower(r_name) = 'asia')
"""


def with_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT13, JON1, JON2, JON3 and JON6: suppliers by whether they have lines, and whether any was returned late."""
    s, lines = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    late = lines.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 50) & (F.col("l_discount") > 0.09))
    out = L.with_flag(s.select("s_suppkey", "s_nationkey"), late, "s_suppkey", "has_late")
    clean = s.join(late, "s_suppkey", "left_anti").join(lines, "s_suppkey", "left_semi").select("s_suppkey", F.lit(True).alias("clean"))
    return out.join(clean, "s_suppkey", "left").withColumn("clean", F.coalesce("clean", F.lit(False)))


WITH_CONTACT = """
WITH late AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 50 AND l_discount > 0.09)
SELECT s_suppkey, s_nationkey, s_suppkey IN (SELECT l_suppkey FROM late) AS has_late,
    s_suppkey NOT IN (SELECT l_suppkey FROM late) AND s_suppkey IN (SELECT l_suppkey FROM lineitem) AS clean FROM supplier
"""


def with_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON7, JON9 and PRJ7: orders with their lines as an ordered list, empty for none."""
    o, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem")
    lines = lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    out = L.nested(o, lines, "o_orderkey", "lines", ["l_linenumber", "l_partkey"], most=5)
    return out.select("o_orderkey", F.size("lines").alias("n"), F.array_join(F.transform("lines", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


WITH_ATTEMPTS = """
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem),
kept AS (SELECT l_orderkey, count(*) AS n, string_agg(l_partkey::VARCHAR, ',' ORDER BY k) AS parts FROM ranked WHERE k <= 5 GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(n, 0)::INT AS n, coalesce(parts, '') AS parts FROM orders LEFT JOIN kept ON o_orderkey = l_orderkey
"""


def contacted_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON8, JON16 and WIN10: the last order of a kind of each customer, NULL for none."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    last = o.filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("contacted_at"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("order"))
    return c.select("c_custkey").join(last, "c_custkey", "left").withColumn("order", F.coalesce("order", F.lit(-1)))


CONTACTED_AT = """
SELECT c_custkey, max(o_orderdate) AS contacted_at, coalesce(arg_max(o_orderkey, (o_orderdate, o_orderkey)), -1) AS "order"
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey
"""


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG21: counts for every status of a vocabulary."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", "sent").when(F.col("event_type") == "click", "responded").when(F.col("event_type") == "error", "failed").otherwise("ready")
    return zero_filled(e.select(status.alias("status")), "status", OUTREACH_STATUSES)


STATUS_COUNTS = f"""
WITH s AS (SELECT CASE event_type WHEN 'view' THEN 'sent' WHEN 'click' THEN 'responded' WHEN 'error' THEN 'failed' ELSE 'ready' END AS status FROM events)
SELECT v.status, count(s.status) AS n FROM (SELECT unnest({OUTREACH_STATUSES}) AS status) v LEFT JOIN s USING (status) GROUP BY v.status
"""


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG22: distinct values of several columns."""
    df = _stations(spark, sf_dir)
    return L.facet(df.withColumnRenamed("country", "value"), "value").withColumn("facet", F.lit("country")).unionByName(L.facet(df.withColumnRenamed("format", "value"), "value").withColumn("facet", F.lit("format")))


FACETS = "SELECT DISTINCT n_name AS value, 'country' AS facet FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT DISTINCT c_mktsegment, 'format' FROM customer"


def best_of_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN12: the three best parts of each brand and type, by size, price and key."""
    p = table(spark, sf_dir, "part")
    w = Window.partitionBy("p_brand", "p_type").orderBy(F.desc("p_size"), F.desc("p_retailprice"), "p_partkey")
    return p.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 3").select("p_brand", "p_type", "place", "p_partkey")


BEST_OF_CATEGORY = "SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS place, p_partkey FROM part QUALIFY place <= 3"


def history_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG20, WIN11, WIN14 and VER7: the last twenty events of each user in order, counted by type."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = e.withColumn("k", F.row_number().over(w)).filter("k <= 20")
    return last.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.min("event_id").alias("least"), F.max("ts").alias("last"))


HISTORY_TAILS = """
WITH t AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20)
SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, min(event_id) AS least, max(ts) AS last FROM t GROUP BY user_id
"""


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN1, JSN2 and FLT10: fields of JSON text, with a default."""
    e = table(spark, sf_dir, "events").withColumn("k", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1)))
    return e.filter(F.from_json("props", "k long")["k"].isNotNull()).groupBy("k").agg(F.count("*").alias("n"))


JSON_FIELDS = "SELECT (props ->> '$.k')::BIGINT AS k, count(*) AS n FROM events WHERE (props ->> '$.k') IS NOT NULL GROUP BY 1"

QUERIES = {
    "station_page": (station_page, STATION_PAGE), "station_totals": (station_totals, STATION_TOTALS), "searched": (searched, SEARCHED), "with_contact": (with_contact, WITH_CONTACT),
    "with_attempts": (with_attempts, WITH_ATTEMPTS), "contacted_at": (contacted_at, CONTACTED_AT), "status_counts": (status_counts, STATUS_COUNTS), "facets": (facets, FACETS),
    "best_of_category": (best_of_category, BEST_OF_CATEGORY), "history_tails": (history_tails, HISTORY_TAILS), "json_fields": (json_fields, JSON_FIELDS),
}
