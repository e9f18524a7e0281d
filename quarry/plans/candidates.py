"""Queries on candidates, routes and identity groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import classify as C
from ..operators import dedupe as D
from ..operators import html as H
from ..operators import routes as R
from ..sources import table


def station_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS2 and FLT16: pages judged as station candidates by address and their whole source."""
    p = table(spark, sf_dir, "pages")
    v = C.station_candidate(F.col("url"), F.col("html"), F.lit(None).cast("string"), as_sql=True)
    return p.select("page_id", v["verdict"].alias("verdict"), v["kind"].alias("kind"), v["reason"].alias("reason"))


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\.', '')"
_TEXT = r"trim(regexp_replace(html || ' ', '\s+', ' ', 'g'))"
STATION_VERDICTS = rf"""
WITH parts AS (SELECT page_id, array_to_string(string_split({_HOST}, '.')[-2:], '.') AS d, coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS p, {_TEXT} AS t FROM pages),
s AS (SELECT *, concat_ws(', ', CASE WHEN regexp_matches(t, '{V.STATION_WORDS}') THEN 'station_keyword' END, CASE WHEN regexp_matches(t, '{V.CALLSIGN}') THEN 'callsign' END,
    CASE WHEN regexp_matches(t, '{V.FREQUENCY}') THEN 'frequency' END) AS sig FROM parts),
k AS (SELECT *, CASE WHEN d IN ({", ".join(f"'{h}'" for h in V.PLATFORM_HOSTS)}) THEN 1 WHEN regexp_matches(p, '{V.ITEM_PATH}') THEN 2 WHEN sig <> '' THEN 3 WHEN regexp_matches(t, '{V.OTHER_TEXT}') THEN 4 ELSE 5 END AS c FROM s)
SELECT page_id, ['rejected', 'rejected', 'qualified', 'rejected', 'needs_review'][c] AS verdict, ['platform_page', 'non_station_path', 'station_signals', 'non_station_title', 'no_signal'][c] AS kind,
    ['platform host', 'item path', sig, 'other text', 'no signal'][c] AS reason FROM k
"""


def page_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS2 and FLT16: pages judged as station candidates by address, parsed title and the whole text that they show."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", H.parse_page(F.col("url"), F.col("html")).alias("p"))
    v = C.station_candidate(F.col("url"), F.col("p.title"), F.col("p.text"))
    return p.select("page_id", v["verdict"].alias("verdict"), v["kind"].alias("kind"), v["reason"].alias("reason"))


def _route_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as pages, customers as submissions, lines as contacts of a station (the customer)."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    names = F.array(*[F.lit(x) for x, _, _ in R.PAGE_ROUTES])
    pages = o.select(F.col("o_custkey").alias("station"), F.element_at(names, F.pmod("o_orderkey", F.lit(7)).cast("int") + 1).alias("category"), F.concat(F.lit("u"), "o_orderkey").alias("url"), F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("reachable"))
    k = F.col("c_custkey")
    subs = c.select(k.alias("station"), F.when(k % 11 == 0, F.concat(F.lit("s"), k)).alias("submission_url"), (k % 2 == 0).alias("verified"), F.when(k % 13 == 0, F.concat(F.lit("m@h"), k, F.when(k % 3 == 0, ".test").otherwise(".org"))).alias("submission_email"))
    roles = F.array(*[F.lit(x) for x in ("music_director", "general", "host", "producer")])
    contacts = c.select(k.alias("station"), F.element_at(roles, (k % 4).cast("int") + 1).alias("role"), F.when(k % 3 == 1, F.concat(F.lit("a@x"), k, F.lit(".org"))).alias("email"), F.when(k % 5 == 0, F.lit("1")).alias("phone"))
    return pages, subs, contacts


def station_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS9, CLS12, SRT8, WIN3: each station's level, number of routes and best route."""
    ranked = R.routes(*_route_inputs(spark, sf_dir))
    out = R.intelligence_level(ranked).join(R.best_route(ranked), "station", "left")
    return out.select("station", "level", "routes", F.coalesce("best.kind", F.lit("")).alias("kind"), F.coalesce("best.priority", F.lit(0)).alias("priority"), F.coalesce("best.value", F.lit("")).alias("value"))


_PAGES = ", ".join(f"('{n}', {p}, {c})" for n, p, c in R.PAGE_ROUTES)
STATION_ROUTES = f"""
WITH kinds(category, priority, confidence) AS (VALUES {_PAGES}),
pages AS (SELECT o_custkey AS station, [{", ".join(f"'{n}'" for n, _, _ in R.PAGE_ROUTES)}][o_orderkey % 7 + 1] AS category, 'u' || o_orderkey AS value, o_orderstatus AS s FROM orders),
r AS (
    SELECT station, 'page_' || category AS kind, priority, confidence, CASE WHEN s = 'F' AND category NOT IN ('about', 'other') THEN 'ACTIONABLE' WHEN s = 'O' THEN 'UNREACHABLE' ELSE 'DISCOVERED' END AS state, value, 2 AS place FROM pages JOIN kinds USING (category)
    UNION ALL SELECT c_custkey, 'submission_url', 1, 90, CASE WHEN c_custkey % 2 = 0 THEN 'ACTIONABLE' ELSE 'DISCOVERED' END, 's' || c_custkey, 0 FROM customer WHERE c_custkey % 11 = 0
    UNION ALL SELECT c_custkey, 'submission_email', 1, 85, CASE WHEN c_custkey % 3 <> 0 THEN 'ACTIONABLE' ELSE 'DISCOVERED' END, 'm@h' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '.test' ELSE '.org' END, 1 FROM customer WHERE c_custkey % 13 = 0
    UNION ALL SELECT c_custkey, 'contact_music_director', 2, 72, CASE WHEN c_custkey % 3 = 1 THEN 'ACTIONABLE' ELSE 'DISCOVERED' END, CASE WHEN c_custkey % 3 = 1 THEN 'a@x' || c_custkey || '.org' ELSE '1' END, 3 FROM customer WHERE c_custkey % 4 = 0 AND (c_custkey % 3 = 1 OR c_custkey % 5 = 0)
    UNION ALL SELECT c_custkey, 'contact_general', 3, 55, 'ACTIONABLE', 'a@x' || c_custkey || '.org', 3 FROM customer WHERE c_custkey % 4 = 1 AND c_custkey % 3 = 1
    UNION ALL SELECT c_custkey, 'contact_host', 4, 35, 'DISCOVERED', NULL, 3 FROM customer WHERE c_custkey % 4 = 2 AND c_custkey % 3 <> 1 AND c_custkey % 5 <> 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY priority, confidence DESC, place, kind, value) AS k FROM r),
best AS (SELECT station, arg_min(kind, k) AS kind, arg_min(priority, k) AS priority, arg_min(value, k) AS value FROM ranked WHERE state = 'ACTIONABLE' AND value IS NOT NULL GROUP BY station)
SELECT station, CASE WHEN bool_or(state = 'ACTIONABLE' AND ranked.priority <= 2) THEN 'ACTIONABLE' WHEN bool_or(state = 'ACTIONABLE') THEN 'LIMITED' ELSE 'INSUFFICIENT_EVIDENCE' END AS level,
    count(*) AS routes, coalesce(any_value(best.kind), '') AS kind, coalesce(any_value(best.priority), 0)::INT AS priority, coalesce(any_value(best.value), '') AS value
FROM ranked LEFT JOIN best USING (station) GROUP BY station
"""


def identity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG13 to MRG15: customers joined by chains of shared fingerprints, merged with the first value of each field."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    keys = F.array(F.concat(F.lit("a"), F.floor(k / 3)), F.when(k % 9 == 2, F.concat(F.lit("b"), F.floor(k / 9))).when(k % 9 == 3, F.concat(F.lit("b"), F.floor(k / 9))))
    rows = c.select(k.alias("id"), F.array_compact(keys).alias("keys"), F.when(k % 3 != 0, F.col("c_name")).alias("name"), F.array("c_mktsegment").alias("genres"))
    merged = D.merge_groups(rows, D.identity_groups(rows.select("id", "keys")), "id", ["name"], ["genres"])
    return merged.select("group", "records", "name", F.array_join("genres", ",").alias("genres"))


IDENTITY_GROUPS = """
WITH g AS (SELECT *, CASE WHEN c_custkey % 9 < 6 THEN c_custkey - c_custkey % 9 ELSE c_custkey - c_custkey % 3 END AS grp FROM customer),
firsts AS (SELECT grp, c_mktsegment, min(c_custkey) AS k FROM g GROUP BY ALL)
SELECT grp AS "group", count(*) AS records, arg_min(c_name, c_custkey) FILTER (c_custkey % 3 <> 0) AS name,
    (SELECT string_agg(c_mktsegment, ',' ORDER BY k) FROM firsts f WHERE f.grp = g.grp) AS genres FROM g GROUP BY grp
"""

def folded_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG14 and MRG15 as a sequential fold: orders of one customer and year, or of one day and priority, merged in order of arrival."""
    o = table(spark, sf_dir, "orders")
    keys = F.array(F.concat(F.lit("website:"), "o_custkey", F.lit("-"), F.year("o_orderdate")), F.concat(F.lit("email:"), F.to_date("o_orderdate").cast("string"), F.lit("-"), "o_orderpriority"))
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ord"), keys.alias("keys"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("place"), F.col("o_orderpriority").alias("role"), F.array("o_orderstatus").alias("formats"))
    groups = D.folded_groups(rows)
    merged = D.merge_groups(rows.drop("group").withColumn("at", F.struct("ord", "id")), groups, "at", ["role"], ["formats"])
    return merged.select("group", "records", "role", F.array_join("formats", ",").alias("formats"))


QUERIES = {"folded_groups": (folded_groups, None), "station_verdicts": (station_verdicts, STATION_VERDICTS), "page_verdicts": (page_verdicts, None), "station_routes": (station_routes, STATION_ROUTES), "identity_groups": (identity_groups, IDENTITY_GROUPS)}
