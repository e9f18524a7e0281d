"""Queries that merge stored and incoming records, and keep latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..operators import merge as M
from ..operators.dedupe import fresh_folder
from ..sources import table

_CUT = "1996-01-01"


def _snapshot(spark: SparkSession, sf_dir: str, incoming: bool) -> DataFrame:
    """A customer's record as the orders before or from a day leave it."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= _CUT if incoming else F.col("o_orderdate") < _CUT)
    tags = F.array_sort(F.collect_set("o_orderpriority"))
    total = F.struct("o_totalprice", "o_orderkey")
    return o.groupBy(F.col("o_custkey").alias("key")).agg(
        F.max_by("o_orderpriority", total).alias("name"), F.max_by("o_orderstatus", total).alias("status"), F.min("o_orderdate").alias("discovered_at"), F.max("o_orderdate").alias("observed_at"), tags.alias("tags"),
    )


def stored_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG4, MRG5 and JON11: incoming records merged into stored ones under a policy for each column."""
    policy = {"name": "fill", "status": "newest", "discovered_at": "min", "observed_at": "max", "tags": "list"}
    out = M.merge_stored(_snapshot(spark, sf_dir, False), _snapshot(spark, sf_dir, True), "key", policy)
    return out.withColumn("tags", F.array_join("tags", "|"))


_SNAPSHOT = """SELECT o_custkey AS key, arg_max(o_orderpriority, (o_totalprice, o_orderkey)) AS name, arg_max(o_orderstatus, (o_totalprice, o_orderkey)) AS status,
    min(o_orderdate) AS discovered_at, max(o_orderdate) AS observed_at, list_sort(list(DISTINCT o_orderpriority)) AS tags FROM orders WHERE o_orderdate {} TIMESTAMP '1996-01-01' GROUP BY o_custkey"""
STORED_MERGE = f"""
WITH o AS ({_SNAPSHOT.format("<")}), n AS ({_SNAPSHOT.format(">=")})
SELECT coalesce(o.key, n.key) AS key, coalesce(o.name, n.name) AS name, coalesce(n.status, o.status) AS status, least(o.discovered_at, n.discovered_at) AS discovered_at,
    greatest(o.observed_at, n.observed_at) AS observed_at,
    array_to_string(list_concat(coalesce(o.tags, []), list_filter(coalesce(n.tags, []), lambda x: NOT list_contains(coalesce(o.tags, []), x))), '|') AS tags
FROM o FULL JOIN n ON o.key = n.key
"""


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN1, WIN10, MRG8 and STR3: the last event of each user and type."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return M.latest_per_key(e, ["user_id", "event_type"], F.col("ts"), F.col("event_id"))


LATEST_EVENTS = "SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"


def replaced_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG7, MRG10, JON5 and MRG11: an order's stored lines give way to incoming ones where it has any."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    stored, incoming = lines.filter(F.col("l_shipdate") < _CUT), lines.filter(F.col("l_shipdate") >= _CUT)
    return M.replace_children(stored, incoming, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))


REPLACED_CHILDREN = """
WITH incoming AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01'),
kept AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_orderkey NOT IN (SELECT l_orderkey FROM incoming) UNION ALL SELECT * FROM incoming)
SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity FROM kept GROUP BY l_orderkey
"""


def contact_uids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact identity: a content hash over six fields."""
    c = table(spark, sf_dir, "customer")
    parts = [F.col("c_custkey"), F.col("c_name"), F.lit(None), F.col("c_mktsegment"), F.col("c_nationkey"), F.lit("")]
    return c.select("c_custkey", M.contact_uid(*parts).alias("uid"))


CONTACT_UIDS = "SELECT c_custkey, sha256(c_custkey || chr(31) || c_name || chr(31) || '' || chr(31) || c_mktsegment || chr(31) || c_nationkey || chr(31) || '')[1:32] AS uid FROM customer"


def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG1 and MRG2: records under one identity, by website or by name and place; each third supplier has no website."""
    s = table(spark, sf_dir, "supplier")
    site = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("http://www.shop"), F.col("s_nationkey"), F.lit(".co.uk/"), F.col("s_suppkey")))
    keyed = s.select("s_suppkey", M.identity_key(site, F.col("s_name"), F.col("s_nationkey").cast("string"), F.lit(None).cast("string")).alias("key"))
    return keyed.groupBy("key").agg(F.count("*").alias("records"), F.min("s_suppkey").alias("first"))


IDENTITY_KEYS = """
WITH keyed AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN 'domain:shop' || s_nationkey || '.co.uk'
    ELSE 'namegeo:' || trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') || '-' || s_nationkey || '-' END AS key FROM supplier)
SELECT key, count(*) AS records, min(s_suppkey) AS first FROM keyed GROUP BY key
"""


def matched_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG13, MRG17, JON12 and SET2: suppliers matched to the first customer with a fingerprint in common."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")

    def keys(nation: str, key: str):
        site = F.concat(F.lit("https://n"), F.col(nation), F.lit("-"), F.pmod(F.col(key), F.lit(40)), F.lit(".org"))
        mail = F.concat(F.lit("Box"), F.pmod(F.col(key), F.lit(700)), F.lit("@x.org"))
        return M.fingerprints(site, mail, F.lit("name"), F.col(nation).cast("string"), F.lit(None).cast("string"))

    incoming = s.select(F.col("s_suppkey").alias("id"), keys("s_nationkey", "s_suppkey").alias("keys"))
    stored = c.select(F.col("c_custkey").alias("stored_id"), F.col("c_custkey").alias("rank"), keys("c_nationkey", "c_custkey").alias("keys"))
    return M.match_stored(incoming, stored)


MATCHED_RECORDS = """
SELECT s_suppkey AS id, min(c_custkey) AS stored_id FROM supplier, customer
WHERE (s_nationkey = c_nationkey AND s_suppkey % 40 = c_custkey % 40) OR s_suppkey % 700 = c_custkey % 700 GROUP BY s_suppkey
"""


def text_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG2 and MRG16 on documents: copies by normalised text, the first kept, sources united in order."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.lower(F.regexp_replace("text", r"\s+", " ")), 256).alias("key"))
    rows = F.array_sort(F.collect_list(F.struct("doc_id", "source")))
    out = d.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.array_distinct(F.transform(rows, lambda r: r["source"])).alias("sources"))
    return out.filter("copies > 1").select("first", "copies", F.array_join("sources", ",").alias("sources"))


TEXT_COPIES = r"""
WITH keyed AS (SELECT doc_id, source, lower(regexp_replace(text, '\s+', ' ', 'g')) AS key FROM documents),
firsts AS (SELECT key, source, min(doc_id) AS place FROM keyed GROUP BY key, source),
groups AS (SELECT key, min(doc_id) AS first, count(*) AS copies FROM keyed GROUP BY key HAVING count(*) > 1)
SELECT first, copies, string_agg(source, ',' ORDER BY place) AS sources FROM groups JOIN firsts USING (key) GROUP BY first, copies
"""


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG19 and AGG17: orders by the rules that they break."""
    o = table(spark, sf_dir, "orders")
    rules = {"price": F.col("o_totalprice") > 50000, "status": F.col("o_orderstatus").isin("F", "O"), "priority": ~F.col("o_orderpriority").startswith("5")}
    good, bad = M.split_valid(o, rules)
    counts = bad.groupBy(F.array_join("failed", ",").alias("failed")).agg(F.count("*").alias("n"))
    return counts.unionByName(good.agg(F.lit("").alias("failed"), F.count("*").alias("n")))


QUARANTINE = """
SELECT concat_ws(',', CASE WHEN NOT o_totalprice > 50000 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END,
    CASE WHEN o_orderpriority LIKE '5%' THEN 'priority' END) AS failed, count(*) AS n FROM orders GROUP BY 1
"""

def ingested_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1, MRG7, MRG8 and SNK6: orders as records of the stations of their customers, ingested in two batches of which one is sent again; the stored tables by station."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c.hint("merge"), F.col("o_custkey") == F.col("c_custkey"))  # customers grow, and each join of a commit would send them through the driver
    none = lambda kind: F.lit(None).cast(kind)
    day, status = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderstatus")
    columns = {
        "position": F.col("o_orderkey"), "name": F.when(F.col("o_orderkey") % 7 != 0, F.col("c_name")), "organization_type": none("string"), "website": F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("https://www.c"), "o_custkey", F.lit(".org/"))),
        "country": none("string"), "state_or_region": none("string"), "city": F.when(status == "F", F.col("o_orderpriority")), "status": status, "confidence_score": none("double"), "genres": F.array("o_orderpriority"), "source_urls": F.array().cast("array<string>"),
        "social_urls": none("map<string,string>"), "discovered_at": day, "last_observed_at": day, "emails": F.array(F.struct(F.lower(status).alias("value"), day.alias("source_url"))), "phone_numbers": none("array<struct<value:string,source_url:string>>"),
        "contacts": F.when(status != "P", F.array(F.struct(F.col("o_orderpriority").alias("name"), status.alias("role"), none("string").alias("email"), none("string").alias("phone"), day.alias("source_url"), F.array(day).alias("provenance")))),
        "submission": F.when(status == "O", F.create_map(F.lit("day"), day)), "fetches": F.array(F.struct(day.alias("url"), F.lit(True).alias("ok"), F.lit(200).alias("status"))),
    }
    records = rows.select(*[x.alias(n) for n, x in columns.items()])
    store = ingest.station_store(spark, fresh_folder(spark, "stations"), 16)
    early = F.col("discovered_at") < "1999-01-01"
    for name, batch in (("early", records.filter(early)), ("late", records.filter(~early)), ("early", records.filter(early))):
        ingest.ingest(store, name, batch, "orders", name)
    s, people = store.read("stations"), store.read("contacts").groupBy("station").agg(F.count("*").alias("contacts"), F.max("first_stored_at").alias("contact_since"), F.max(F.size("provenance")).alias("provenance"))
    facts, paths = store.read("facts").groupBy("station").agg(F.count("*").alias("facts"), F.max("source_url").alias("fact_at")), store.read("submissions").select("station", F.col("payload")["day"].alias("submission"))
    out = s
    for part in (people, facts, paths, store.read("fetches").select("station", F.col("url").alias("fetch_url"))):
        out = out.join(part.hint("merge"), "station", "left")
    return out.select("station", "name", "city", "status", F.array_join("genres", ",").alias("genres"), "discovered_at", "last_observed_at", "first_stored_at", "last_stored_at", F.coalesce("contacts", F.lit(0)).alias("contacts"), "contact_since", F.coalesce("provenance", F.lit(0)).alias("provenance"), "facts", "fact_at", "submission", "fetch_url")


INGESTED_TABLES = """
WITH r AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 1 ELSE 2 END AS b,
    CASE WHEN o_custkey % 2 = 0 THEN 'domain:c' || o_custkey || '.org' ELSE 'namegeo:' || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') || '--' END AS station
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 7 <> 0),
s AS (SELECT station, arg_min(c_name, (b, o_orderkey)) AS name, arg_min(o_orderpriority, (b, o_orderkey)) FILTER (o_orderstatus = 'F') AS city, arg_max(o_orderstatus, (b, o_orderkey)) AS status,
    min(day) AS discovered_at, max(day) AS last_observed_at, CASE WHEN min(b) = 1 THEN 'early' ELSE 'late' END AS first_stored_at, CASE WHEN max(b) = 1 THEN 'early' ELSE 'late' END AS last_stored_at,
    arg_max(day, (b, o_orderkey)) FILTER (o_orderstatus = 'O') AS submission, arg_max(day, (b, o_orderkey)) AS fetch_url FROM r GROUP BY station),
g AS (SELECT station, string_agg(o_orderpriority, ',' ORDER BY b, k) AS genres FROM (SELECT station, o_orderpriority, arg_min(b, (b, o_orderkey)) AS b, arg_min(o_orderkey, (b, o_orderkey)) AS k FROM r GROUP BY ALL) GROUP BY station),
f AS (SELECT station, count(*) AS facts, max(d) AS fact_at FROM (SELECT station, o_orderstatus, arg_max(day, (b, o_orderkey)) AS d FROM r GROUP BY ALL) GROUP BY station),
last AS (SELECT station, b, arg_max((o_orderpriority, o_orderstatus, day), o_orderkey) AS c FROM r WHERE o_orderstatus <> 'P' GROUP BY station, b),
people AS (SELECT n.station, 1 AS contacts, CASE WHEN n.b = 1 OR p.c[1] = n.c[1] AND p.c[2] = n.c[2] THEN 'early' ELSE 'late' END AS contact_since,
    CASE WHEN n.b = 2 AND p.c[1] = n.c[1] AND p.c[2] = n.c[2] AND p.c[3] <> n.c[3] THEN 2 ELSE 1 END AS provenance
    FROM (SELECT * FROM last QUALIFY row_number() OVER (PARTITION BY station ORDER BY b DESC) = 1) n LEFT JOIN (SELECT * FROM last WHERE b = 1) p ON p.station = n.station)
SELECT station, name, city, status, genres, discovered_at, last_observed_at, first_stored_at, last_stored_at, coalesce(contacts, 0)::BIGINT AS contacts, contact_since, coalesce(provenance, 0)::INT AS provenance, facts, fact_at, submission, fetch_url
FROM s JOIN g USING (station) LEFT JOIN people USING (station) LEFT JOIN f USING (station)
"""

def merged_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG6: provenance of line items, stored and incoming, as JSON whose keys come in two orders."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct()  # provenance follows from these
    a, b = F.col("l_linenumber").cast("string"), F.pmod("l_suppkey", F.lit(5)).cast("string")
    one, two = F.concat(F.lit('{"line":'), a, F.lit(',"of":{"s":'), b, F.lit(',"q":1}}')), F.concat(F.lit('{ "of": {"q":1, "s":'), b, F.lit('}, "line":'), a, F.lit("}"))
    old = F.when(F.col("l_linenumber") != 2, F.array(one, F.lit("no json")))
    new = F.array(two, F.lit("no json"), one, F.concat(F.lit('{"line":'), F.lit(1), F.lit(',"of":{"s":'), b, F.lit(',"q":1}}')))
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", F.array_join(M.merge_json(old, new), ";").alias("provenance"))


MERGED_PROVENANCE = """
WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, '{"line":' || l_linenumber || ',"of":{"s":' || l_suppkey % 5 || ',"q":1}}' AS one,
    '{ "of": {"q":1, "s":' || l_suppkey % 5 || '}, "line":' || l_linenumber || '}' AS two, '{"line":1,"of":{"s":' || l_suppkey % 5 || ',"q":1}}' AS first FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber <> 2 THEN one ELSE two END || ';no json' || CASE WHEN l_linenumber = 1 THEN '' ELSE ';' || first END AS provenance FROM x
"""

QUERIES = {
    "merged_provenance": (merged_provenance, MERGED_PROVENANCE), "ingested_tables": (ingested_tables, INGESTED_TABLES), "stored_merge": (stored_merge, STORED_MERGE), "latest_events": (latest_events, LATEST_EVENTS), "replaced_children": (replaced_children, REPLACED_CHILDREN),
    "contact_uids": (contact_uids, CONTACT_UIDS), "identity_keys": (identity_keys, IDENTITY_KEYS), "matched_records": (matched_records, MATCHED_RECORDS),
    "text_copies": (text_copies, TEXT_COPIES), "quarantine": (quarantine, QUARANTINE),
}
