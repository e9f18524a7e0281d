"""Queries on nested documents: stored JSON decoded, views of contacts, recommendations, whole stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contacts as C
from ..operators import documents as D
from ..operators import records as R
from ..operators import routes as T
from ..operators import views as V
from ..sources import table
from .contacts import _FIRST, _LAST, _ROLES, _names, _pick, _sql_pick
from .records import _STATIONS, _stations

MOST = 200


def decoded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ1: props of events decoded with defaults, some of them missing, broken, or with fields that the type does not have."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 6
    stored = F.when(k == 1, "").when(k == 2, F.substr("props", F.lit(1), F.length("props") - 1)).when(k == 3, F.concat(F.rtrim("props", F.lit("}")), F.lit(', "kind": "'), "event_type", F.lit('", "z": "'), "user_id", F.lit('"}'))).when(k == 4, F.concat(F.lit("["), "props", F.lit("]"))).when(k > 0, F.col("props"))
    tags = F.when(k == 1, F.concat(F.lit('["'), "event_type", F.lit('", "'), "user_id", F.lit('"]'))).when(k == 2, F.concat(F.lit('["'), "event_type"))
    df = D.decoded(e.select("event_id", stored.alias("props"), tags.alias("tags")), {"props": "struct<k:bigint,z:string>", "tags": "array<string>"})
    return df.select("event_id", F.col("props").isNull().alias("other"), F.coalesce("props.k", F.lit(-1)).alias("k"), "props.z", F.to_json("props_more").alias("more"), F.array_join("tags", ",").alias("tags"), F.array_join("_broken", ",").alias("broken"))


DECODED_ROWS = """
WITH e AS (SELECT *, event_id % 6 AS m, json_extract(props, '$.k')::BIGINT AS v FROM events)
SELECT event_id, m = 4 AS other, CASE WHEN m IN (3, 5) THEN v ELSE -1 END AS k, CASE WHEN m = 3 THEN user_id::VARCHAR END AS z, CASE WHEN m = 3 THEN to_json(map {'kind': '"' || event_type || '"'})::VARCHAR ELSE '{}' END AS more,
    CASE WHEN m = 1 THEN event_type || ',' || user_id ELSE '' END AS tags, CASE WHEN m = 2 THEN 'props,tags' ELSE '' END AS broken FROM e
"""


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as contacts of a station (the customer): with and without role, name, address and number."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("k", k * 7 + F.col("o_custkey"))
    mail = F.concat(F.lit("C"), F.col("o_custkey") % 3, F.when(k % 10 == 3, "@x.test").otherwise("@X.org"))
    tel = F.when(k % 2 == 0, F.concat(F.lit("(203) 555-0"), F.lpad(F.col("o_custkey") % 1000, 3, "0"))).otherwise(F.concat(F.lit("555-"), k % 3))
    return o.select(
        F.col("o_custkey").alias("station"), F.concat(F.lit("c"), k).alias("uid"), F.when(F.col("o_orderpriority") != "5-LOW", _pick(_ROLES, "k")).alias("role"), F.when(F.col("o_orderpriority") == "1-URGENT", _names("o_custkey", "o_orderkey")).alias("name"),
        F.when(F.col("o_orderstatus") == "F", mail).alias("email"), F.when(F.col("o_orderstatus") == "O", tel).alias("phone"), F.when(k % 7 > 0, F.concat(F.lit("https://p"), k % 5, F.lit(".org"))).alias("source_url"),
        F.array(F.concat(F.lit("https://q"), k % 2, F.lit(".org"))).alias("sources"), (k % 6 == 0).alias("preferred"), k.alias("ord"),
    )


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages (orders), submissions (customers) and contacts (orders) of stations."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    pages = o.select(F.col("o_custkey").alias("station"), _pick([n for n, _, _ in T.PAGE_ROUTES], "o_orderkey").alias("category"), F.concat(F.lit("https://u.org/"), "o_orderkey").alias("url"), F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("reachable"), F.col("o_orderkey").alias("ord"))
    k = F.col("c_custkey")
    subs = c.select(k.alias("station"), F.when(k % 11 == 0, F.concat(F.lit("https://s.org/"), k)).alias("submission_url"), (k % 2 == 0).alias("verified"), F.when(k % 13 == 0, F.concat(F.lit("m@h"), k, F.when(k % 3 == 0, ".test").otherwise(".org"))).alias("submission_email"))
    return pages, subs.filter("submission_url is not null or submission_email is not null"), _contacts(spark, sf_dir)


_KINDS = lambda names, column: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in names.items()) + " END"
_QUOTED = lambda names, column, other: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '" + v.replace("'", "''") + "'" for k, v in names.items()) + f" ELSE {other} END"
_MUSIC = ", ".join(f"'{r}'" for r in C.DECISION_ROLES)
_PAGES = ", ".join(f"('{n}', {p}, {c})" for n, p, c in T.PAGE_ROUTES)
_PARTS = f"""
kinds(category, priority, confidence) AS (VALUES {_PAGES}),
pages AS (SELECT o_custkey AS station, {_sql_pick([n for n, _, _ in T.PAGE_ROUTES], "o_orderkey")} AS category, 'https://u.org/' || o_orderkey AS url, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS reachable, o_orderkey AS ord FROM orders),
subs AS (SELECT c_custkey AS station, CASE WHEN c_custkey % 11 = 0 THEN 'https://s.org/' || c_custkey END AS submission_url, c_custkey % 2 = 0 AS verified, CASE WHEN c_custkey % 13 = 0 THEN 'm@h' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '.test' ELSE '.org' END END AS submission_email
    FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 13 = 0),
contacts AS (SELECT o_custkey AS station, 'c' || o_orderkey AS uid, CASE WHEN o_orderpriority <> '5-LOW' THEN {_sql_pick(_ROLES, "o_orderkey * 7 + o_custkey")} END AS role,
    CASE WHEN o_orderpriority = '1-URGENT' THEN {_sql_pick(_FIRST, "o_custkey")} || ' ' || {_sql_pick(_LAST, "o_orderkey")} END AS name, CASE WHEN o_orderstatus = 'F' THEN 'C' || o_custkey % 3 || CASE WHEN o_orderkey % 10 = 3 THEN '@x.test' ELSE '@X.org' END END AS email,
    CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN '(203) 555-0' || lpad((o_custkey % 1000)::VARCHAR, 3, '0') ELSE '555-' || o_orderkey % 3 END END AS phone,
    CASE WHEN o_orderkey % 7 > 0 THEN 'https://p' || o_orderkey % 5 || '.org' END AS source_url, 'https://q' || o_orderkey % 2 || '.org' AS other_url, o_orderkey % 6 = 0 AS preferred, o_orderkey AS ord FROM orders),
way AS (SELECT *, coalesce(email, phone) AS v, email LIKE '%.org' AS real, CASE WHEN role IN ({_MUSIC}) AND v IS NOT NULL THEN 2 WHEN role = 'general' AND email IS NOT NULL THEN 3 WHEN role IN ('host', 'dj') AND v IS NULL THEN 4 END AS p FROM contacts),
every AS (SELECT station, 'page_' || category AS kind, priority, confidence, CASE WHEN reachable AND category NOT IN ('about', 'other') THEN 'ACTIONABLE' WHEN NOT reachable THEN 'UNREACHABLE' ELSE 'DISCOVERED' END AS state, url AS value, 2 AS place FROM pages JOIN kinds USING (category)
    UNION ALL SELECT station, 'submission_url', 1, 90, CASE WHEN verified THEN 'ACTIONABLE' ELSE 'DISCOVERED' END, submission_url, 0 FROM subs WHERE submission_url IS NOT NULL
    UNION ALL SELECT station, 'submission_email', 1, 85, CASE WHEN submission_email LIKE '%.org' THEN 'ACTIONABLE' ELSE 'DISCOVERED' END, submission_email, 1 FROM subs WHERE submission_email IS NOT NULL
    UNION ALL SELECT station, 'contact_' || role, p, CASE p WHEN 2 THEN 72 WHEN 3 THEN 55 ELSE 35 END, CASE WHEN p < 4 AND real THEN 'ACTIONABLE' ELSE 'DISCOVERED' END, v, 3 FROM way WHERE p IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY priority, confidence DESC, place, kind, value NULLS LAST) AS k,
    {{'kind': kind, 'priority': priority, 'confidence': confidence, 'state': state, 'value': value}} AS route, state = 'ACTIONABLE' AND value IS NOT NULL AS acts FROM every),
nth AS (SELECT *, CASE WHEN value IS NOT NULL THEN count(value) OVER (PARTITION BY station ORDER BY k) END AS n FROM ranked),
found AS (SELECT station, arg_min(route, k) FILTER (acts) AS route, min(k) FILTER (acts) AS acts_at, arg_min(route, k) AS whatever, arg_min(route, k) FILTER (n = 1) AS one, min(k) FILTER (n = 1) AS one_at, arg_min(route, k) FILTER (n = 2) AS two,
    count(*) AS routes, bool_or(priority = 1) AS direct, bool_or(state = 'ACTIONABLE') AS sure, bool_or(state = 'ACTIONABLE' AND priority <= 2) AS first_class FROM nth GROUP BY station),
{_STATIONS.strip()},
recommended AS (SELECT c_custkey AS station, route, CASE route.priority {" ".join(f"WHEN {k} THEN '{t}'" for k, t in C.WHY.items())} ELSE '{C.NO_ROUTE}' END AS why,
    CASE WHEN route.confidence >= 80 THEN 'High' WHEN route.confidence >= 50 THEN 'Medium' WHEN route IS NOT NULL THEN 'Low' ELSE 'Unknown' END AS sure,
    CASE WHEN route IS NOT NULL THEN {_QUOTED({**D.EVIDENCE, **{f"page_{r[0]}": r[3] for r in V.PAGE_SEMANTICS}}, "route.kind", "'Listed as ' || replace(route.kind[9:], '_', ' ') || ' on the station site.'")} END AS evidence,
    CASE WHEN acts_at IS NULL THEN whatever WHEN one_at <> acts_at THEN one ELSE coalesce(two, whatever) END AS fallback,
    list_filter([CASE WHEN city IS NULL THEN '{D.UNKNOWN[0]}' END, CASE WHEN direct IS NOT true THEN '{D.UNKNOWN[1]}' END, CASE WHEN c_custkey NOT IN (SELECT station FROM contacts WHERE role IN ({_MUSIC}) AND email IS NOT NULL) THEN '{D.UNKNOWN[2]}' END,
        CASE WHEN f.sure IS NOT true AND c_custkey NOT IN (SELECT station FROM pages WHERE reachable) THEN '{D.UNKNOWN[3]}' END], lambda x: x IS NOT NULL) AS unknown, coalesce(routes, 0) AS routes FROM stations LEFT JOIN found f ON f.station = c_custkey)
"""


def recommended_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS11: the best route of each station, why, what shows it, what to fall back to and what is not known."""
    pages, subs, contacts = _parts(spark, sf_dir)
    stations = _stations(spark, sf_dir).select(F.col("c_custkey").alias("station"), "city", "market_area")
    df = D.recommended(stations, T.routes(pages, subs, contacts), pages, contacts)
    return df.select("station", "route.kind", "route.value", "why", "sure", "evidence", F.col("fallback.kind").alias("fallback_kind"), F.col("fallback.value").alias("fallback_value"), F.array_join("unknown", "; ").alias("unknown"), "routes")


RECOMMENDED_ROUTES = f"""
WITH {_PARTS} SELECT station, route.kind AS kind, route.value AS value, why, sure, evidence, fallback.kind AS fallback_kind, fallback.value AS fallback_value, array_to_string(unknown, '; ') AS unknown, routes FROM recommended
"""

_VIEWS = f"""
a AS (SELECT *, coalesce(role, 'unknown') <> 'unknown' AS has_role, CASE WHEN email IS NOT NULL THEN 'email' WHEN phone IS NOT NULL THEN 'phone' END AS method, v AS value_raw,
    CASE WHEN email IS NOT NULL THEN lower(email) WHEN phone LIKE '(%' THEN '+1' || regexp_replace(phone, '[^0-9]', '', 'g') ELSE phone END AS value_normalized FROM way),
b AS (SELECT *, CASE WHEN name IS NOT NULL THEN 'named' WHEN has_role THEN 'role_based' ELSE 'unattributed_observation' END AS identity_state, CASE WHEN name IS NULL AND NOT has_role AND method IS NOT NULL THEN method || ' ' || value_normalized ELSE ord::VARCHAR END AS g,
    least(100, greatest(CASE WHEN role IN ({_MUSIC}) THEN 80 WHEN role IN ('host', 'dj') THEN 50 WHEN role = 'general' THEN 30 ELSE 0 END, CASE WHEN preferred THEN 90 ELSE 0 END) + CASE WHEN name IS NOT NULL THEN 5 ELSE 0 END)::INT AS relevance FROM a),
u AS (SELECT station, g, u, min((ord, place)) AS seen FROM (SELECT station, g, ord, 1 AS place, source_url AS u FROM b UNION ALL SELECT station, g, ord, 2, other_url FROM b) WHERE u IS NOT NULL GROUP BY ALL),
us AS (SELECT station, g, list(u ORDER BY seen) AS sources FROM u GROUP BY ALL),
lead AS (SELECT station, g, min(ord) AS ord, count(*) AS observations FROM b GROUP BY ALL),
fall AS (SELECT station, min_by(value, (level, k)) AS value, min(level) AS level FROM (SELECT *, {_KINDS(V.FALLBACK_LEVELS, "kind")} AS level FROM ranked WHERE acts) WHERE level IS NOT NULL GROUP BY station),
views AS (SELECT station, ord, uid, name, role, method, value_raw, value_normalized, identity_state, observations, CASE method WHEN 'email' THEN 'VERIFIED' WHEN 'phone' THEN 'EVIDENCE-BACKED' ELSE 'DISCOVERED' END AS evidence_state,
    CASE WHEN has_role THEN replace(role, '_', ' ') || ' - role label on station website' WHEN name IS NOT NULL THEN 'named contact from station website' ELSE 'observed contact from station website' END AS role_reason, sources,
    {_QUOTED(C.ROUTE_CLASSES, "role", "'UNKNOWN_ROLE'")} AS route_class, relevance, CASE WHEN relevance >= 75 THEN 'High' WHEN relevance >= 45 THEN 'Medium' ELSE 'Low' END AS relevance_label, preferred,
    CASE WHEN real THEN 1 ELSE fall.level END::INT AS route_level, CASE WHEN real THEN 'mailto:' || email ELSE fall.value END AS route_value, route_value IS NOT NULL AS can_add_to_campaign
    FROM lead JOIN b USING (station, g, ord) JOIN us USING (station, g) LEFT JOIN fall USING (station))
"""


def contact_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS8 and AGG14: contacts as a reader sees them, repeated sightings of one value without name and role as one."""
    pages, subs, contacts = _parts(spark, sf_dir)
    df = D.contact_views(contacts.repartition("station"), T.routes(pages, subs, contacts))
    return df.withColumns({"sources": F.array_join("sources", ","), "route_level": F.coalesce("route_level", F.lit(0))}).select("station", *D.CONTACT_FIELDS)


CONTACT_VIEWS = f"WITH {_PARTS}, {_VIEWS} SELECT station, {', '.join(D.CONTACT_FIELDS)} FROM (SELECT * REPLACE (array_to_string(sources, ',') AS sources, coalesce(route_level, 0) AS route_level) FROM views)"


def station_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ10, PRJ11, PRJ12, PRJ13 and SRT5: stations with facts, contacts, pages, routes, recommendation and gaps, as JSON."""
    pages, subs, contacts = _parts(spark, sf_dir)
    stations, ranked = R.normal_record(_stations(spark, sf_dir)).withColumnRenamed("c_custkey", "station"), T.routes(pages, subs, contacts)
    fact = lambda kind: contacts.filter(F.col(kind).isNotNull()).select("station", F.lit(kind).alias("kind"), F.col(kind).alias("value"), "source_url")
    facts, sent = fact("email").unionByName(fact("phone")).distinct(), subs.select("station", "submission_url", "submission_email")
    actions = C.best_actions(stations.select("station", F.lit(True).alias("investigated")), pages, sent, contacts.select("station", "role", "email", "phone"))
    df = D.station_documents(stations, facts, contacts.repartition("station"), sent, pages, ranked, actions, T.intelligence_level(ranked), MOST)
    return df.select("station", F.to_json("document", {"ignoreNullFields": "false"}).alias("document"))


_RANK = _KINDS({r: k for k, r in enumerate(C.DECISION_ROLES)}, "role")
_LIST = lambda rows, fields, order: f"(SELECT station, list({{{', '.join(f"'{f}': {f}" for f in fields)}}} ORDER BY {order})[:{MOST}] AS l, count(*) AS n FROM {rows} GROUP BY station)"
_PAGE = ", ".join("('" + "', '".join(x.replace("'", "''") for x in (r[0], r[2], r[1], r[4])) + "')" for r in V.PAGE_SEMANTICS)
STATION_DOCUMENTS = f"""
WITH {_PARTS}, {_VIEWS},
facts AS (SELECT DISTINCT station, 'email' AS kind, email AS value, source_url FROM contacts WHERE email IS NOT NULL UNION ALL SELECT DISTINCT station, 'phone', phone, source_url FROM contacts WHERE phone IS NOT NULL),
shown(category, kind, route_class, actionability) AS (VALUES {_PAGE}),
pv AS (SELECT station, ord, category, url, CASE WHEN reachable THEN 'VERIFIED' ELSE 'DISCOVERED' END AS evidence_state, CASE WHEN reachable THEN 'verified reachable' WHEN reachable IS NULL THEN 'discovered link; reachability not yet confirmed'
    ELSE 'discovered link; currently unreachable' END AS evidence_note, kind, route_class, actionability FROM pages JOIN shown USING (category)),
pg AS (SELECT station, min_by(url, (CASE WHEN reachable THEN 0 ELSE 1 END, url)) FILTER (category IN ('send_music', 'submission_guidelines')) AS send, min_by(url, ord) FILTER (category = 'contact') AS contact,
    min_by(url, ord) FILTER (category IN ('dj_directory', 'programming')) AS shows FROM pages GROUP BY station),
who AS (SELECT * FROM (SELECT station, role, email, phone, {_RANK} AS rank FROM contacts) WHERE rank IS NOT NULL AND coalesce(email, phone) IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY station ORDER BY rank, email NULLS FIRST, phone NULLS FIRST) = 1),
d AS (SELECT c_custkey AS station, coalesce(submission_url, send, 'mailto:' || submission_email) AS direct, contact, shows, role, email FROM stations s LEFT JOIN pg ON pg.station = c_custkey LEFT JOIN subs ON subs.station = c_custkey LEFT JOIN who ON who.station = c_custkey),
act AS (SELECT station, {{'status': CASE WHEN direct IS NOT NULL THEN 'DIRECT_SUBMISSION' WHEN role IS NOT NULL OR contact IS NOT NULL THEN 'CONTACT_FOR_SUBMISSION' WHEN shows IS NOT NULL THEN 'SHOW_SPECIFIC_OPPORTUNITY' ELSE 'NO_PUBLIC_SUBMISSION_ROUTE_FOUND' END,
    'kind': CASE WHEN direct IS NOT NULL THEN 'submit' WHEN role IS NOT NULL THEN 'contact' WHEN contact IS NOT NULL OR shows IS NOT NULL THEN 'browse' ELSE 'none' END,
    'url': CASE WHEN direct IS NOT NULL THEN direct WHEN role IS NOT NULL THEN 'mailto:' || email WHEN contact IS NOT NULL THEN contact ELSE shows END,
    'label': CASE WHEN direct IS NOT NULL THEN 'Send music' WHEN role IS NOT NULL AND email IS NOT NULL THEN 'Contact ' || CASE role WHEN 'music_director' THEN 'music director' WHEN 'program_director' THEN 'program director' ELSE 'music department' END
        WHEN role IS NOT NULL THEN 'Call music ' || CASE role WHEN 'music_director' THEN 'director' ELSE 'department' END WHEN contact IS NOT NULL THEN 'Contact station' WHEN shows IS NOT NULL THEN 'Browse station DJs & programming' ELSE 'No public submission route found' END}} AS best FROM d),
j AS (SELECT s.*, f.first_class, f.sure AS acting, submission_url, submission_email, subs.station IS NOT NULL AS sub, best, r.route, r.why, r.sure, r.evidence, r.fallback, r.unknown, r.routes, c.n AS stored,
    {", ".join(f"coalesce({x}.l, []) AS {x}_l, coalesce({x}.n, 0) AS {x}_n" for x in ("em", "ph", "vw", "pc", "rt", "up"))}
    FROM stations s LEFT JOIN found f ON f.station = c_custkey LEFT JOIN subs ON subs.station = c_custkey JOIN act ON act.station = c_custkey JOIN recommended r ON r.station = c_custkey LEFT JOIN (SELECT station, count(*) AS n FROM contacts GROUP BY 1) c ON c.station = c_custkey
    LEFT JOIN {_LIST("(FROM facts WHERE kind = 'email')", ["value", "source_url"], "value, source_url NULLS FIRST")} em ON em.station = c_custkey
    LEFT JOIN {_LIST("(FROM facts WHERE kind = 'phone')", ["value", "source_url"], "value, source_url NULLS FIRST")} ph ON ph.station = c_custkey
    LEFT JOIN {_LIST("views", D.CONTACT_FIELDS, "ord")} vw ON vw.station = c_custkey LEFT JOIN {_LIST("(FROM contacts WHERE preferred)", ["uid", "role", "email"], "ord")} pc ON pc.station = c_custkey
    LEFT JOIN {_LIST("ranked", D.ROUTE, "k")} rt ON rt.station = c_custkey LEFT JOIN {_LIST("pv", D.PAGE_FIELDS, "ord")} up ON up.station = c_custkey)
SELECT c_custkey AS station, to_json({{'station': {{'identity_key': identity_key, 'name': name, 'domain': host, 'country': country, 'city': city, 'location_status': CASE WHEN country IS NULL AND city IS NULL THEN 'unavailable' ELSE 'unverified' END}},
    'intelligence_level': CASE WHEN first_class THEN 'ACTIONABLE' WHEN acting THEN 'LIMITED' ELSE 'INSUFFICIENT_EVIDENCE' END, 'emails': em_l, 'phone_numbers': ph_l, 'contacts': vw_l, 'preferred_contacts': pc_l, 'outreach_routes': rt_l, 'useful_pages': up_l,
    'submission': CASE WHEN sub THEN {{'submission_url': submission_url, 'submission_email': submission_email}} END, 'best_action': best,
    'recommendation': {{'route': route, 'why': why, 'sure': sure, 'evidence': evidence, 'fallback': fallback, 'unknown': unknown, 'routes': routes}},
    'counts': {{'emails': em_n, 'phone_numbers': ph_n, 'contacts': vw_n, 'preferred_contacts': pc_n, 'outreach_routes': rt_n, 'useful_pages': up_n}},
    'epistemology': {{'facts_count': em_n + ph_n + coalesce(stored, 0), 'unknown_fields': list_sort(list_filter([CASE WHEN NOT has_site THEN 'website' END, CASE WHEN NOT has_site THEN 'domain' END, CASE WHEN country IS NULL AND city IS NULL THEN 'country' END,
        CASE WHEN city IS NULL THEN 'state_or_region' END, CASE WHEN city IS NULL THEN 'city' END, 'market_area', CASE WHEN NOT described THEN 'description' END, 'last_verified_at', CASE WHEN coalesce(station_type, 'unknown') = 'unknown' THEN 'station_type' END,
        CASE WHEN em_n = 0 THEN 'emails' END, CASE WHEN stored IS NULL THEN 'contacts' END, CASE WHEN NOT sub THEN 'submission' END, CASE WHEN sub AND submission_email IS NULL THEN 'submission.submission_email' END], lambda x: x IS NOT NULL))}}}})::VARCHAR AS document FROM j
"""

QUERIES = {
    "decoded_rows": (decoded_rows, DECODED_ROWS), "recommended_routes": (recommended_routes, RECOMMENDED_ROUTES), "contact_views": (contact_views, CONTACT_VIEWS), "station_documents": (station_documents, STATION_DOCUMENTS),
}
