"""Queries on contacts, pages and next steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import people, url
from ..functions.text import mailto_addresses
from ..operators import contact_fold
from ..operators import contacts as C
from ..sources import table

_PATHS = ["/email.php", "/contact/", "/log-in", "/shows/flashplayer.php", "/djs/ann-lee", "/djs/", "/about", "/Submit_Music", "/staff/", "/on-air/people/bob", "/how-to-submit", "/x.y/schedule/"]
_QUERIES = ["", "?id=4", "?a=1", "?episode=9", "?q=music", "?type=program"]
_LABELS = ["", "Send us your music", "Our DJs", "Contact us", "About us", "Programming", "Team", "Guidelines"]


def _pick(names: list[str], key: str):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(F.col(key), F.lit(len(names))) + 1).cast("int"))


def _sql_pick(names: list[str], key: str) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + f"][({key}) % {len(names)} + 1]"


def url_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL6, URL11, URL13, URL21, HTM3 and FLT20: what addresses and labels say about their pages."""
    p = table(spark, sf_dir, "part").withColumn("k", F.floor(F.col("p_partkey") / len(_PATHS)).cast("long")).withColumn("m", F.col("p_partkey") + F.col("p_size"))
    link = F.concat(F.lit("HTTPS://WWW."), F.lower("p_brand"), F.lit(".org:8080"), _pick(_PATHS, "p_partkey"), _pick(_QUERIES, "k"))
    df = p.select("p_partkey", F.replace(link, F.lit("#"), F.lit("-")).alias("url"), _pick(_LABELS, "m").alias("label"))
    return df.select("p_partkey", url.person_form(F.col("url")).alias("person_form"), url.auth_or_chrome(F.col("url")).alias("auth"), url.player_page(F.col("url")).alias("player"), url.person_profile(F.col("url")).alias("profile"), url.page_address(F.col("url")).alias("address"), url.page_category(F.col("label"), F.col("url")).alias("category"))


_PATH_SQL, _QUERY_SQL = _sql_pick(_PATHS, "p_partkey"), _sql_pick(_QUERIES, f"p_partkey // {len(_PATHS)}")
_PARAM = lambda names: "regexp_matches(q, '(?:" + "|".join(names) + ")=')"
URL_CLASSES = f"""
WITH u AS (SELECT p_partkey, replace(lower(p_brand), '#', '-') AS brand, {_PATH_SQL} AS path, lower({_QUERY_SQL}) AS q, {_sql_pick(_LABELS, "p_partkey + p_size")} AS label FROM part),
t AS (SELECT *, lower(path) AS lp, trim(lower(label || ' https://www.' || brand || '.org:8080' || path || q)) AS text FROM u)
SELECT p_partkey, regexp_matches(lp, '{url.PERSON_FORM}') AND {_PARAM(url.PERSON_PARAMS)} AS person_form, regexp_matches(lp, '{url.AUTH_PATH}') OR regexp_matches(substr(q, 2), '{url.AUTH_QUERY}') AS auth,
    regexp_matches(lp, '{url.PLAYER_PATH}') OR {_PARAM(url.PLAYER_PARAMS)} AS player, regexp_matches(path, '(?i){url.PEOPLE_PATH}/*[^/]') AS profile,
    'https://www.' || brand || '.org:8080' || regexp_replace(path, '/+$', '') AS address,
    CASE {" ".join("WHEN regexp_matches(text, '" + p.replace("'", "''") + f"') THEN '{n}'" for n, p in url.PAGE_CATEGORIES)} ELSE 'other' END AS category FROM t
"""


def page_address_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL21 over the crawled pages: pages of one address, whatever their query."""
    return table(spark, sf_dir, "pages").groupBy(url.page_address(F.col("url")).alias("address")).agg(F.count("*").alias("n"))


PAGE_ADDRESS_COUNTS = "SELECT lower(regexp_extract(url, '^([^:]+://[^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS address, count(*) AS n FROM pages GROUP BY 1"


def booking_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL19: the first link on booking of each customer's orders."""
    path = F.when(F.col("o_orderpriority") == "1-URGENT", "/press-kit").when(F.col("o_orderstatus") == "P", "/Bookings").otherwise("/about?book=1")
    o = table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderkey", F.concat(F.lit("https://x.org"), path, F.lit("#"), "o_orderkey").alias("u")).alias("x"))
    links = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return links.select("o_custkey", url.booking_link(F.transform("xs", lambda x: x["u"])).alias("link"))


BOOKING_LINKS = """
SELECT o_custkey, 'https://x.org' || arg_min(CASE WHEN o_orderpriority = '1-URGENT' THEN '/press-kit' ELSE '/Bookings' END || '#' || o_orderkey, o_orderkey) FILTER (o_orderpriority = '1-URGENT' OR o_orderstatus = 'P') AS link
FROM orders GROUP BY o_custkey
"""


def mail_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT3 and URL22: addresses of mailto values, and a link that opens a message."""
    c = table(spark, sf_dir, "customer")
    user = F.concat(F.lit("User"), F.pmod("c_custkey", F.lit(50)))
    values = F.array(F.concat(user, F.lit("@Shop.example.org?subject=Hi")), F.concat(F.lower(user), F.lit("@shop.example.org")), F.lit("nobody"), F.concat(F.lit("b"), F.col("c_nationkey"), F.lit("@x.org")))
    return c.select("c_custkey", F.array_join(mailto_addresses(values), ",").alias("addresses"), F.concat(F.lit("mailto:?subject="), url.quoted(F.concat_ws(" & ", "c_name", "c_mktsegment"))).alias("link"))


MAIL_LINKS = """
SELECT c_custkey, 'user' || c_custkey % 50 || '@shop.example.org,b' || c_nationkey || '@x.org' AS addresses, 'mailto:?subject=' || url_encode(c_name || ' & ' || c_mktsegment) AS link FROM customer
"""

_FIRST, _LAST = ["Ann", "Bob", "Eve", "Joe", "Kim", "Leo", "Mia"], ["Lee", "Ray", "Stone", "Records", "Hill"]


def _names(key: str, other: str):
    return F.concat_ws(" ", _pick(_FIRST, key), _pick(_LAST, other))


def contact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT13, TXT17 and TXT10: names beside roles and the market claimed, from texts made of customers."""
    c = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey") + F.col("c_nationkey")).withColumn("k2", F.col("c_custkey") + 3)
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    text = F.concat(F.lit("music DIRECTOR: "), _names("c_custkey", "k"), F.lit("\nStation Manager : "), _names("k2", "c_custkey"), F.lit("\n2. Zed "), _pick(_LAST, "k2"), F.lit(" – Program Director\nServing the "), F.translate(F.lower("n_name"), "_0123456789", " abcdefghij"), F.lit(" coast  area today"))
    df = c.join(n, "c_nationkey").select("c_custkey", text.alias("t"))
    return df.select("c_custkey", people.market(F.col("t")).alias("market"), F.explode_outer(people.names_in(F.col("t"))).alias("x")).select("c_custkey", "market", "x.name", "x.role")


_CAPITALS = "list_reduce(list_transform(string_split(translate(lower(n_name), '_0123456789', ' abcdefghij'), ' '), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b)"
CONTACT_NAMES = f"""
WITH t AS (SELECT c_custkey, {_CAPITALS} || ' Coast' AS market, {_sql_pick(_FIRST, "c_custkey")} || ' ' || {_sql_pick(_LAST, "c_custkey + c_nationkey")} AS a,
    {_sql_pick(_FIRST, "c_custkey + 3")} || ' ' || {_sql_pick(_LAST, "c_custkey")} AS b, 'Zed ' || {_sql_pick(_LAST, "c_custkey + 3")} AS c FROM customer JOIN nation ON n_nationkey = c_nationkey),
x AS (SELECT c_custkey, market, a AS name, 'music_director' AS role FROM t UNION ALL SELECT c_custkey, market, b, 'station_manager' FROM t WHERE b <> a UNION ALL SELECT c_custkey, market, c, 'program_director' FROM t)
SELECT k.c_custkey, k.market, x.name, x.role FROM t k LEFT JOIN x ON k.c_custkey = x.c_custkey AND x.name NOT LIKE '%Records'
"""
_ROLES = [*C.DECISION_ROLES, "host", "dj", "general", "unknown", "booking"]


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of stations (suppliers), one for each order: role, name, address and telephone by its values."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey") * 7 + F.col("o_custkey")).withColumn("k2", F.col("o_custkey") + 2)
    email = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("c"), F.pmod("o_custkey", F.lit(40)), F.lit("@x.org")))
    name = F.when(F.col("o_orderpriority") < "3", _names("o_custkey", "k2"))
    return o.select(F.pmod("o_custkey", F.lit(97)).alias("station"), "o_orderkey", _pick(_ROLES, "k").alias("role"), name.alias("name"), email.alias("email"), F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("555-"), F.pmod("o_custkey", F.lit(30)))).alias("phone"), F.concat(F.lit("https://p"), F.pmod("o_orderkey", F.lit(5)), F.lit(".org")).alias("source_url"), (F.col("o_totalprice") / 1000).alias("confidence"))


_CONTACTS = f"""
contacts AS (SELECT o_custkey % 97 AS station, o_orderkey, {_sql_pick(_ROLES, "o_orderkey * 7 + o_custkey")} AS role,
    CASE WHEN o_orderpriority < '3' THEN {_sql_pick(_FIRST, "o_custkey")} || ' ' || {_sql_pick(_LAST, "o_custkey + 2")} END AS name,
    CASE WHEN o_orderstatus = 'F' THEN 'c' || o_custkey % 40 || '@x.org' END AS email, CASE WHEN o_orderstatus = 'O' THEN '555-' || o_custkey % 30 END AS phone,
    'https://p' || o_orderkey % 5 || '.org' AS source_url, o_totalprice / 1000 AS confidence FROM orders)
"""


def contact_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT9, SRT4, CLS8 and WIN7: contacts of each station with their class and place by relevance and confidence; the first with a channel is preferred."""
    df = _contacts(spark, sf_dir)
    w = Window.partitionBy("station").orderBy(*C.relevance_order(F.col("role"), F.col("confidence")), "o_orderkey")
    best = F.when(F.coalesce("email", "phone").isNotNull(), F.struct(*[(-c if k else c) for k, c in enumerate([C.looked_up(F.col("role"), C.RELEVANCE, 20), F.col("confidence")])], "o_orderkey"))
    listed = Window.partitionBy("station").orderBy(F.asc_nulls_first("role"), F.lower("name").asc_nulls_first(), "o_orderkey")
    df = df.withColumns({"place": F.row_number().over(w).cast("long"), "listed": F.row_number().over(listed).cast("long"), "preferred": F.coalesce(best == F.min(best).over(Window.partitionBy("station")), F.lit(False))})
    return df.select("station", "o_orderkey", C.route_class(F.col("role")).alias("class"), "place", "listed", "preferred")


_CASE = lambda names, default: "CASE role " + " ".join(f"WHEN '{k}' THEN {v if isinstance(v, int) else repr(v)}" for k, v in names.items()) + f" ELSE {default} END"
CONTACT_ORDER = f"""
WITH {_CONTACTS}, r AS (SELECT *, {_CASE(C.RELEVANCE, 20)} AS rel, {_CASE(C.ROUTE_CLASSES, "'UNKNOWN_ROLE'")} AS class FROM contacts)
SELECT station, o_orderkey, class, row_number() OVER (PARTITION BY station ORDER BY rel, confidence DESC, o_orderkey) AS place,
    row_number() OVER (PARTITION BY station ORDER BY role NULLS FIRST, lower(name) NULLS FIRST, o_orderkey) AS listed,
    coalesce(email, phone) IS NOT NULL AND row_number() OVER (PARTITION BY station, coalesce(email, phone) IS NOT NULL ORDER BY rel, confidence DESC, o_orderkey) = 1 AS preferred FROM r
"""


def qualified_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT18 and TXT20: contacts with a person's name, or none, and an address or a role that decides on music."""
    df = _contacts(spark, sf_dir)
    return df.filter(C.qualified(F.col("name"), F.col("email"), F.col("role"))).select("o_orderkey", "name", "role")


QUALIFIED_CONTACTS = f"WITH {_CONTACTS} SELECT o_orderkey, name, role FROM contacts WHERE (name IS NULL OR name NOT LIKE '%Records') AND (email IS NOT NULL OR role IN ({', '.join(repr(r) for r in C.DECISION_ROLES)}))"


def merged_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12 and AGG13: contacts of a station with one address are one; its first known name and all its sources stay."""
    df = _contacts(spark, sf_dir).filter("email is not null")
    return C.merged_by_email(df, ["station"], "o_orderkey").withColumn("sources", F.array_join("sources", ","))


MERGED_CONTACTS = f"""
WITH {_CONTACTS}, s AS (SELECT station, email, source_url, min(o_orderkey) AS seen FROM contacts WHERE email IS NOT NULL GROUP BY ALL),
l AS (SELECT station, email, string_agg(source_url, ',' ORDER BY seen) AS sources FROM s GROUP BY ALL),
m AS (SELECT station, email, arg_min(name, o_orderkey) FILTER (name IS NOT NULL) AS name, arg_min(phone, o_orderkey) FILTER (phone IS NOT NULL) AS phone FROM contacts WHERE email IS NOT NULL GROUP BY ALL)
SELECT * FROM m JOIN l USING (station, email)
"""


def sighted_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG11 and MRG12: each telephone number of a station with its first page and the later ones."""
    return C.sighted(_contacts(spark, sf_dir).filter("phone is not null"), ["station"], "phone", "source_url", "o_orderkey").withColumn("also_seen_at", F.array_join("also_seen_at", ","))


SIGHTED_PHONES = f"""
WITH {_CONTACTS}, s AS (SELECT station, phone, source_url, min(o_orderkey) AS seen FROM contacts WHERE phone IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY station, phone ORDER BY seen) AS k FROM s)
SELECT station, phone, arg_min(source_url, seen) AS source_url, coalesce(string_agg(source_url, ',' ORDER BY seen) FILTER (k > 1), '') AS also_seen_at FROM r GROUP BY ALL
"""


def anonymous_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG14: nameless contacts with one value are one, with the number of sightings; named ones stay."""
    method = F.when(F.col("email").isNotNull(), "email").when(F.col("phone").isNotNull(), "phone")
    df = _contacts(spark, sf_dir).select("station", method.alias("method"), F.coalesce("email", "phone").alias("value"), "name", "source_url", "o_orderkey")
    return C.collapse_anonymous(df, "o_orderkey").groupBy("station", "method", "value", "name").agg(F.sum("observations").alias("observations"), F.count("*").alias("rows"), F.min("source_url").alias("source_url"))


ANONYMOUS_CONTACTS = f"""
WITH {_CONTACTS}, m AS (SELECT *, CASE WHEN email IS NOT NULL THEN 'email' WHEN phone IS NOT NULL THEN 'phone' END AS method, coalesce(email, phone) AS value FROM contacts),
x AS (SELECT station, method, value, name, source_url, 1 AS observations FROM m WHERE name IS NOT NULL OR method IS NULL
    UNION ALL SELECT station, method, value, NULL, arg_min(source_url, o_orderkey), count(*) FROM m WHERE name IS NULL AND method IS NOT NULL GROUP BY station, method, value)
SELECT station, method, value, name, sum(observations)::BIGINT AS observations, count(*) AS rows, min(source_url) AS source_url FROM x GROUP BY station, method, value, name
"""


def station_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS13, WIN5, WIN6 and WIN9: the submission status and best next step of each station."""
    p = table(spark, sf_dir, "part").withColumn("k", F.floor(F.col("p_partkey") / 97).cast("long"))
    pages = p.select(F.pmod("p_partkey", F.lit(97)).alias("station"), _pick(url.CATEGORY_ORDER, "p_size").alias("category"), F.concat(F.lit("https://s.org/"), "p_partkey").alias("url"), F.when(F.pmod("k", F.lit(3)) > 0, F.pmod("k", F.lit(3)) == 1).alias("reachable"), F.col("p_partkey").alias("ord"))
    s = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    stations = s.groupBy(F.pmod("c_custkey", F.lit(211)).alias("station")).agg((F.min("c_custkey") % 2 == 0).alias("investigated"))
    rows = table(spark, sf_dir, "customer").groupBy(F.pmod("c_custkey", F.lit(211)).alias("station")).agg(F.min("c_custkey").alias("c"))
    subs = rows.select("station", F.when(F.col("c") % 4 == 0, F.concat(F.lit("https://s.org/submit/"), "c")).when(F.col("c") % 4 == 1, "see below").alias("submission_url"), F.when(F.col("c") % 2 == 1, F.concat(F.lit("m"), "c", F.lit("@x.org"))).alias("submission_email"))
    return C.best_actions(stations, pages, subs, _contacts(spark, sf_dir).select("station", "role", "email", "phone"))


_RANK = "CASE role " + " ".join(f"WHEN '{r}' THEN {k}" for k, r in enumerate(C.DECISION_ROLES)) + " END"
STATION_ACTIONS = f"""
WITH {_CONTACTS},
pages AS (SELECT p_partkey % 97 AS station, {_sql_pick(url.CATEGORY_ORDER, "p_size")} AS category, 'https://s.org/' || p_partkey AS url, (p_partkey // 97) % 3 = 1 AS reachable, p_partkey AS ord FROM part),
stations AS (SELECT c_custkey % 211 AS station, min(c_custkey) % 2 = 0 AS investigated FROM customer GROUP BY 1),
subs AS (SELECT c_custkey % 211 AS station, min(c_custkey) AS c FROM customer GROUP BY 1),
pg AS (SELECT station, min_by(url, (CASE WHEN reachable THEN 0 ELSE 1 END, url)) FILTER (category IN ('send_music', 'submission_guidelines')) AS send, min_by(url, ord) FILTER (category = 'contact') AS contact,
    min_by(url, ord) FILTER (category IN ('dj_directory', 'programming')) AS dj_page FROM pages GROUP BY station),
who AS (SELECT * FROM (SELECT station, role, email, phone, {_RANK} AS rank FROM contacts) WHERE rank IS NOT NULL AND coalesce(email, phone) IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY station ORDER BY rank, email NULLS FIRST, phone NULLS FIRST) = 1),
d AS (SELECT s.station, investigated, coalesce(CASE WHEN c % 4 = 0 THEN 'https://s.org/submit/' || c END, send, CASE WHEN c % 2 = 1 THEN 'mailto:m' || c || '@x.org' END) AS direct, contact, dj_page, role, email
    FROM stations s LEFT JOIN pg USING (station) LEFT JOIN subs USING (station) LEFT JOIN who USING (station))
SELECT station, CASE WHEN direct IS NOT NULL THEN 'DIRECT_SUBMISSION' WHEN role IS NOT NULL OR contact IS NOT NULL THEN 'CONTACT_FOR_SUBMISSION' WHEN dj_page IS NOT NULL THEN 'SHOW_SPECIFIC_OPPORTUNITY' WHEN investigated THEN 'NO_PUBLIC_SUBMISSION_ROUTE_FOUND' ELSE 'UNKNOWN' END AS status,
    CASE WHEN direct IS NOT NULL THEN 'submit' WHEN role IS NOT NULL THEN 'contact' WHEN contact IS NOT NULL OR dj_page IS NOT NULL THEN 'browse' ELSE 'none' END AS kind,
    CASE WHEN direct IS NOT NULL THEN direct WHEN role IS NOT NULL THEN 'mailto:' || email WHEN contact IS NOT NULL THEN contact ELSE dj_page END AS url,
    CASE WHEN direct IS NOT NULL THEN 'Send music' WHEN role IS NOT NULL AND email IS NOT NULL THEN 'Contact ' || CASE role WHEN 'music_director' THEN 'music director' WHEN 'program_director' THEN 'program director' ELSE 'music department' END
        WHEN role IS NOT NULL THEN 'Call music ' || CASE role WHEN 'music_director' THEN 'director' ELSE 'department' END
        WHEN contact IS NOT NULL THEN 'Contact station' WHEN dj_page IS NOT NULL THEN 'Browse station DJs & programming' WHEN investigated THEN 'No public submission route found' ELSE '' END AS label FROM d
"""


def person_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT9, TXT20, TXT21, TXT24 and TXT25: which lines name people, which only a role; names against titles."""
    c = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey") + 1)
    line = F.when(F.col("c_custkey") % 3 == 0, F.concat(_names("c_custkey", "k"), F.lit(" :"))).when(F.col("c_custkey") % 3 == 1, "Senior Music Director &").otherwise(F.concat(_pick(_FIRST, "c_custkey"), F.lit(" Playland")))
    title = F.concat(F.lit("WXYZ  "), "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, " | Official Site").otherwise(" News"))
    df = c.select("c_custkey", line.alias("line"), title.alias("title"), "c_mktsegment")
    return df.select("c_custkey", people.person_name(F.col("line")).alias("name"), people.is_person(F.col("line")).alias("person"), people.is_role_line(F.col("line")).alias("role_only"), people.clean_title(F.col("title")).alias("title"), people.names_match(F.concat(F.lit("the "), F.when(F.col("c_custkey") % 5 == 0, F.col("c_mktsegment")).otherwise("radio")), F.col("title")).alias("matches"))


PERSON_LINES = f"""
WITH t AS (SELECT c_custkey, c_mktsegment, {_sql_pick(_FIRST, "c_custkey")} AS f, {_sql_pick(_LAST, "c_custkey + 1")} AS l FROM customer)
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN f || ' ' || l WHEN 1 THEN 'Senior Music Director &' ELSE f || ' Playland' END AS name, c_custkey % 3 = 0 AND l <> 'Records' AS person, c_custkey % 3 = 1 AS role_only,
    'WXYZ ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' News' END AS title, c_custkey % 5 = 0 AS matches FROM t
"""


def matched_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13 in both stages: contacts of stations by address, then by name and role, stored ones (of early orders) first."""
    df = _contacts(spark, sf_dir)
    rows = df.withColumns({"stored": F.col("o_orderkey") % 50 == 0, "ord": F.col("o_orderkey"), "provenance": F.array("source_url")})
    return contact_fold.matched_contacts(rows).withColumn("provenance", F.array_join("provenance", ","))


def music_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN2: the contact of each station to send music to, by relevance, then by having a channel, the first of equals."""
    df = _contacts(spark, sf_dir).withColumn("preferred", F.col("o_orderkey") % 6 == 0)
    return C.music_contact(df, "station", "o_orderkey").select("station", "o_orderkey", "role", "score")


MUSIC_CONTACTS = f"""
WITH {_CONTACTS}, c AS (SELECT *, o_orderkey % 6 = 0 AS preferred, role IN ({", ".join(f"'{r}'" for r in C.DECISION_ROLES)}) AS music FROM contacts),
s AS (SELECT *, least(100, greatest(CASE WHEN music THEN 80 WHEN role IN ('host', 'dj') THEN 50 WHEN role = 'general' THEN 30 ELSE 0 END, CASE WHEN preferred THEN 90 ELSE 0 END) + CASE WHEN name IS NOT NULL THEN 5 ELSE 0 END)::INT AS score FROM c WHERE music OR preferred)
SELECT station, o_orderkey, role, score FROM s QUALIFY row_number() OVER (PARTITION BY station ORDER BY score DESC, coalesce(email, phone) IS NOT NULL DESC, o_orderkey) = 1
"""


QUERIES = {
    "matched_contacts": (matched_contacts, None), "music_contacts": (music_contacts, MUSIC_CONTACTS), "url_classes": (url_classes, URL_CLASSES), "page_address_counts": (page_address_counts, PAGE_ADDRESS_COUNTS), "booking_links": (booking_links, BOOKING_LINKS), "mail_links": (mail_links, MAIL_LINKS),
    "contact_names": (contact_names, CONTACT_NAMES), "contact_order": (contact_order, CONTACT_ORDER), "qualified_contacts": (qualified_contacts, QUALIFIED_CONTACTS), "merged_contacts": (merged_contacts, MERGED_CONTACTS),
    "sighted_phones": (sighted_phones, SIGHTED_PHONES), "anonymous_contacts": (anonymous_contacts, ANONYMOUS_CONTACTS), "station_actions": (station_actions, STATION_ACTIONS), "person_lines": (person_lines, PERSON_LINES),
}
