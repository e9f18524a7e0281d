import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import contacts as C
from quarry.operators import documents as D
from quarry.operators import routes as T

CONTACT = "station int, uid string, role string, name string, email string, phone string, source_url string, sources array<string>, preferred boolean, ord long"
PAGE, SUB = "station int, category string, url string, reachable boolean, ord long", "station int, submission_url string, verified boolean, submission_email string"


def test_stored_json_has_defaults_and_keeps_fields_that_came_later(spark):
    rows = [(1, '{"k": 1, "x": {"a": [2]}}', '["a"]', '{"a": "b"}'), (2, None, None, None), (3, "", "", ""), (4, '{"k": 1', "[1", "x"), (5, "[1]", '{"a": 1}', "[1]"), (6, '{"k": "z"}', '["a", 1, null]', "null"), (6, "null", "null", "{}")]
    df = D.decoded(spark.createDataFrame(rows, "i int, s string, l string, m string"), {"s": "struct<k:int,z:string>", "l": "array<string>", "m": "map<string,string>"})
    got = [(r.i, r.s and tuple(r.s), r.l, r.m, r.s_more, r["_broken"]) for r in df.collect()]
    assert got == [
        (1, (1, None), ["a"], {"a": "b"}, {"x": '{"a":[2]}'}, []), (2, (None, None), [], {}, {}, []), (3, (None, None), [], {}, {}, []), (4, (None, None), [], {}, {}, ["s", "l", "m"]),
        (5, None, None, None, {}, []), (6, (None, None), ["a", "1", None], None, {}, []), (6, None, None, {}, {}, []),
    ]
    wider = D.decoded(spark.createDataFrame(rows, "i int, s string, l string, m string"), {"s": "struct<k:int,z:string,x:struct<a:array<int>>>"})
    assert wider.filter("i = 1").select("s.x.a", "s_more").first().asDict() == {"a": [2], "s_more": {}}


def routes(spark, pages=(), subs=(), contacts=()):
    frames = spark.createDataFrame(list(pages), PAGE), spark.createDataFrame(list(subs), SUB), spark.createDataFrame(list(contacts), CONTACT)
    return frames, T.routes(*frames)


def test_fallbacks(spark):
    pages = [(1, "contact", "c", True, 1), (2, "contact", "c", True, 1), (2, "send_music", "s", True, 2), (3, "send_music", "s", False, 1), (3, "about", "a", True, 2), (4, "contact", "c", True, 1), (4, "send_music", "s", None, 2), (6, "about", None, None, 1), (7, None, "u", True, 1)]
    (p, _, c), ranked = routes(spark, pages)
    stations = spark.createDataFrame([(k, "x" if k == 1 else None, "m" if k == 2 else "") for k in range(1, 8)], "station int, city string, market_area string")
    got = {r.station: (r.route and r.route.value, r.fallback and r.fallback.kind, r.sure, len(r.unknown), r.routes) for r in D.recommended(stations, ranked, p, c).collect()}
    assert got == {
        1: ("c", "page_contact", "Medium", 2, 1),  # the only route is its own fallback
        2: ("s", "page_contact", "High", 1, 2), 3: (None, "page_send_music", "Unknown", 2, 2), 4: ("c", "page_send_music", "Medium", 2, 2), 5: (None, None, "Unknown", 4, 0), 6: (None, "page_about", "Unknown", 4, 1), 7: (None, None, "Unknown", 3, 0),
    }


def test_sightings_of_a_value_are_one_contact(spark):
    rows = [
        (1, "a", None, None, None, "1 (203) 555-0100", None, ["x"], None, 1), (1, "b", "unknown", " ", None, "203-555-0100", "y", ["x", "z"], False, 2), (1, "c", "", None, None, "203.555.0100", "y", None, True, 3),
        (1, "d", "Unknown", None, "A@X.org", None, "y", [], None, 4), (1, "e", None, None, "a@x.org", "1", None, None, None, 5), (1, "f", None, None, None, None, None, None, None, 6), (1, "g", None, None, "", "", None, None, None, 7),
        (1, "h", "host", None, None, "203-555-0100", None, None, None, 8), (2, "i", None, None, None, "2035550100", None, None, None, 9), (1, "j", "booking", "Al", None, "5", None, None, None, 10),
    ]
    (_, _, c), ranked = routes(spark, contacts=rows)
    got = {r.uid: (r.observations, r.source_url, r.sources, r.value_normalized, r.identity_state, r.can_add_to_campaign) for r in D.contact_views(c, ranked).collect()}
    anonymous = "unattributed_observation"
    assert got == {
        "a": (3, "y", ["x", "y", "z"], "+12035550100", anonymous, False), "d": (2, "y", ["y"], "a@x.org", anonymous, True), "f": (1, None, [], None, anonymous, False),
        "g": (1, None, [], None, anonymous, False), "h": (1, None, [], "+12035550100", "role_based", False), "i": (1, None, [], "+12035550100", anonymous, False), "j": (1, None, [], "5", "named", False),
    }


@pytest.fixture
def bucketed(spark, tmp_path):
    """Tables in buckets by station, as a store of stations has them."""
    n = 40
    made = {
        "d_stations": spark.range(n).select(F.col("id").cast("int").alias("station"), *[F.lit(None).cast("string").alias(c) for c in ("identity_key", "name", "domain", "website", "country", "state_or_region", "city", "market_area", "language", "description", "last_verified_at", "station_type")], F.array(F.lit("u")).alias("source_urls")),
        "d_facts": spark.range(n * 9).select((F.col("id") % 30).cast("int").alias("station"), F.when(F.col("id") % 2 == 0, "email").otherwise("phone").alias("kind"), F.concat(F.lit("v"), "id").alias("value"), F.lit("u").alias("source_url")),
        "d_contacts": spark.createDataFrame([(k % 20, f"c{k}", ["host", "music_director", None][k % 3], None, f"a{k}@x.org" if k % 2 else None, "1", None, ["u"], k % 5 == 0, k) for k in range(200)], CONTACT),
        "d_pages": spark.createDataFrame([(k % 25, ["contact", "about", "send_music"][k % 3], f"p{k}", k % 2 == 0, k) for k in range(100)], PAGE),
        "d_subs": spark.createDataFrame([(k, f"s{k}", True, None) for k in range(10)], SUB),
    }
    made["d_ranked"] = T.routes(made["d_pages"], made["d_subs"], made["d_contacts"])
    for name, frame in made.items():
        frame.write.bucketBy(4, "station").sortBy("station").mode("overwrite").option("path", str(tmp_path / name)).saveAsTable(name)
    yield {name: spark.table(name) for name in made}
    for name in made:
        spark.sql(f"DROP TABLE {name}")


def test_documents_over_buckets_exchange_nothing(spark, bucketed):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(before, ("-1", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        t = bucketed
        ranked = t["d_ranked"]
        sent = t["d_subs"].select("station", "submission_url", "submission_email")
        actions = C.best_actions(t["d_stations"].select("station", F.lit(True).alias("investigated")), t["d_pages"], sent, t["d_contacts"])
        df = D.station_documents(t["d_stations"], t["d_facts"], t["d_contacts"], sent, t["d_pages"], ranked, actions, T.intelligence_level(ranked), most=3)
        plan = df._jdf.queryExecution().executedPlan().toString()
        docs = {r.station: json.loads(r.d) for r in df.select("station", F.to_json("document").alias("d")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "Exchange hashpartitioning" not in plan
    assert len(docs) == 40 and docs[39]["contacts"] == [] and docs[39]["counts"]["contacts"] == 0
    one = docs[0]
    assert len(one["emails"]) == 3 and one["counts"]["emails"] == 12 and [e["value"] for e in one["emails"]] == ["v0", "v120", "v150"]
    assert len(one["contacts"]) == 3 and one["recommendation"]["route"]["value"] == "s0" and one["counts"]["outreach_routes"] == one["recommendation"]["routes"]


def test_a_list_takes_one_window_and_keeps_no_more_than_it_shows(spark):
    rows = spark.range(50).select((F.col("id") % 2).alias("station"), F.col("id").alias("ord"))
    df = D.listed(rows, "places", [F.col("ord")], ["ord"], 3)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 1
    assert {r.station: ([x.ord for x in r.places], r.n_places) for r in df.collect()} == {0: ([0, 2, 4], 25), 1: ([1, 3, 5], 25)}
