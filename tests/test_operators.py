from pyspark.sql import functions as F

from quarry.operators import html as H
from quarry.operators import listing as L
from quarry.operators import merge as M
from quarry.operators import verify as V
from quarry.sources import candidates, records
from quarry.streaming import ledger


def seen(spark, rows):
    return spark.createDataFrame(rows, "claim string, kind string, value string, source_url string, source_type string, discovered_at string")


def test_two_domains_corroborate(spark):
    rows = [("e", "email", "M@x.org", "https://a.example/1", "contact_page", "2"), ("e", "email", "m@x.org", "https://www.b.example", "", "1")]
    got = V.evaluate(seen(spark, rows), ["claim"]).first()
    assert got["outcome"] == "corroborated" and got["values"][0]["independent_domains"] == 2


def test_two_pages_of_a_site_are_one_source(spark):
    rows = [("e", "text", "x", "https://a.example/1", "", ""), ("e", "text", "x", "https://m.a.example/2", "", "")]
    assert V.evaluate(seen(spark, rows), ["claim"]).first()["outcome"] == "single_source"


def test_two_values_conflict_and_both_stay(spark):
    rows = [("e", "text", "x", "https://a.example", "official_website_page", "2"), ("e", "text", "y", "https://b.example", "", "1"), ("e", "text", " ", "https://c.example", "", "")]
    got = V.evaluate(seen(spark, rows), ["claim"]).first()
    assert got["outcome"] == "conflicting" and [v["value"] for v in got["values"]] == ["y", "x"] and max(v["strength"] for v in got["values"]) == 4


def test_summary_is_zero_filled(spark):
    claims = spark.createDataFrame([("single_source",)], "outcome string")
    assert {r["outcome"]: r["n"] for r in V.outcome_summary(claims).collect()} == {"corroborated": 0, "conflicting": 0, "single_source": 1, "unobserved": 0}


def test_history_tail(spark):
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(25)).alias("a"), F.array(F.lit(1)).alias("b"))
    r = df.select(V.history_tail(F.col("a")).alias("a"), V.history_tail(F.col("b")).alias("b")).first()
    assert r["a"] == list(range(6, 26)) and r["b"] == [1]


def test_identity(spark):
    df = spark.createDataFrame([("http://www.kqxr.example/", "A", "US", "TX"), ("https://kqxr.example/x", "B", "US", "TX"), (None, "A", "US", "TX"), (None, "A", "US", "CA")], "w string, n string, c string, r string")
    keys = [r[0] for r in df.select(M.identity_key(F.col("w"), F.col("n"), F.col("c"), F.col("r"))).collect()]
    assert keys[0] == keys[1] == "domain:kqxr.example" and keys[2] != keys[3] and keys[2].startswith("namegeo:")


def test_lists_keep_what_is_stored(spark):
    df = spark.createDataFrame([(["b", "b"], ["a", "b", "a"], None)], "o array<string>, n array<string>, z array<string>")
    r = df.select(M.merge_lists(F.col("o"), F.col("n")), M.merge_lists(F.col("z"), F.col("n"))).first()
    assert (r[0], r[1]) == (["b", "b", "a"], ["a", "b"])


def test_maps(spark):
    df = spark.sql("select map('a', '1') o, map('a', '2', 'b', '3') n")
    r = df.select(M.merge_maps(F.col("o"), F.col("n")), M.merge_maps(F.col("o"), F.col("n"), newest=True)).first()
    assert r[0] == {"a": "1", "b": "3"} and r[1] == {"a": "2", "b": "3"}


def test_merging_again_changes_nothing(spark):
    old = spark.createDataFrame([(1, "x", ["a"])], "key int, name string, tags array<string>")
    new = spark.createDataFrame([(1, None, ["b"]), (2, "y", None)], "key int, name string, tags array<string>")
    policy = {"name": "fill", "tags": "list"}
    once = M.merge_stored(old, new, "key", policy)
    again = M.merge_stored(once, new, "key", policy)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect())) == [(1, "x", ["a", "b"]), (2, "y", [])]


def test_nested_and_page(spark):
    parents, children = spark.range(3), spark.createDataFrame([(0, 2, "b"), (0, 1, "a")], "id long, at int, v string")
    got = {r["id"]: [c["v"] for c in r["xs"]] for r in L.nested(parents, children, "id", "xs", ["at"]).collect()}
    assert got == {0: ["a", "b"], 1: [], 2: []}
    try:
        L.page(parents, [F.col("id")], limit=201)
        raise AssertionError("a page above the largest")
    except ValueError:
        pass


def test_parse_page(spark):
    html = "<html><head><title> A <b>\n x</title><style>no</style></head><body><p>Hi <a href='/c?x=1#y'>Contact <i>us</i></a><a href='mailto:m@x.org?subject=s'>m</a><a href='ftp://x'>f</a><form action='send'></form><form></form><script>no</script>bye"
    broken = "<title>Open title\nrest of page"
    df = spark.createDataFrame([(1, "https://x.org/d/", html), (2, "https://x.org", broken), (3, None, None)], "k int, url string, html string")
    r = {x["k"]: x["p"] for x in df.select("k", H.parse_page(F.col("url"), F.col("html")).alias("p")).collect()}
    assert [tuple(x) for x in r[1]["links"]] == [("https://x.org/c?x=1#y", "Contact us")]
    assert r[1]["mailtos"] == ["m@x.org"] and r[1]["forms"] == ["https://x.org/d/send", ""] and "no" not in r[1]["text"] and r[1]["text"].endswith("bye")
    assert r[2]["title"] == "Open title rest of page" and r[2]["text"] == ""
    assert r[3]["title"] is None and r[3]["links"] == []


def test_record_files(spark, tmp_path):
    schema = "name string, url string, website string, country string, state_or_region string, city string"
    (tmp_path / "a.json").write_text('{"stations": [{"name": "A", "website": "a.org", "country": "US"}, {"name": "B"}]}')
    (tmp_path / "b.json").write_text('[{"name": "C", "url": "c.org"}, {"name": "D", "url": "d.org", "country": "FR"}]')
    names = lambda p, **k: sorted(r["name"] for r in candidates(records(spark, str(tmp_path / p), schema), **k).collect())
    assert names("a.json") == ["A"] and names("b.json", country="us") == ["C"]
    (tmp_path / "many").mkdir()
    for f in "xyz":
        (tmp_path / f"many/{f}.json").write_text("[" + ",".join(f'{{"name": "{f}{k}", "url": "u"}}' for k in range(50)) + "]")
    first = candidates(records(spark, str(tmp_path / "many"), schema, placed=True), limit=70)
    assert sorted(r["name"] for r in first.collect()) == sorted([f"x{k}" for k in range(50)] + [f"y{k}" for k in range(20)])


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run has nothing new
        ledger.keep_latest(ledger.read_ledger(spark, str(tmp_path / "in")), ["user_id", "event_type"], ["ts", "event_id"], str(tmp_path / "out"), str(tmp_path / "check"))
    got = ledger.versions(spark, str(tmp_path / "out"))
    want = M.latest_per_key(events, ["user_id", "event_type"], F.col("ts"), F.col("event_id"))
    pick = lambda df: sorted(map(tuple, df.select("user_id", "event_type", "event_id").collect()))
    assert pick(got) == pick(want)


def test_windowed_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.coalesce(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    q = ledger.windowed_counts(ledger.once(ledger.read_ledger(spark, str(tmp_path / "in")), late="1 hour"), late=None)
    q.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["window"]["start"], r["event_type"]): r["n"] for r in spark.table("windows").collect()}
    want = {(r["window"]["start"], r["event_type"]): r["n"] for r in events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items())
