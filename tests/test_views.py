import pytest
from pyspark.sql import functions as F

from quarry.functions import json as J
from quarry.functions import people
from quarry.functions.text import short_slug
from quarry.operators import merge as M
from quarry.operators import performers as P
from quarry.operators import views as V
from quarry.streaming.ledger import job_states


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "value"),
    [(None, None), ("", None), ("none", None), ('a {"x": [1]} {}', '{"x": [1]}'), ("[[1] [2]", "[1]"), ("{" * 3000, None), ('```json\n{"a": 1}\n```', '{"a": 1}')],
)
def test_first_json(spark, text, value):
    assert one(spark, J.first_json(F.col("t")), t=F.lit(text).cast("string")) == value


@pytest.mark.parametrize(
    ("text", "schema", "fault"),
    [
        ('{"a": null}', {"properties": {"a": {"type": "string"}}}, "output.a must be a string"),
        ("[1, true]", {"type": "array", "items": {"type": "number"}}, "output[1] must be a number"),
        ("[]", {"type": "array", "items": {"type": "number"}}, None),
        ("3", {"type": "integer"}, None),
        ("true", {"type": "integer"}, "output must be a number"),
        ("not json", {"type": "object"}, "output must be a JSON object"),
        ('{"a": {"b": 1}}', {"properties": {"a": {"type": "object", "required": ["c"]}}}, "output.a missing required key 'c'"),
    ],
)
def test_schema_error(spark, text, schema, fault):
    assert one(spark, J.schema_error(F.try_parse_json("t"), schema), t=text) == fault


def test_slug_has_no_marks_at_its_ends(spark):
    assert one(spark, short_slug(F.col("t")), t="-Radio One!") == "radio_one"


def test_names_are_given_once(spark):
    contacts = spark.createDataFrame([(1, "host", None, 1), (1, "host", None, 2), (1, "host", None, 3), (1, "dj", "Known", 4), (2, "host", None, 5)], "page long, role string, name string, ord long")
    names = spark.createDataFrame([(1, "host", "Ann Lee", 1), (1, "host", "ANN LEE", 2), (1, "host", "Joe Ray", 3), (3, "host", "Eve Stone", 1)], "page long, role string, name string, p long")
    got = {r["ord"]: r["name"] for r in V.assign_names(contacts, names, "page", "ord", "p").collect()}
    assert got == {1: "Ann Lee", 2: "Joe Ray", 3: None, 4: "Known", 5: None}


def test_payloads_of_nulls(spark):
    rows = spark.createDataFrame([(1, None, None, None), (2, "A", [], []), (3, "A", None, [("email", "a", "https://x"), ("email", "a ", "https://x")]), (4, "A", ["x"], [(None, None, None)])], "id long, name string, urls array<string>, channels array<struct<channel:string,value:string,source_url:string>>")
    good, bad = M.split_valid(rows, P.payload_rules(F.col("name"), F.col("urls"), F.col("channels")))
    assert [r["id"] for r in good.collect()] == [2]
    assert {r["id"]: r["failed"] for r in bad.collect()} == {1: ["name"], 3: ["duplicate"], 4: ["source_urls", "channel", "value", "channel_source"]}


def test_only_our_run_is_taken_back(spark):
    rows = spark.createDataFrame([(1, "Ann", ["https://www.songkick.com/x"], "qualified"), (2, "Ann", [], "needs_verification"), (3, "Ann", [], None)], "id long, name string, source_urls array<string>, verdict string")
    plan = P.planned_class(rows)
    after = P.apply_classes(rows, plan, "id", "r1")
    assert {r["id"]: r["verdict"] for r in after.collect()} == {1: "rejected", 2: "needs_verification", 3: "needs_verification"}
    assert {r["id"]: r["verdict"] for r in P.reverse_classes(after, "other").collect()} == {1: "rejected", 2: "needs_verification", 3: "needs_verification"}
    assert {r["id"]: r["verdict"] for r in P.reverse_classes(after, "r1").collect()} == {1: "qualified", 2: "needs_verification", 3: None}
    assert P.planned_class(after).count() == 0


def test_directories(spark):
    page = lambda url, title, text: one(spark, people.is_directory(F.col("u"), F.col("h"), F.col("t")), u=F.lit(url).cast("string"), h=F.lit(title).cast("string"), t=F.lit(text).cast("string"))
    three = "Ann Lee\nHost\n\nJoe Ray\nProducer\n\nMusic Director\nEve Stone"
    assert page("https://x.org/a", None, three) and page(None, None, three)
    assert not page("https://x.org/a", None, "Ann Lee\nHost\nJoe Ray")
    assert not page("https://x.org/email.php?id=3", "Staff", three)
    assert not page(None, None, None)


def test_merge_of_one_and_of_none(spark):
    schema = "key long, ord long, name string, source_urls array<string>, social_urls map<string,string>, submission_url string, contact_url string, city string, country string, description string, station_type string, discovered_at string, last_observed_at string"
    rows = spark.createDataFrame([(1, 1, "A", None, None, None, None, "", None, None, "unknown", "", None), (1, 2, "B", ["u"], {"x": "1"}, None, "c", "C", None, None, "college", "2024", "2025")], schema)
    r = M.merge_duplicates(rows, "key", "ord").first()
    assert (r["name"], r["alternate_names"], r["source_urls"], r["social_urls"], r["city"], r["station_type"], r["discovered_at"], r["contact_url"]) == ("A", ["B"], ["u"], {"x": "1"}, "C", "college", "2024", "c")
    assert M.merge_duplicates(rows.limit(0), "key", "ord").count() == 0


def test_job_states_of_a_stream(spark, tmp_path):
    schema = "run_id long, status string, at long"
    for n, events in enumerate([[(1, "queued", 1), (2, "running", 2)], [(1, "completed", 5), (2, "queued", 9)], [(1, "running", 7), (2, "lost", 10)]]):
        spark.createDataFrame(events, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{n}"))
    files = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = job_states(files).writeStream.outputMode("complete").format("memory").queryName("job_states").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    got = {r["run_id"]: (r["status"], r["ended"]) for r in spark.table("job_states").collect()}
    assert got == {1: ("completed", True), 2: ("running", False)}


def test_pages_and_recipients_without_values(spark):
    pages = spark.createDataFrame([("unheard of", None), (None, True)], "category string, reachable boolean")
    assert {(r["kind"], r["evidence_state"]) for r in V.page_view(pages).collect()} == {("Discovered station page", "DISCOVERED"), ("Discovered station page", "VERIFIED")}
    none = F.lit(None).cast("string")
    nothing = lambda *names: F.struct(*[none.alias(n) for n in names])
    assert one(spark, V.recipient(nothing("identity_key", "name", "domain"), nothing("type", "value", "title", "class", "source_url"), nothing("contact_uid", "name", "role", "email", "source_url"))) is None


SCHEMA = {
    "required": ["name", "tags"],
    "properties": {"name": {"type": "string", "enum": ["a", "b"]}, "tags": {"type": "array", "maxItems": 2, "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}}}, "sure": {"type": "boolean"}},
}
ANSWERS = [
    ('Here: {"name": "a", "tags": [{"n": 1}]} done', '{"name": "a", "tags": [{"n": 1}]}', None),
    ('```json\n{"name": "c", "tags": []}\n```', '{"name": "c", "tags": []}', "output.name must be one of ['a', 'b']"),
    ('{broken [1, {"x": "}"}] {}', '[1, {"x": "}"}]', "output must be a JSON object"),
    ('{"name": "b"} {"tags": 1}', '{"name": "b"}', "output missing required key 'tags'"),
    ('{"name": "b", "tags": [{"n": 1}, {"n": 1.5}]}', '{"name": "b", "tags": [{"n": 1}, {"n": 1.5}]}', "output.tags[1].n must be an integer"),
    ('{"name": "b", "tags": [{"n": 1}, {"n": 2}, {"n": 3}], "sure": 1}', '{"name": "b", "tags": [{"n": 1}, {"n": 2}, {"n": 3}], "sure": 1}', "output.tags exceeds 2 items"),
    ("no value {at all", None, "output must be a JSON object"),
]


def test_values_of_free_texts_and_their_faults(spark):
    from quarry.functions import json as J

    df = spark.createDataFrame([(k, a) for k, (a, _, _) in enumerate(ANSWERS)], "k int, a string").withColumn("v", J.first_json(F.col("a")))
    got = {r.k: (r.v, r.e) for r in df.withColumn("e", J.schema_error(F.try_parse_json("v"), SCHEMA)).collect()}
    assert got == {k: (v, e) for k, (_, v, e) in enumerate(ANSWERS)}
