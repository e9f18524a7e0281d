import pytest
from pyspark.sql import functions as F

from quarry.functions import people, url
from quarry.functions.text import emails_in, keyword_hits, mailto_addresses
from quarry.operators import contacts as C
from quarry.operators import html as H
from quarry.operators import records as R


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("line", ["Junkyard Tongues", "Funfair Playland", "Sofrito Expressway", "Record Fair", "Donation Page", "Vertise Lee"])
def test_titles_and_menus_are_no_people(spark, line):
    assert one(spark, people.is_person(F.col("t")), t=line) is False
    assert one(spark, people.is_person(F.col("t")), t="Ann Lee") is True


def test_names_beside_roles(spark):
    text = "Music Director: Ann Lee\nSome text.\nJoe Ray - Program Director\nhost: ANN LEE\nDJ: Contact Us Now\nmusic director: ann"
    got = one(spark, people.names_in(F.col("t")), t=text)
    assert [tuple(x) for x in got] == [("Ann Lee", "music_director"), ("Joe Ray", "program_director")]
    assert one(spark, people.names_in(F.lit(None).cast("string"))) == []


def test_market(spark):
    assert one(spark, people.market(F.col("t")), t="Proudly serving the greater  new haven area since 1960") == "Greater New Haven"
    assert one(spark, people.market(F.col("t")), t="serving you") is None


def test_mailto_values(spark):
    got = one(spark, mailto_addresses(F.array(F.lit("A@x.org?subject=1"), F.lit("a@x.org"), F.lit("no"), F.lit(None).cast("string"))))
    assert got == ["a@x.org"]


def test_hidden_addresses_are_still_found(spark):
    assert one(spark, emails_in(F.col("t")), t="write to ann [at] radio [dot] org or bob AT x DOT org; at night") == ["ann@radio.org", "bob@x.org"]


@pytest.mark.parametrize(("text", "n"), [("rap rapper RAP rap", 3), ("", 0), (None, 0), ("aaa", 1), ("r.p", 0)])
def test_keywords_count_without_overlap(spark, text, n):
    word = "aa" if text == "aaa" else "rap"
    assert one(spark, keyword_hits(F.lit(text).cast("string"), [word])) == n


@pytest.mark.parametrize(
    ("address", "label", "category"),
    [("https://x.org/a", "Send us your music", "send_music"), ("https://x.org/how-to-submit", "", "submission_guidelines"), ("https://x.org/a", "About us", "other"), ("https://x.org/about", None, "about"), ("https://x.org/schedule", "x", "programming")],
)
def test_page_categories(spark, address, label, category):
    assert one(spark, url.page_category(F.lit(label).cast("string"), F.lit(address))) == category


def test_links_of_a_page(spark):
    html = '<title>T</title><body><form action="javascript:x()"></form><form action="/send"></form><form></form><a href="mailto:a@x.org?subject=1">a</a><a href="mailto:?x">b</a><a href="/c">c</a>'
    page = one(spark, H.parse_page(F.col("u"), F.col("h")), u="https://x.org/", h=html)
    assert page["mailtos"] == ["a@x.org"] and page["forms"] == ["https://x.org/send", ""] and [x["href"] for x in page["links"]] == ["https://x.org/c"]


def test_actions_of_stations_without_anything(spark):
    stations = spark.createDataFrame([(1, True), (2, False)], "station long, investigated boolean")
    pages = spark.createDataFrame([], "station long, category string, url string, reachable boolean, ord long")
    subs = spark.createDataFrame([(2, "ftp://x", None)], "station long, submission_url string, submission_email string")
    people_of = spark.createDataFrame([(2, "host", "a@x.org", None)], "station long, role string, email string, phone string")
    got = {r["station"]: r["status"] for r in C.best_actions(stations, pages, subs, people_of).collect()}
    assert got == {1: "NO_PUBLIC_SUBMISSION_ROUTE_FOUND", 2: "UNKNOWN"}


def test_ingest_of_nulls_and_repeats(spark):
    incoming = spark.createDataFrame([(1, 1, True), (1, 2, True), (2, 3, None), (3, 4, True), (1, 5, False)], "k long, n long, ok boolean")
    rows, counts = R.ingest(spark.createDataFrame([(3,), (3,)], "k long"), incoming, "k", F.col("ok"), "n")
    assert {r["n"]: r["state"] for r in rows.collect()} == {1: "created", 2: "duplicate", 3: "failed", 4: "merged", 5: "failed"}
    assert counts.first().asDict() == {"candidates": 5, "created": 1, "merged": 1, "duplicate": 1, "failed": 2}


def test_first_fetch_of_lines_that_tie_or_say_nothing(spark, tmp_path):
    from oracle import connection
    from quarry.plans.records import PAGE_FETCHES, page_fetches

    rows = [(p, o, n, d) for p in range(40) for o, n, d in ((1, 1, 0.1 if p % 2 else 0.0), (1, 1, 0.0 if p % 2 else 0.1), (1, 1, 0.1))]
    rows += [(40, 1, 1, None), (40, 2, 1, 0.1), (41, None, 1, 0.0), (41, 2, 1, 0.1), (42, 1, 1, None)]
    spark.createDataFrame(rows[::-1], "l_partkey long, l_orderkey long, l_linenumber int, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, p % 40) for p in range(44)], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = connection(tmp_path)
    con.execute("SET threads = 1")  # ties go to the first row of a scan in order
    assert sorted(map(tuple, page_fetches(spark, str(tmp_path)).collect())) == sorted(con.execute(PAGE_FETCHES).fetchall())
