import pytest
from pyspark.sql import functions as F

from quarry.operators import classify as C
from quarry.operators import dedupe as D


def verdict(spark, function, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(function(*[F.col(f"c{k}") for k in range(len(values))])["verdict"]).first()[0]


@pytest.mark.parametrize(
    ("url", "title", "snippet", "page", "want"),
    [
        ("https://www.eventbrite.com/e/1", "DJ Ann", "", None, "rejected"),
        ("https://ann.org/events/1", "DJ Ann", "", None, "rejected"),
        ("https://facebook.com/groups/1", "DJ Ann", "", None, "rejected"),
        ("https://ann.org/", "DJ Ann", "buy tickets", None, "qualified"),
        ("https://soundcloud.com/ann", "Ann", "a deejay", None, "qualified"),
        ("https://ann.org/", "Ann", "buy tickets", None, "rejected"),
        ("https://blog.ann.org/", "Ann", "", None, "rejected"),
        ("https://ann.org/", "Ann", "", None, "needs_review"),
        ("https://ann.org/", "Ann", "", "Resident DJ in town", "qualified"),
        (None, None, None, None, "needs_review"),
    ],
)
def test_performers(spark, url, title, snippet, page, want):
    assert verdict(spark, C.performer_candidate, url, title, snippet, page) == want


@pytest.mark.parametrize(
    ("url", "title", "want"),
    [
        ("https://www.facebook.com/kqxr", "KQXR radio", "rejected"), ("https://kqxr.org/playlist/1", "KQXR", "rejected"), ("https://kqxr.org/", "KQXR 88.3 FM", "qualified"),
        ("https://x.org/", "album review", "rejected"), ("https://kqxr.org/", "home", "needs_review"), (None, None, "needs_review"),
    ],
)
def test_stations(spark, url, title, want):
    assert verdict(spark, C.station_candidate, url, title, None) == want


def test_states(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "r boolean")
    assert [r[0] for r in df.select(C.page_state(F.col("r"))).collect()] == ["VERIFIED", "UNREACHABLE", "DISCOVERED"]


def test_chains_join(spark):
    rows = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["b", "c"]), (4, ["d"]), (5, []), (6, ["c"])], "id long, keys array<string>")
    assert sorted(map(tuple, D.identity_groups(rows).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 1)]


@pytest.mark.parametrize(
    ("title", "want"),
    [("!! ÉCHQUE!!", "qualified"), ("ÉCHQUEÉ", "qualified"), ("éradio", "qualified"), ("aradio", "needs_review"), ("88.3 Khz", "qualified"), ("top\x0b10 songs", "needs_review"), ("top 10 ſongs", "rejected")],
)
def test_words_of_stations_are_those_of_sql(spark, title, want):
    from oracle import connection
    from quarry.plans.candidates import STATION_VERDICTS

    con = connection("/nonexistent")
    con.execute("CREATE TABLE pages AS SELECT 1 AS page_id, 'https://kqxr.org/' AS url, ? AS html", [title])
    assert con.execute(STATION_VERDICTS).fetchall()[0][1] == want
    assert verdict(spark, lambda *c: C.station_candidate(*c, as_sql=True), "https://kqxr.org/", title, None) == want
