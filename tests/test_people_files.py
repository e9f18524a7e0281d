import pytest
from pyspark.sql import functions as F

from quarry.functions import files as FF
from quarry.functions import people as P


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(function(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("raw", "want"), [("Ken Freedman.", True), ("Maria de la Cruz", False), ("Ana van Dyk", True), ("STATION STAFF", False), ("Travel Zone", False), ("Music Director", False), ("Contact Us", False), ("Ken", False), (None, False)])
def test_persons(spark, raw, want):
    assert one(spark, raw, P.is_person) is want


@pytest.mark.parametrize(("raw", "want"), [("Assistant General Manager", True), ("Station Manager & Program Director", True), ("DJ Roman Angelos", False), ("hello", False)])
def test_role_lines(spark, raw, want):
    assert one(spark, raw, P.is_role_line) is want


@pytest.mark.parametrize(
    ("text", "at", "want"),
    [
        ("Music Director: a@x.org", 0, ("music_director", 0)), ("Music Director\nAnn\na@x.org", 2, ("music_director", -2)), ("Music Director b@x.org\na@x.org", 1, ("unknown", None)),
        ("a@x.org\nPress contact", 0, ("media", 1)), ("Producer\n\n\n\na@x.org", 4, ("unknown", None)), ("Producer\na@x.org\nPress contact", 1, ("producer", -1)),
    ],
)
def test_role_near(spark, text, at, want):
    got = one(spark, text, lambda x: P.role_near(F.split(x, "\n"), F.lit(at)))
    assert (got["role"], got["offset"]) == want


def test_titles_and_queries(spark):
    assert one(spark, "KQXR  88.3 | Official Site ", P.clean_title) == "KQXR 88.3"
    assert one(spark, "Radio KQXR", lambda x: P.names_match(x, F.lit("KQXR home"))) is True
    assert one(spark, "Radio The", lambda x: P.names_match(x, F.lit("the radio"))) is False
    none = F.lit(None).cast("string")
    assert one(spark, None, lambda x: P.search_queries(x, none, none, none, none)) == ["radio stations"]
    assert one(spark, "college", lambda x: P.search_queries(x, F.lit("jazz"), F.lit("Austin"), none, F.lit("US"))) == [
        "college jazz radio stations Austin US", "college jazz radio stations accepting music submissions Austin US", "radio stations Austin US contact"]


@pytest.mark.parametrize(("data", "want"), [(b"ID3\x04x", True), (b"\xff\xfb\x90\x00", True), (b"\xff\xfb\xf0\x00", False), (b"\xff\xe9\x90\x00", False), (b"\xff\xf9\x90\x00", False), (b"RIFF", False), (b"ID3", False), (None, False)])
def test_mp3(spark, data, want):
    assert one(spark, bytearray(data) if data is not None else None, FF.is_mp3, "binary") is want


def test_uploads(spark):
    assert one(spark, bytearray(b""), FF.upload_verdict, "binary")["reason"] == "empty upload"
    assert one(spark, bytearray(b"ID3\x04" + b"0" * 50), lambda x: FF.upload_verdict(x, 10), "binary")["reason"] == "payload exceeds 10 bytes"
    assert one(spark, r"C:\x\..a  b.mp3", FF.safe_filename) == "a b.mp3" and one(spark, None, FF.safe_filename) == FF.DEFAULT_NAME
    assert len(one(spark, "a" * 300 + ".mp3", FF.safe_filename)) == 200


def test_social(spark):
    links = ["https://www.instagram.com/foo/", "https://instagram.com/bar", "https://x.com/foo?s=1", "https://kqxr.org"]
    assert one(spark, links, FF.social_urls, "array<string>") == {"instagram": "https://www.instagram.com/foo", "x": "https://x.com/foo"}
    assert one(spark, "https://www.Instagram.com/Foo/p/1", FF.social_handle) == "instagram.com/foo" and one(spark, " @Foo", FF.social_handle) == "@foo" and one(spark, "@", FF.social_handle) is None


def test_targets(spark):
    got = one(spark, " https://x.org/a ", lambda x: FF.check_targets(x, F.lit("ftp://x.org")))
    assert [tuple(r) for r in got] == [("https://x.org/a", "submission_url")]
