import pytest
from pyspark.sql import functions as F

from quarry.functions import score as S
from quarry.functions import text as T
from quarry.functions import url as U
from quarry.functions.vocabulary import GENRES, OPPORTUNITY_WEIGHTS


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(function(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("https://station.example/page?z=1&a=2", "https://station.example/page?a=2&z=1"),
        ("https://station.example/page?utm_source=x&id=7", "https://station.example/page?id=7"),
        ("http://WWW.Station.Example/about/#team", "http://station.example/about"),
        ("Station.example", "https://station.example"),
        ("http://h.org/", "http://h.org/"),
        ("http://h.org", "http://h.org"),
        ("http://u:p@h.org:8080//", "http://h.org:8080/"),
        ("ftp://h.org", None), ("file:///etc", None), ("", None), ("not-a-url", None), (None, None), ("http://localhost/x", "http://localhost/x"),
    ],
)
def test_normalize_url(spark, raw, want):
    assert one(spark, raw, U.normalize_url) == want


@pytest.mark.parametrize(("raw", "host", "domain"), [("WWW.Station.example:8080/path", "station.example", "station.example"), ("shop.bbc.co.uk", "shop.bbc.co.uk", "bbc.co.uk"), ("localhost", "localhost", "localhost"), ("https://a.b.c.org/x", "a.b.c.org", "c.org")])
def test_host_and_domain(spark, raw, host, domain):
    assert (one(spark, raw, U.canonical_host), one(spark, raw, U.registrable_domain)) == (host, domain)


def test_slug_weight_reserved(spark):
    assert one(spark, "Radio 88.3 FM!", U.slugify) == "radio-88-3-fm"
    assert one(spark, "https://x.org/submit-music", lambda u: U.link_weight(u, F.lit(""))) == 10
    assert one(spark, "https://x.org/about", lambda u: U.link_weight(u, F.lit("Staff"))) == 5
    assert one(spark, "https://kqxr.example/", U.reserved_host) is True
    assert one(spark, "https://localmusic.org/", U.reserved_host) is False


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("  Info@Station.Example. ", "info@station.example"), ("<music@station.example>,", "music@station.example"), ("music @ station.example", "music@station.example"),
        ("not-an-email", None), ("a@@b.example", None), (".lead@x.example", None), ("trail.@x.example", None), ("double..dot@x.example", None), ("user@domain", None), ("", None), (None, None),
    ],
)
def test_normalize_email(spark, raw, want):
    assert one(spark, raw, T.normalize_email) == want


def test_emails_in_text(spark):
    assert one(spark, "write contact [at] station [dot] example now", T.emails_in) == ["contact@station.example"]
    assert one(spark, "b@x.example, a@x.example, B@X.EXAMPLE.", T.emails_in) == ["b@x.example", "a@x.example"]
    assert one(spark, "contact at station dot org", T.emails_in) == []


def test_email_quality(spark):
    tier = lambda e, d: one(spark, e, lambda x: T.email_quality(x, F.array(F.lit(d)))["tier"])
    assert tier("music@kqxr.example", "kqxr.example") == "professional"
    assert tier("someone@gmail.com", "kqxr.example") == "weak"


def test_phones_roles_votes(spark):
    assert one(spark, "call 1-415-555-0134 or (415) 555 0134, not 015-555-0134 nor 4155550134", T.phones_in) == ["(415) 555-0134"]
    assert one(spark, "Jane, Music Director", T.role_of) == "music_director"
    assert one(spark, "nothing here", T.role_of) == "unknown"
    assert one(spark, "jazz jazz jazz jazz and blues, a rapper", lambda x: T.vote(x, GENRES, 8)) == ["jazz", "blues", "hip_hop"]
    assert [r["restriction"] for r in one(spark, "No attachments. MP3 links only, no phone calls", T.restrictions_in)] == ["no_attachments", "digital_only", "no_phone_calls"]


def test_instructions(spark):
    assert one(spark, "Hello. Please send your   music to us! Bye.", T.instructions_in) == "Please send your music to us!"
    assert one(spark, "Hello.", T.instructions_in) is None


def test_claim_values(spark):
    value = lambda kind, raw: one(spark, raw, lambda x: T.claim_value(F.lit(kind), x))
    assert value("url", "HTTPS://X.org/a/#b") == "https://x.org/a/"
    assert value("text", " A \n B ") == "a b"
    assert value("email", "nobody") is None and value("text", "  ") is None


def test_route_scores(spark):
    got = [one(spark, p, lambda x: S.route_component(F.lit(True), x, F.lit("contact"), F.lit(True)), "int") for p in (1, 2, 3, 4)]
    assert got == [1.0, 0.75, 0.5, 0.3]
    assert one(spark, None, lambda x: S.route_component(F.lit(False), x, x.cast("string"), F.lit(True)), "int") == 0.25
    assert one(spark, None, lambda x: S.route_component(F.lit(False), x, x.cast("string"), F.lit(False)), "int") == 0.1
    assert sum(OPPORTUNITY_WEIGHTS.values()) == 100


def test_penalty_is_the_difference(spark):
    parts = {k: F.lit(0.5) for k in OPPORTUNITY_WEIGHTS}
    plain, lower = (one(spark, c, lambda x: S.opportunity(parts, x), "boolean") for c in (False, True))
    assert (plain["score"], lower["score"], lower["penalty"]) == (50, 38, 12)
    assert plain["tier"] == "MEDIUM" and plain["signs"] == "iiiiiiii"


def test_broken_site_scores_low(spark):
    none = F.lit(None)
    score = one(spark, False, lambda up: S.station_score(up, F.lit("x.org"), none.cast("boolean"), none, F.lit(False), F.lit(False), F.lit(False), none, F.lit("unknown"), F.lit(1)), "boolean")
    assert score < 0.3
