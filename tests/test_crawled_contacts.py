"""Queries over parsed pages, by plain loops over their sources."""

import html as entities
import re
from pathlib import Path

from pyspark.sql import functions as F

from quarry import plans
from quarry.functions import url as U
from quarry.operators.html import _Reader

PAGES = str(Path("/root/testdata/sf0.01"))


def visible(html):
    body = re.sub(r"(?is)<(script|style|title)[^>]*>.*?</\1>|<!--.*?-->", " ", html)
    return entities.unescape(re.sub(r"<[^>]*>", "\n", body))


def test_addresses_and_numbers_of_pages_equal_patterns(spark):
    """The given pages name no people, so each address is a contact; of pages without one, the first number is."""
    want = set()
    for p in spark.read.parquet(f"{PAGES}/pages.parquet").collect():
        text = visible(p.html)
        mails = {(p.page_id, m.lower(), None) for m in re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", text)}
        numbers = re.findall(r"(?:\+?1[\s.-]?)?(?:\((\d{3})\)|(\d{3}))[\s.-](\d{3})[\s.-](\d{4})", text)
        first = [f"({a or b}) {c}-{d}" for a, b, c, d in numbers if (a or b)[0] not in "01"][:1]
        want |= mails or {(p.page_id, None, n) for n in first}
    got = plans.queries()["crawled_contacts"](spark, PAGES).collect()
    assert {(r.page_id, r.email, r.phone) for r in got} == want and want
    assert {(r["name"], r.role) for r in got} == {(None, "unknown")}


def test_a_page_with_people_gives_their_contacts(spark, tmp_path):
    html = "<title>KQXR</title><body><p>Jane Miller, Music Director</p><p>jane.miller@kqxr.org</p></body>"
    spark.createDataFrame([(1, "https://kqxr.org/staff", html), (2, "https://kqxr.org/", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = plans.queries()["crawled_contacts"](spark, str(tmp_path)).collect()
    assert [(r.page_id, r["name"], r.role, r.email) for r in got] == [(1, "Jane Miller", "music_director", "jane.miller@kqxr.org")]


def test_useful_pages_equal_plain_loops(spark):
    pages = spark.read.parquet(f"{PAGES}/pages.parquet").collect()
    links = [(p.page_id, p.url, k, x["href"], x["anchor"]) for p in pages for k, x in enumerate(_Reader(p.url).page(p.html)["links"])]
    df = spark.createDataFrame(links, "page_id long, url string, place int, href string, anchor string").withColumn("target", U.normalize_url("href"))
    t = F.col("target")
    facts = df.select(
        "*", (U.registrable_domain(F.col("url")) == U.registrable_domain(t)).alias("own"), U.media_or_feed(t).alias("media"), U.item_page(t).alias("item"),
        U.same_document(t, U.normalize_url(F.col("url"))).alias("same"), U.link_weight(t, F.col("anchor")).alias("weight"),
    ).collect()
    by_page = {}
    for r in sorted(facts, key=lambda r: (r.page_id, r.place)):
        if r.target and r.own and not (r.media or r.item or r.same):
            by_page.setdefault(r.page_id, {}).setdefault(r.target, r)  # the first link to a target gives its anchor
    want = set()
    for page, targets in by_page.items():
        best = sorted(targets.values(), key=lambda r: (-r.weight, r.place))[:5]
        want |= {(page, r.target, r.place, r.anchor, r.weight, k) for k, r in enumerate(best, 1)}
    got = plans.queries()["useful_pages"](spark, PAGES).collect()
    assert {(r.page_id, r.target, r.place, r.anchor, r.weight, r["rank"]) for r in got} == want and want
