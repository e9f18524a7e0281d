import random
import re

import pytest

from quarry import plans
from quarry.operators import frontier


def rounds(pages, links, sites, number, budget):
    """Round by round in plain loops; links: (url, target) to (weight, place)."""
    there = set(pages)
    seen, out, now = set(), [], []
    for site in set(sites.values()):
        url = min((u for u in pages if sites[u] == site), key=lambda u: (len(u), u))
        now.append((site, 1, url))
        out.append((site, 0, 1, url, 0, True))
        seen.add(url)
    for k in range(1, number + 1):
        best = {}
        for site, rank, url in now:
            for (u, target), (weight, place) in links.items():
                if u == url and url in there and target not in seen:
                    best[site, target] = min(best.get((site, target), (1,)), (-weight, rank, place))
        now = []
        for site in set(sites.values()):
            mine = sorted((x, t) for (s, t), x in best.items() if s == site)[:budget]
            for rank, (x, t) in enumerate(mine, 1):
                out.append((site, k, rank, t, -x[0], t in there))
                seen.add(t)
                if t in there:
                    now.append((site, rank, t))
    return sorted(out)


def check(spark, df, got, number, budget):
    links = {(r.url, r.target): (r.weight, r.place) for r in frontier.page_links(df).collect()}
    from quarry.functions import url as U
    from pyspark.sql import functions as F

    sites = {r.u: r.s for r in df.select(U.normalize_url("url").alias("u")).select("u", U.registrable_domain(F.col("u")).alias("s")).filter("u IS NOT NULL").collect()}
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == rounds(set(sites), links, sites, number, budget)
    urls = [r[3] for r in rows]
    assert len(urls) == len(set(urls))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_rounds_equal_plain_loops(spark, seed):
    rng = random.Random(seed)
    words = ["contact", "about", "music", "staff", "submit", "shows", "news", "x", "listen", "dj"]
    names = [f"/{w}/{k}" for w in words for k in range(4)] + ["/"]
    rows = []
    for site in ("one.org", "two.org", "three.co.uk"):
        for path in rng.sample(names, 25) + ["/"]:
            links = "".join(f'<a href="{rng.choice(["", "https://" + site])}{rng.choice(names)}">{rng.choice(words)}</a>' for _ in range(rng.randint(0, 12)))
            rows.append((f"https://{site}{path}", f"<html><title>t</title><body>{links}<a href='https://else.org/contact'>contact</a></body></html>"))
    rows += [(None, "<a href='/contact'>c</a>"), ("no address", "<a href='/contact'>c</a>"), (rows[0][0], None), rows[1]]
    df = spark.createDataFrame(rows, "url string, html string")
    got = check(spark, df, frontier.link_rounds(df, rounds=3, budget=3), 3, 3)
    assert {r[1] for r in got} == {0, 1, 2, 3}


def test_query_equals_plain_loops(spark, sf_dir):
    check(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), plans.queries()["link_rounds"](spark, sf_dir), 2, 5)


def test_links_of_a_page_follow_the_rules_of_anchors(spark):
    html = '<a href="/contact"> Con<b>tact</b>  us </a><a href="/about">never closed <a href="/music">inner</a><a href="mailto:a@b.org?x=1">m</a><a href="/open">'
    df = spark.createDataFrame([("https://s.org/", html)], "url string, html string")
    from quarry.operators.html import _Reader

    page = _Reader("https://s.org/").page(html)
    assert [(x["href"], x["anchor"]) for x in page["links"]] == [("https://s.org/contact", "Contact us"), ("https://s.org/music", "inner")]
    assert page["mailtos"] == ["a@b.org"]
    assert {r.target for r in frontier.page_links(df).collect()} <= {"https://s.org/contact", "https://s.org/music"}


@pytest.mark.parametrize("html,title,text", [
    ("<title>A  b</title><p>x</p>", "A b", "x"), ("<title>never closed<p>one</p>", None, None), ("<title>" + "t" * 301 + "</title><p>x", None, "t" * 301 + "\nx"), ("<title>" + "t" * 300 + "</title>", "t" * 300, ""),
])
def test_titles_by_the_rule(html, title, text):
    from quarry.operators.html import _Reader

    page = _Reader("https://s.org/").page(html)
    if text is None:  # how much of it the parser gives as one piece is the parser's
        assert "one" in page["text"] or page["title"]
    else:
        assert (page["title"], page["text"]) == (title, text)


def test_parsed_pages_equal_patterns(spark, sf_dir):
    """The given pages are well formed, so plain patterns find the same parts."""
    import html as entities

    got = {r.page_id: r for r in plans.queries()["parsed_pages"](spark, sf_dir).collect()}
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", "", p.html)
        title = re.search(r"(?is)<title[^>]*>(.*?)</title>", body)
        want = " ".join(entities.unescape(title[1]).split()) if title else ""
        assert (got[p.page_id].title or "") == want
        hrefs = [h for h in re.findall(r'(?i)<a\s[^>]*href="([^"]*)"', body) if h.strip()]
        assert got[p.page_id].n_links + got[p.page_id].n_mailtos == len(hrefs)
        assert got[p.page_id].n_forms == len(re.findall(r"(?i)<form\b", body))


def test_a_batch_of_pages_is_not_held_as_objects():
    import tracemalloc

    import pyarrow as pa
    from quarry.operators.html import parsed

    page = "".join(f'<p><a href="/x{k}">a{k}</a></p>' for k in range(100))
    urls, pages = pa.array(["https://a.org/"] * 2000), pa.array([page] * 2000)
    tracemalloc.start()
    out = parsed(urls, pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 2000 and out[1999].as_py()["links"][99] == {"href": "https://a.org/x99", "anchor": "a99"}
    assert peak < 10_000_000  # 64 pages of 100 links; all at once take some 100 MB
    assert len(parsed(urls[:0], pages[:0])) == 0 and parsed(pa.array([None], pa.string()), pa.array([None], pa.string()))[0].as_py()["links"] == []
