import re

from quarry import plans
from quarry.functions import vocabulary as V
from quarry.operators.html import _Reader


def brute(url, html):
    page = _Reader(url).page(html)
    text = re.sub(r"\s+", " ", f"{page['title'] or ''} {page['text']}").strip()
    host = re.match(r"[a-z]+://([^/?#:]*)", url)[1].lower().removeprefix("www.")
    path = re.match(r"[a-z]+://[^/?#]*([^?#]*)", url)[1] or "/"
    signals = [n for n, p in (("station_keyword", V.STATION_WORDS), ("callsign", V.CALLSIGN), ("frequency", V.FREQUENCY)) if re.search(p, text)]
    if ".".join(host.split(".")[-2:]) in V.PLATFORM_HOSTS:
        return "rejected", "platform host"
    if re.search(V.ITEM_PATH, path):
        return "rejected", "item path"
    if signals:
        return "qualified", ", ".join(signals)
    return ("rejected", "other text") if re.search(V.OTHER_TEXT, text) else ("needs_review", "no signal")


def verdicts(spark, sf_dir):
    return {r["page_id"]: (r["verdict"], r["reason"]) for r in plans.queries()["page_verdicts"](spark, str(sf_dir)).collect()}


def test_signals_far_into_the_page_count(spark, tmp_path):
    filler = "<p>" + "lorem ipsum " * 3000 + "</p>"
    rows = [
        (1, "https://one.org/", f"<html><head><title>Home</title></head><body>{filler}<p>Listen to us on 98.7 FM</p></body></html>"),
        (2, "https://two.org/", f"<html><head><script>var x = '98.7 FM radio station'</script></head><body>{filler}</body></html>"),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = verdicts(spark, tmp_path)
    assert got[1][0] == "qualified" and "frequency" in got[1][1] and got[2] == ("needs_review", "no signal")


def test_verdicts_equal_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert verdicts(spark, sf_dir) == {r["page_id"]: brute(r["url"], r["html"]) for r in pages}
