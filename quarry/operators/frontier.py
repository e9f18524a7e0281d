"""Pages of sites in rounds: what a crawl reads first, then what the pages it has read link to, a few best of each site a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U
from .dedupe import _written
from .html import parse_page


def page_links(pages: DataFrame) -> DataFrame:
    """(url, site, target, weight, place): the links of pages (url, html) to their own site that are worth reading, each target once a page.

    Addresses are in their normal form.  Pages whose own address has none link to nothing.
    """
    df = pages.select(U.normalize_url("url").alias("url"), F.posexplode(parse_page(F.col("url"), F.col("html"))["links"]).alias("place", "link"))
    df = df.select("url", U.registrable_domain(F.col("url")).alias("site"), U.normalize_url(F.col("link.href")).alias("target"), F.col("link.anchor").alias("anchor"), "place")
    df = df.filter(F.col("target").isNotNull() & (U.registrable_domain(F.col("target")) == F.col("site")))
    df = df.withColumn("weight", U.link_weight(F.col("target"), F.col("anchor"))).filter("weight > 0 AND target <> url")
    best = F.max(F.struct("weight", (-F.col("place")).alias("back")))
    return df.groupBy("url", "site", "target").agg(best.alias("x")).select("url", "site", "target", F.col("x.weight").alias("weight"), (-F.col("x.back")).cast("int").alias("place"))


def link_rounds(pages: DataFrame, rounds: int = 2, budget: int = 5) -> DataFrame:
    """(site, round, rank, url, weight, there): which addresses are read in which round.

    Round 0 reads the page of each site whose address is the shortest, then the first in order.  Each later round takes
    links of the pages read in the round before, but those of addresses already chosen, best weight first, then in order
    of the pages' rank and the link's place, at most `budget` of a site.  there: pages has it; only such pages lead on.
    Pages are parsed once; what is chosen is written each round, so that no address is read twice.  pages: (url, html),
    of an address in several rows the links of all.
    """
    links = _written(page_links(pages))
    known = _written(pages.select(U.normalize_url("url").alias("url")).filter("url IS NOT NULL").distinct())
    sited = known.select(U.registrable_domain(F.col("url")).alias("site"), "url")
    first = sited.groupBy("site").agg(F.min(F.struct(F.length("url").alias("n"), "url")).alias("x"))
    now = _written(first.select("site", F.lit(0).alias("round"), F.lit(1).alias("rank"), F.col("x.url").alias("url"), F.lit(0).alias("weight"), F.lit(True).alias("there")))
    chosen = [now]
    for number in range(1, rounds + 1):
        seen = chosen[0]
        for part in chosen[1:]:
            seen = seen.unionByName(part)
        from_ = now.filter("there").select("url", F.col("rank").alias("of"))
        found = from_.join(links, "url").groupBy("site", "target").agg(F.min(F.struct((-F.col("weight")).alias("less"), "of", "place")).alias("x"))
        fresh = found.join(seen.select("site", F.col("url").alias("target")), ["site", "target"], "left_anti")
        order = Window.partitionBy("site").orderBy("x", "target")
        top = fresh.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= budget)
        top = top.join(known.select(F.col("url").alias("target"), F.lit(True).alias("there")), "target", "left")
        now = _written(top.select("site", F.lit(number).alias("round"), "rank", F.col("target").alias("url"), (-F.col("x.less")).alias("weight"), F.coalesce("there", F.lit(False)).alias("there")))
        chosen.append(now)
    out = chosen[0]
    for part in chosen[1:]:
        out = out.unionByName(part)
    return out
