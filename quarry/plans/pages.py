"""Queries on the HTML of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import frontier
from ..operators import html as H
from ..sources import table


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTM1 in patterns: raw title and number of links."""
    return table(spark, sf_dir, "pages").select("page_id", H.title_of(F.col("html")).alias("title"), H.link_count(F.col("html")).alias("links"))


PAGE_TITLES = r"""
SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, len(regexp_extract_all(html, '(?i)<a\s[^>]*href="'))::INT AS links FROM pages
"""


def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTM1: the parsed page, with sizes of its parts."""
    df = table(spark, sf_dir, "pages").select("page_id", H.parse_page(F.col("url"), F.col("html")).alias("p"))
    return df.select("page_id", "p.title", F.length("p.text").alias("text_chars"), F.size("p.links").alias("n_links"), F.size("p.mailtos").alias("n_mailtos"), F.size("p.forms").alias("n_forms"))


def useful_pages(spark: SparkSession, sf_dir: str, budget: int = 5) -> DataFrame:
    """HTM2, FLT20, SRT10, SRT12: links of pages to their own site that are no media and no single items, best first."""
    df = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(H.parse_page(F.col("url"), F.col("html"))["links"]).alias("place", "link"))
    df = df.select("page_id", "place", "url", U.normalize_url(F.col("link.href")).alias("target"), F.col("link.anchor").alias("anchor"))
    own = U.registrable_domain(F.col("url")) == U.registrable_domain(F.col("target"))
    df = df.filter(F.col("target").isNotNull() & own & ~U.media_or_feed(F.col("target")) & ~U.item_page(F.col("target")) & ~U.same_document(F.col("target"), U.normalize_url(F.col("url"))))
    df = df.groupBy("page_id", "target").agg(F.min("place").alias("place"), F.min_by("anchor", "place").alias("anchor"))
    df = df.withColumn("weight", U.link_weight(F.col("target"), F.col("anchor")))
    w = Window.partitionBy("page_id").orderBy(F.desc("weight"), "place")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= budget)


def link_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT12 and HTM2 in rounds: the pages of each site, what the first links to, and what those link to."""
    return frontier.link_rounds(table(spark, sf_dir, "pages"))


QUERIES = {"link_rounds": (link_rounds, None), "page_titles": (page_titles, PAGE_TITLES), "parsed_pages": (parsed_pages, None), "useful_pages": (useful_pages, None)}
