"""Queries on page addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.vocabulary import LINK_WEIGHTS, TRACKING_PARAMS, TWO_LABEL_SUFFIXES
from ..sources import table


def url_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL1 to URL5 over all pages."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.normalize_url(u).alias("normal"), U.canonical_host(u).alias("host"), U.registrable_domain(u).alias("domain"), U.slugify(U.path(u)).alias("slug"))


def _quoted(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\.', '')"
_DOMAIN = f"""(CASE WHEN len(string_split(h, '.')) >= 3 AND array_to_string(string_split(h, '.')[-2:], '.') IN ({_quoted(TWO_LABEL_SUFFIXES)})
    THEN array_to_string(string_split(h, '.')[-3:], '.') ELSE array_to_string(string_split(h, '.')[-2:], '.') END)"""

URL_NORMAL_FORMS = rf"""
WITH parts AS (
    SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, {_HOST} AS h,
        regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages),
kept AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN ({_quoted(TRACKING_PARAMS)}))) AS ks FROM parts)
SELECT page_id,
    scheme || '://' || h || (CASE WHEN len(p) > 1 THEN (CASE WHEN rtrim(p, '/') = '' THEN '/' ELSE rtrim(p, '/') END) ELSE p END)
        || (CASE WHEN len(ks) > 0 THEN '?' || array_to_string(ks, '&') ELSE '' END) AS normal,
    h AS host, {_DOMAIN} AS domain, trim(regexp_replace(lower(p), '[^a-z0-9]+', '-', 'g'), '-') AS slug
FROM kept
"""


def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL7, URL8, URL10, URL12, URL14, URL16: what an address says about its page."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.coalesce(U.page_role(u), F.lit("none")).alias("role"), U.source_type(u).alias("source_type"), U.media_or_feed(u).alias("media"),
        U.item_page(u).alias("item"), U.link_weight(u, F.lit("")).alias("weight"), U.reserved_host(u).alias("reserved"),
    )


_WEIGHT = ", ".join(f"CASE WHEN regexp_matches(url || ' ', '(?i){p}') THEN {w} ELSE 0 END" for p, w in LINK_WEIGHTS)
PAGE_KINDS = rf"""
WITH parts AS (SELECT *, {_HOST} AS h, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS p, lower(url) AS u FROM pages)
SELECT page_id,
    CASE WHEN contains(u, 'contact') THEN 'contact_page' WHEN regexp_matches(u, 'submi(ssion|t)') THEN 'submission_page'
        WHEN regexp_matches(u, 'program|shows|schedule') THEN 'programming_page' ELSE 'none' END AS role,
    CASE WHEN contains(u, 'submi') THEN 'submission_page' WHEN contains(u, 'contact') THEN 'contact_page' ELSE 'official_website_page' END AS source_type,
    regexp_matches(lower(p), '\.(mp3|m4a|wav|ogg|flac|aac|m3u8?|pls|mp4|mov|avi|webm|jpe?g|png|gif|svg|webp|ico|css|js|json|xml|rss|atom|zip|gz|rar|pdf)$') AS media,
    regexp_matches(p, '\d{{5,}}|/\d{{4,}}(/|$)|/\d{{4}}/\d{{1,2}}(/\d{{1,2}})?(/|$)|[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}') AS item,
    greatest({_WEIGHT}) AS weight, regexp_matches(h, '(^|\.)(example|test|invalid|localhost|local)$') AS reserved
FROM parts
"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG9 and AGG10: pages grouped by registrable domain in order of arrival, with their first address."""
    df = table(spark, sf_dir, "pages").select("page_id", U.normalize_url(F.col("url")).alias("normal"), U.registrable_domain(F.col("url")).alias("domain"))
    return df.groupBy("domain").agg(F.count("*").alias("pages"), F.count_distinct("normal").alias("distinct_urls"), F.min("page_id").alias("first_page"), F.min_by("normal", "page_id").alias("first_url"))


SITES = f"""
WITH forms AS ({URL_NORMAL_FORMS})
SELECT domain, count(*) AS pages, count(DISTINCT normal) AS distinct_urls, min(page_id) AS first_page, arg_min(normal, page_id) AS first_url FROM forms GROUP BY domain
"""


def priority_links(spark: SparkSession, sf_dir: str, budget: int = 3) -> DataFrame:
    """SRT11: the pages of each domain with the largest weights, discovery order on ties, within a budget."""
    df = table(spark, sf_dir, "pages").select("page_id", U.registrable_domain(F.col("url")).alias("domain"), U.link_weight(F.col("url"), F.lit("")).alias("weight"))
    w = Window.partitionBy("domain").orderBy(F.desc("weight"), "page_id")
    return df.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= budget)


PRIORITY_LINKS = f"""
WITH forms AS ({URL_NORMAL_FORMS}), kinds AS ({PAGE_KINDS}),
ranked AS (SELECT page_id, domain, weight, row_number() OVER (PARTITION BY domain ORDER BY weight DESC, page_id) AS place FROM forms JOIN kinds USING (page_id))
SELECT * FROM ranked WHERE place <= 3
"""

QUERIES = {"url_normal_forms": (url_normal_forms, URL_NORMAL_FORMS), "page_kinds": (page_kinds, PAGE_KINDS), "sites": (sites, SITES), "priority_links": (priority_links, PRIORITY_LINKS)}
