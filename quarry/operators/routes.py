"""Outreach routes: rows from pages, submission facts and contacts, ranked and chosen for each station."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.url import reserved_host
from ..functions.vocabulary import DECISION_ROLES

ROUTE = ["station", "kind", "priority", "confidence", "state", "value", "place"]
# fixed values: (category, priority, confidence in hundredths) of page routes
PAGE_ROUTES = [
    ("send_music", 1, 85), ("submission_guidelines", 1, 85), ("contact", 3, 60), ("dj_directory", 4, 55), ("programming", 4, 55), ("about", 4, 30), ("other", 4, 20),
]


def _lookup(column: Column, at: int) -> Column:
    pairs = [F.lit(x) for row in PAGE_ROUTES for x in (row[0], row[at])]
    return F.create_map(*pairs)[column]


def page_routes(pages: DataFrame) -> DataFrame:
    """From (station, category, url, reachable): pages of plain information are never actionable."""
    acts = F.col("reachable") & ~F.col("category").isin("about", "other")
    state = F.when(acts, "ACTIONABLE").when(~F.col("reachable"), "UNREACHABLE").otherwise("DISCOVERED")
    return pages.select("station", F.concat(F.lit("page_"), "category").alias("kind"), _lookup(F.col("category"), 1).alias("priority"), _lookup(F.col("category"), 2).alias("confidence"), state.alias("state"), F.col("url").alias("value"), F.lit(2).alias("place")).filter("priority is not null")


def submission_routes(submissions: DataFrame) -> DataFrame:
    """From (station, submission_url, verified, submission_email)."""
    link = submissions.filter("submission_url is not null").select("station", F.lit("submission_url").alias("kind"), F.lit(1).alias("priority"), F.lit(90).alias("confidence"), F.when(F.col("verified"), "ACTIONABLE").otherwise("DISCOVERED").alias("state"), F.col("submission_url").alias("value"), F.lit(0).alias("place"))
    mail = submissions.filter("submission_email is not null").select("station", F.lit("submission_email"), F.lit(1), F.lit(85), F.when(real_address(F.col("submission_email")), "ACTIONABLE").otherwise("DISCOVERED"), F.col("submission_email"), F.lit(1))
    return link.union(mail)


def real_address(email: Column) -> Column:
    """An address on a host that is not reserved for tests."""
    return F.coalesce(email != "", F.lit(False)) & ~reserved_host(F.substring_index(email, "@", -1))


def contact_routes(contacts: DataFrame) -> DataFrame:
    """From (station, role, email, phone): music roles, general inboxes, and hosts without a channel; an empty channel is none."""
    contacts = contacts.withColumns({c: F.nullif(c, F.lit("")) for c in ("email", "phone")})
    music, way = F.col("role").isin(DECISION_ROLES), F.coalesce("email", "phone")
    priority = F.when(music & way.isNotNull(), 2).when((F.col("role") == "general") & F.col("email").isNotNull(), 3).when(F.col("role").isin("host", "dj") & way.isNull(), 4)
    confidence = F.when(priority == 2, 72).when(priority == 3, 55).otherwise(35)
    state = F.when((priority < 4) & real_address(F.col("email")), "ACTIONABLE").otherwise("DISCOVERED")
    return contacts.select("station", F.concat(F.lit("contact_"), "role").alias("kind"), priority.alias("priority"), confidence.alias("confidence"), state.alias("state"), way.alias("value"), F.lit(3).alias("place")).filter("priority is not null")


def routes(pages: DataFrame, submissions: DataFrame, contacts: DataFrame) -> DataFrame:
    """All routes with their rank in the station: by priority, then confidence, then kind of source and value."""
    every = submission_routes(submissions).union(page_routes(pages)).union(contact_routes(contacts))
    w = Window.partitionBy("station").orderBy("priority", F.desc("confidence"), "place", "kind", F.asc_nulls_last("value"))
    return every.withColumn("rank", F.row_number().over(w))


def best_route(ranked: DataFrame) -> DataFrame:
    """The first actionable route with a value of each station, by partial minima."""
    usable = ranked.filter("state = 'ACTIONABLE' and value is not null")
    return usable.groupBy("station").agg(F.min_by(F.struct("kind", "priority", "confidence", "value"), "rank").alias("best"))


def intelligence_level(ranked: DataFrame) -> DataFrame:
    """One level for each station: whether it has an actionable first-class route, any route that acts, or only finds."""
    n = lambda when: F.count_if(when)
    level = F.when(n((F.col("state") == "ACTIONABLE") & (F.col("priority") <= 2)) > 0, "ACTIONABLE").when(n(F.col("state") == "ACTIONABLE") > 0, "LIMITED").otherwise("INSUFFICIENT_EVIDENCE")
    return ranked.groupBy("station").agg(level.alias("level"), F.count("*").alias("routes"))
