"""Contacts and next steps of stations: classes, facts over pages, collapse of anonymous values, best actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.people import is_person
from ..functions.score import relevance
from ..functions.vocabulary import DECISION_ROLES
from .merge import latest_per_key

# fixed values: class of route by role
ROUTE_CLASSES = {
    "music_director": "MUSIC_DIRECTOR", "program_director": "PROGRAM_DIRECTOR", "music_programmer": "PROGRAMMING_CONTACT", "music_scheduler": "PROGRAMMING_CONTACT",
    "music_coordinator": "PROGRAMMING_CONTACT", "programming": "PROGRAMMING_CONTACT", "music_submission": "DIRECT_MUSIC_CONTACT", "host": "SHOW_HOST", "dj": "DJ",
    "general": "GENERAL_STATION_CONTACT",
}
# fixed values: relevance of a role, the least first
RELEVANCE = {
    "music_director": 0, "program_director": 1, "music_programmer": 2, "music_submission": 3, "programming": 4, "music_scheduler": 5, "music_coordinator": 6,
    "host": 7, "dj": 8, "media": 9, "booking": 10, "producer": 11, "station_manager": 12, "general_manager": 12, "advertising": 13, "general": 14,
}
RELEVANCE_OF_OTHERS = 20


def looked_up(column: Column, names: dict, default) -> Column:
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), F.lit(default))


def route_class(role: Column) -> Column:
    return looked_up(F.trim(role), ROUTE_CLASSES, "UNKNOWN_ROLE")


def relevance_order(role: Column, confidence: Column) -> list[Column]:
    """Order of contacts: relevance of the role, then confidence, the highest first."""
    return [looked_up(role, RELEVANCE, RELEVANCE_OF_OTHERS), F.desc(confidence)]


def qualified(name: Column, email: Column, role: Column) -> Column:
    """A contact worth keeping: a name, if any, is a person's, and there is an address or a role that decides on music."""
    named = F.coalesce(name, F.lit("")) == ""
    return (named | is_person(name)) & ((F.coalesce(email, F.lit("")) != "") | F.coalesce(role.isin(DECISION_ROLES), F.lit(False)))


def music_contact(contacts: DataFrame, key: str, order: str) -> DataFrame:
    """contacts (role, preferred, name, email, phone, ...) with score: the one of each key to send music to, by relevance, then by having a channel, then the first in order."""
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    preferred = F.coalesce(F.col("preferred"), F.lit(False))
    df = contacts.filter(role.isin(DECISION_ROLES) | preferred).withColumn("score", relevance(role, preferred, F.col("name"))["score"])
    channel = (F.coalesce("email", F.lit("")) != "") | (F.coalesce("phone", F.lit("")) != "")
    return latest_per_key(df, [key], F.col("score"), channel, -F.col(order))


def sighted(rows: DataFrame, key: list[str], value: str, url: str, order: str) -> DataFrame:
    """One fact for each key and value: where it was seen first, and the other addresses in order, each once."""
    seen = rows.groupBy(*key, value, url).agg(F.min(order).alias("_at"))
    facts = seen.groupBy(*key, value).agg(F.array_sort(F.collect_list(F.struct("_at", F.col(url).alias("url")))).alias("_seen"))
    later = F.transform(F.slice("_seen", 2, F.greatest(F.size("_seen") - 1, F.lit(0))), lambda x: x["url"])
    return facts.select(*key, value, F.element_at("_seen", 1)["url"].alias(url), later.alias("also_seen_at"))


def merged_by_email(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One contact for each key and email: the first name and phone that are known, and all sources in order, each once."""
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    sources = rows.groupBy(*key, "email", "source_url").agg(F.min(order).alias("_at")).groupBy(*key, "email").agg(F.array_sort(F.collect_list(F.struct("_at", "source_url"))).alias("_s"))
    return rows.groupBy(*key, "email").agg(known("name"), known("phone")).join(sources, [*key, "email"]).select(*key, "email", "name", "phone", F.transform("_s", lambda x: x["source_url"]).alias("sources"))


def collapse_anonymous(rows: DataFrame, order: str) -> DataFrame:
    """Contacts (station, method, value, name, source_url): those without a name are one for each method and value, with their number."""
    given = rows.filter("name is not null or method is null").select("station", "method", "value", "name", "source_url", F.lit(1).cast("long").alias("observations"))
    rest = rows.filter("name is null and method is not null")
    one = rest.groupBy("station", "method", "value").agg(F.min_by("source_url", F.when(F.col("source_url").isNotNull(), F.col(order))).alias("source_url"), F.count("*").alias("observations"))
    return given.unionByName(one.withColumn("name", F.lit(None).cast("string")).select(given.columns))


def best_actions(stations: DataFrame, pages: DataFrame, submissions: DataFrame, contacts: DataFrame) -> DataFrame:
    """(station, status, kind, url, label): one next step for each station (station, investigated).

    A stored submission address comes first, then the best page for sending music, then a submission e-mail; then a
    contact who decides on music, a contact page, a page of DJs or programming; then whether anyone looked.
    pages: (station, category, url, reachable, ord); submissions: (station, submission_url, submission_email); contacts:
    (station, role, email, phone).
    """
    first = lambda when, order: F.min_by("url", F.when(when, order))
    send = F.col("category").isin("send_music", "submission_guidelines")
    by_page = pages.groupBy("station").agg(
        first(send, F.struct((~F.coalesce("reachable", F.lit(False))).alias("x"), "url")).alias("send_page"), first(F.col("category") == "contact", F.col("ord")).alias("contact_page"),
        first(F.col("category").isin("dj_directory", "programming"), F.col("ord")).alias("show_page"),
    )
    way = F.col("role").isin(DECISION_ROLES) & (F.coalesce("email", "phone").isNotNull())
    rank = F.array_position(F.array(*[F.lit(r) for r in DECISION_ROLES]), F.col("role"))
    who = contacts.filter(way).groupBy("station").agg(F.min(F.struct(rank.alias("rank"), "role", "email", "phone")).alias("who"))
    df = stations.join(by_page, "station", "left").join(submissions, "station", "left").join(who, "station", "left")
    stored = F.when(F.col("submission_url").rlike("^https?://"), F.col("submission_url"))
    direct = F.coalesce(stored, F.col("send_page"), F.concat(F.lit("mailto:"), F.col("submission_email")))
    mail, role = F.col("who.email").isNotNull(), F.col("who.role")
    label = F.when(mail & (role == "music_director"), "Contact music director").when(mail & (role == "program_director"), "Contact program director").when(mail, "Contact music department").when(role == "music_director", "Call music director").otherwise("Call music department")
    cases = [
        (direct.isNotNull(), "DIRECT_SUBMISSION", "submit", direct, F.lit("Send music")),
        (F.col("who").isNotNull(), "CONTACT_FOR_SUBMISSION", "contact", F.concat(F.lit("mailto:"), F.col("who.email")), label),
        (F.col("contact_page").isNotNull(), "CONTACT_FOR_SUBMISSION", "browse", F.col("contact_page"), F.lit("Contact station")),
        (F.col("show_page").isNotNull(), "SHOW_SPECIFIC_OPPORTUNITY", "browse", F.col("show_page"), F.lit("Browse station DJs & programming")),
        (F.col("investigated"), "NO_PUBLIC_SUBMISSION_ROUTE_FOUND", "none", F.lit(None).cast("string"), F.lit("No public submission route found")),
    ]
    out = F
    for when, status, kind, url, text in cases:
        out = out.when(when, F.struct(F.lit(status).alias("status"), F.lit(kind).alias("kind"), url.alias("url"), text.alias("label")))
    nothing = F.struct(F.lit("UNKNOWN").alias("status"), F.lit("none").alias("kind"), F.lit(None).cast("string").alias("url"), F.lit("").alias("label"))
    return df.select("station", out.otherwise(nothing).alias("x")).select("station", "x.*")


# fixed values: why a route of each priority is recommended
WHY = {
    1: "The station explicitly provides a verified route for music submissions.",
    2: "A music decision-maker at the station is on record with a verified contact route.",
    3: "The station provides a verified general contact route; ask to be pointed to the right person.",
    4: "The station names programs/DJs; use this to find genre-relevant people.",
}
NO_ROUTE = "No verified outreach route is yet recorded for this station."


def recommendation(best_priority: Column, best_confidence: Column) -> tuple[Column, Column]:
    """Why the best route is recommended, and how sure that is (confidence in hundredths)."""
    sure = F.when(best_confidence >= 80, "High").when(best_confidence >= 50, "Medium").when(best_confidence.isNotNull(), "Low").otherwise("Unknown")
    return looked_up(best_priority, WHY, NO_ROUTE), sure
