"""Views of stored rows: details of stations and performers, channels, pages, recipients, scores after enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import truthy
from ..functions.text import short_slug
from .classify import location_status, research_status
from .contacts import looked_up
from .routes import real_address

# fixed values: class and label of a channel
CHANNEL_CLASSES = {
    "email": "direct", "submission_email": "submission", "submission_page": "submission_webform", "contact_page": "contact_webform", "website": "website",
    "instagram": "social", "x": "social", "facebook": "social", "youtube": "social",
}
CHANNEL_LABELS = {
    "email": "verified direct DJ contact", "submission_email": "official submission contact", "submission_page": "official submission route", "contact_page": "generic contact route",
    "website": "website", "instagram": "social route", "x": "social route", "facebook": "social route", "youtube": "social route",
}
CHANNEL_KINDS = {
    "email": "email", "submission_email": "email", "submission_page": "webform", "contact_page": "webform", "instagram": "social", "x": "social", "facebook": "social", "youtube": "social",
}
SUBMISSION_CHANNELS = ["submission_email", "submission_page", "contact_page"]
# fixed values: fields of a track that a listing shows
TRACK_FIELDS = ["track_id", "sha256", "original_filename", "size_bytes", "content_type", "status", "reject_reason", "notes", "created_at", "updated_at"]
# fixed values: (category, class, kind, why, actionability, next step) of a page
PAGE_SEMANTICS = [
    ("send_music", "DIRECT_MUSIC_SUBMISSION", "Submission route", "Discovered as a station page that explicitly asks artists to send their music.", "High", "Use this verified submission route and follow any stated format/formatting requirements."),
    ("submission_guidelines", "DIRECT_MUSIC_SUBMISSION", "Submission route", "Discovered as the station's official music submission guidelines page.", "High", "Follow the station's stated submission requirements for the best chance of review."),
    ("contact", "GENERAL_CONTACT", "General contact route", "Discovered as the station's official contact page.", "Medium", "Contact the station through this page; mention music submission interest and request the right person/department."),
    ("dj_directory", "DJ_PROGRAM_DIRECTORY", "DJ / program directory", "Discovered as a page that names station DJs or program personalities.", "Medium", "Inspect named personalities for genre relevance and a verified contact route before reaching out."),
    ("programming", "DJ_PROGRAM_DIRECTORY", "Programming / schedule page", "Discovered as the station's programming or schedule page.", "Low", "Identify a relevant show or program director as a candidate music contact."),
    ("about", "DJ_PROGRAM_DIRECTORY", "Station information", "Discovered as official station information.", "Low", "Reference only; not a direct outreach route."),
    ("other", "DJ_PROGRAM_DIRECTORY", "Discovered station page", "Discovered as a station-level page.", "Low", "Review for additional route evidence; not directly actionable."),
]
# fixed values: kind of a recipient by type of route
RECIPIENT_KINDS = {
    "submission_url": "webform", "submission_page": "webform", "submission_email": "email", "contact_email": "email", "contact_page": "contact", "contact_phone": "phone",
    "named_contact": "contact", "directory_page": "dj", "info_page": "webform",
}
# fixed values: order in which pages are checked again
CHECK_ORDER = ["send_music", "submission_guidelines", "dj_directory", "contact", "programming", "about", "other"]
# fixed values: level of a station's route for a contact without an address
FALLBACK_LEVELS = {
    "submission_url": 2, "submission_email": 2, "page_send_music": 2, "page_submission_guidelines": 2, "page_contact": 3, "page_programming": 4, "page_dj_directory": 5,
}


def location(verified_at: str = "last_verified_at") -> Column:
    """The place fields that say something, and their status."""
    known = [F.when(F.trim(c) != "", F.col(c)).alias(c) for c in ("city", "state_or_region", "country", "market_area")]
    status = location_status(F.col("country"), F.col("state_or_region"), F.col("city"), F.col("market_area"), F.col(verified_at))
    return F.struct(*known, status.alias("status"))


def station_detail(rows: DataFrame, grounded: Column) -> DataFrame:
    """All stored columns with location, states and links; grounded: some fact of the row has a source."""
    base = F.concat(F.lit("/api/v1/stations/"), "identity_key")
    links = F.struct(base.alias("self"), F.concat(base, F.lit("/intelligence")).alias("intelligence"), F.concat(base, F.lit("/contacts")).alias("contacts"))
    return rows.select("*", location().alias("location"), research_status(F.col("status"), F.col("confidence_score"), grounded).alias("research_status"), links.alias("links"))


def channel_view(channel: Column) -> Column:
    """(kind, route_class, route_label) of a channel; an unknown one is a website of class other with its own name."""
    label = F.coalesce(looked_up(channel, CHANNEL_LABELS, None), channel)
    return F.struct(looked_up(channel, CHANNEL_KINDS, "website").alias("kind"), looked_up(channel, CHANNEL_CLASSES, "other").alias("route_class"), label.alias("route_label"))


def performer_detail(rows: DataFrame, channels: DataFrame, key: str) -> DataFrame:
    """rows with what their channels (key, channel, value) offer, counted before they are joined."""
    c = channels.withColumn("kind", channel_view(F.col("channel"))["kind"])
    offers = c.groupBy(key).agg(
        (F.count_if(F.col("kind") == "email") > 0).alias("has_email"), F.count_if(F.col("channel").isin(SUBMISSION_CHANNELS)).alias("submission_routes"), F.count_if(F.col("kind") == "social").alias("social_channels"),
    )
    df = rows.join(offers, key, "left")
    df = df.withColumns({"has_email": F.coalesce("has_email", F.lit(False)), **{n: F.coalesce(n, F.lit(0).cast("long")) for n in ("submission_routes", "social_channels")}})
    return df.withColumn("has_submission_route", F.col("submission_routes") > 0)


def track_view(rows: DataFrame) -> DataFrame:
    return rows.select(*TRACK_FIELDS, F.concat(F.lit("/api/v1/tracks/"), "track_id").alias("link"))


def page_view(pages: DataFrame) -> DataFrame:
    """pages (category, reachable, ...) with their evidence and what a page of the category is good for."""
    spark = pages.sparkSession
    known = spark.createDataFrame(PAGE_SEMANTICS, "category string, route_class string, kind string, why string, actionability string, next_step string")  # seven rows
    state = F.when(F.col("reachable"), "VERIFIED").otherwise("DISCOVERED")
    note = F.when(F.col("reachable"), "verified reachable").when(F.col("reachable").isNull(), "discovered link; reachability not yet confirmed").otherwise("discovered link; currently unreachable")
    category = F.when(F.col("category").isin([r[0] for r in PAGE_SEMANTICS]), F.col("category")).otherwise("other")
    df = pages.withColumns({"evidence_state": state, "evidence_note": note, "_known": category})
    return df.join(F.broadcast(known.withColumnRenamed("category", "_known")), "_known").drop("_known")


def recipient(station: Column, route: Column, contact: Column) -> Column:
    """Whom a message goes to by a route (type, value, title, class, source_url), NULL where the route leads nowhere.

    station: (identity_key, name, domain); contact: (contact_uid, name, role, email, source_url), NULL for none.
    """
    text = lambda c: F.nullif(c, F.lit(""))
    kind = looked_up(route["type"], RECIPIENT_KINDS, "webform")
    mail = F.when(F.lower(route["value"]).startswith("mailto:"), text(F.substr(route["value"], F.lit(8))))
    email = F.when(kind == "email", F.coalesce(mail, text(contact["email"])))
    url = F.when(kind.isin("webform", "contact", "dj") & route["value"].startswith("http"), route["value"])
    made = F.concat(F.lit("wf_"), short_slug(F.coalesce(text(station["domain"]), text(route["title"]), F.lit("station"))))
    out = F.struct(
        F.coalesce(text(contact["contact_uid"]), made).alias("contact_uid"), station["identity_key"].alias("identity_key"),
        F.coalesce(text(contact["name"]), text(route["title"]), F.concat(station["name"], F.lit(" submission"))).alias("name"), F.coalesce(text(contact["role"]), text(route["class"]), F.lit("station")).alias("role"),
        F.coalesce(email, F.lit("")).alias("email"), F.coalesce(text(route["source_url"]), contact["source_url"]).alias("source_url"), F.when(email.isNotNull(), "email").otherwise("webform").alias("outreach_class"),
        url.alias("submission_url"), kind.alias("route_kind"), F.when(email.isNull(), F.coalesce(text(route["title"]), kind)).alias("route_label"),
    )
    return F.when(email.isNotNull() | url.isNotNull(), out)


def best_contact_route(contacts: DataFrame, ranked: DataFrame) -> DataFrame:
    """contacts (station, email, ...) with the level and value of their best route: their own address, else the station's best.

    ranked: (station, kind, state, value, rank); only actionable routes with a value count.
    """
    usable = ranked.withColumn("level", looked_up(F.col("kind"), FALLBACK_LEVELS, None)).filter("state in ('ACTIONABLE', 'VERIFIED') and value <> '' and level is not null")
    best = usable.groupBy("station").agg(F.min(F.struct("level", "rank", "value")).alias("_best"))
    own = F.coalesce(real_address(F.col("email")) & F.contains("email", F.lit("@")), F.lit(False))
    df = contacts.join(best, "station", "left")
    return df.withColumn("route_level", F.when(own, 1).otherwise(F.col("_best.level"))).withColumn("route_value", F.when(own, F.concat(F.lit("mailto:"), "email")).otherwise(F.col("_best.value"))).drop("_best")


def check_queue(pages: DataFrame, fetches: DataFrame, budget: int = 8) -> DataFrame:
    """The pages (station, category, url, reachable) of each station to check next, best categories first, within a budget.

    Pages that are known to be reachable, and addresses that were fetched (url, ok), are left out.
    """
    done = fetches.filter("ok").select("url").distinct()
    order = looked_up(F.col("category"), {c: k for k, c in enumerate(CHECK_ORDER)}, len(CHECK_ORDER) - 1)
    left = pages.filter(~F.coalesce("reachable", F.lit(False))).join(done, "url", "left_anti").distinct()
    w = Window.partitionBy("station").orderBy(order, "url", "category")
    return left.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= budget)


def enriched_score(base: Column, genres: Column, instructions: Column, preferred: Column) -> Column:
    """The score after enrichment: more for genres, instructions and a contact for music, in two digits and from 0 to 1."""
    more = F.when(truthy(genres, "array"), 0.03).otherwise(0.0) + F.when(truthy(instructions), 0.04).otherwise(0.0) + F.when(truthy(preferred, "boolean"), 0.03).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.bround(F.coalesce(base, F.lit(0.0)) + more, 2)))


def assign_names(contacts: DataFrame, names: DataFrame, key: str, order: str, place: str) -> DataFrame:
    """contacts (key, role, name, order) without a name get the names (key, role, name, place) of their page and role, one each, in order."""
    open_ones = contacts.filter("name is null").withColumn("_n", F.row_number().over(Window.partitionBy(key, "role").orderBy(order)))
    first = names.groupBy(key, "role", F.lower("name").alias("_low")).agg(F.min(F.struct(F.col(place).alias("p"), "name")).alias("x"))
    found = first.withColumn("_n", F.row_number().over(Window.partitionBy(key, "role").orderBy("x.p"))).select(key, "role", "_n", F.col("x.name").alias("_name"))
    named = open_ones.join(found, [key, "role", "_n"], "left").withColumn("name", F.col("_name")).select(contacts.columns)
    return contacts.filter("name is not null").unionByName(named)
