"""Score columns.  Scores are sums of whole hundredths, so rounding to two digits meets no ties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import email_quality
from .url import reserved_host, source_type
from .vocabulary import CONTACT_LEVEL_SCORE, CONTACTED_PENALTY, DECISION_ROLES, FREE_PROVIDERS_OF_CONTACTS, HIGH, MEDIUM, MUSIC_ROLES, OPPORTUNITY_WEIGHTS, ROUTE_PRIORITY_SCORE, SOURCE_STRENGTH


def truthy(c: Column, kind: str = "string") -> Column:
    """Neither NULL nor empty, 0 or false."""
    test = {"string": c != "", "array": F.size(c) > 0, "boolean": c, "number": c != 0}[kind]
    return F.coalesce(test, F.lit(False))


def points(*parts: tuple[Column, int]) -> Column:
    """Sum of the points of the conditions that hold."""
    total = F.lit(0)
    for when, n in parts:
        total = total + F.when(when, n).otherwise(0)
    return total


def station_score(reachable: Column, website: Column, name_matches: Column, contact_url: Column, emails: Column, own_email: Column, free_only: Column, submission_url: Column, station_type: Column, n_sources: Column) -> Column:
    """Confidence in a station record, 0 to 1.  emails: whether it has any."""
    up, any_mail = truthy(reachable, "boolean"), truthy(emails, "boolean")
    own = any_mail & truthy(own_email, "boolean")
    free = any_mail & ~own & truthy(free_only, "boolean")
    total = points(
        (up, 25), (~up, -30), (truthy(website), 10), (truthy(name_matches, "boolean"), 15), (~truthy(name_matches, "boolean") & up, -15),
        (truthy(contact_url), 15), (own, 20), (free, 3), (any_mail & ~own & ~free, 10), (truthy(submission_url), 15),
        (truthy(station_type) & (station_type != "unknown"), 5), (F.coalesce(n_sources, F.lit(0)) >= 2, 10),
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), total)) / 100


def contact_score(source_url: Column, email: Column, name: Column, role: Column, domains: Column) -> Column:
    """Confidence in a contact, 0.05 to 0.95."""
    kind = source_type(source_url)
    mail = truthy(email)
    own = mail & email_quality(email, domains)["matches_station_domain"]
    free = mail & F.substring_index(email, "@", -1).isin(FREE_PROVIDERS_OF_CONTACTS)
    source = F.when(kind == "submission_page", 15).when(kind == "contact_page", 12).otherwise(8)
    total = 30 + source + points((own, 25), (free, -10), (truthy(name), 15), (F.coalesce(role.isin(MUSIC_ROLES), F.lit(False)), 15))
    return F.greatest(F.lit(5), F.least(F.lit(95), total)) / 100


def relevance(role: Column, preferred: Column, name: Column) -> Column:
    """(score in hundredths, label) of a contact for music outreach."""
    role = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    base = F.when(role.isin(DECISION_ROLES), 80).when(role.isin("host", "dj"), 50).when(role == "general", 30).otherwise(0)
    base = F.when(truthy(preferred, "boolean"), F.greatest(base, F.lit(90))).otherwise(base)
    score = F.least(F.lit(100), base + F.when(truthy(name), 5).otherwise(0))
    return F.struct(score.alias("score"), F.when(score >= 75, "High").when(score >= 45, "Medium").otherwise("Low").alias("label"))


def route_component(has_route: Column, priority: Column, kind: Column, any_value: Column) -> Column:
    by_priority = F.lit(0.3)
    for p, s in ROUTE_PRIORITY_SCORE.items():
        by_priority = F.when(priority == p, s).otherwise(by_priority)
    scored = F.when(kind.isin("submission_url", "submission_email"), 1.0).when(kind == "submission_page", 0.9).otherwise(by_priority)
    return F.when(truthy(has_route, "boolean"), scored).when(truthy(any_value, "boolean"), 0.25).otherwise(0.1)


def contact_component(has_contact: Column, level: Column) -> Column:
    by_level = F.lit(0.35)
    for k, s in CONTACT_LEVEL_SCORE.items():
        by_level = F.when(level == k, s).otherwise(by_level)
    return F.when(~truthy(has_contact, "boolean"), 0.1).when(level.isNull(), 0.35).otherwise(by_level)


def as_list(text: Column) -> Column:
    """Distinct entries of a delimited string in small letters."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,;/]"), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def genre_component(release: Column, station: Column) -> Column:
    shared = F.size(F.array_intersect(release, station))
    match = F.least(F.lit(1.0), 0.5 + shared / F.size(F.array_union(release, station)))
    return F.when(~truthy(release, "array"), 0.4).when(~truthy(station, "array"), 0.5).when(shared == 0, 0.0).otherwise(match)


def format_component(formats: Column) -> Column:
    return F.when(F.array_contains(formats, "music"), 1.0).when(truthy(formats, "array"), 0.3).otherwise(0.5)


def record_component(*checks: Column) -> Column:
    return points(*[(c, 1) for c in checks]) / len(checks)


def identity_component(domain: Column, status: Column) -> Column:
    known = F.lower(F.coalesce(status, F.lit(""))).isin("enriched", "verified", "verifying")
    return F.when(~truthy(domain), 0.4).when(reserved_host(domain), 0.6).when(known, 1.0).otherwise(0.8)


def location_component(city: Column, market: Column) -> Column:
    return F.when(truthy(city) | truthy(market), 0.9).otherwise(0.5)


def release_component(status: Column) -> Column:
    return F.when(F.lower(F.coalesce(status, F.lit(""))) == "ready", 1.0).otherwise(0.3)


def opportunity(components: dict[str, Column], contacted: Column) -> Column:
    """(score 0 to 100, tier, penalty, signs) of a weighted sum; half goes to even, and who was contacted loses points."""
    total = sum((F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), components[k])), 4) * w for k, w in OPPORTUNITY_WEIGHTS.items()), start=F.lit(0.0))
    raw = F.bround(F.round(total, 6), 0).cast("int")
    penalty = F.when(truthy(contacted, "boolean"), F.least(F.lit(CONTACTED_PENALTY), raw)).otherwise(0)
    score = raw - penalty
    tier = F.when(score >= HIGH, "HIGH").when(score >= MEDIUM, "MEDIUM").otherwise("LOW")
    order = sorted(OPPORTUNITY_WEIGHTS, key=lambda k: -OPPORTUNITY_WEIGHTS[k])
    signs = F.concat_ws("", *[F.when(components[k] >= 0.75, "+").when(components[k] <= 0.35, "-").otherwise("i") for k in order])
    return F.struct(score.alias("score"), tier.alias("tier"), penalty.alias("penalty"), signs.alias("signs"))


def source_strength(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in SOURCE_STRENGTH.items() for x in pair])[kind], F.lit(0))


def age_days(at: Column, now: Column) -> Column:
    """Days from a timestamp text to now, 0 at least; NULL if it is no timestamp."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(F.try_to_timestamp(at))) / 86400e6)


def is_stale(at: Column, now: Column, most: int) -> Column:
    return F.coalesce(age_days(at, now) > most, F.lit(False))
