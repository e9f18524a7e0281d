"""Nested documents of stations: stored JSON decoded, views of contacts, a recommendation, and all of it as one row.

Everything here is keyed by station.  Over tables that are bucketed by it nothing is exchanged: lists are ranked and
gathered, and joined to their station, where their rows are.  Routes come from a union of three sources, which moves
when it is joined; where they are stored by station too, as a table of their own, they do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import relevance, truthy
from ..functions.vocabulary import DECISION_ROLES
from .classify import location_status
from .contacts import recommendation, route_class
from .records import unknown_fields
from .views import PAGE_SEMANTICS, best_contact_route, page_view

ROUTE = ["kind", "priority", "confidence", "state", "value"]
# fixed values: what is not known of a station, in this order
UNKNOWN = ["station locality", "verified direct music submission route", "verified named music decision-maker", "verified contact information"]
# fixed values: what shows a route, by its kind
EVIDENCE = {"submission_url": "Submission URL recorded from the station site.", "submission_email": "Submission email recorded from the station site."}


def _without(fields: Column, names: list[str]) -> Column:
    return F.map_filter(fields, lambda k, _: ~k.isin(names))


def decoded(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """rows with their JSON text columns decoded as these types: `array<...>`, `map<...>` or `struct<...>`.

    No text, an empty one and one that is no JSON give an empty list, an empty map, or a struct of nulls; `_broken` names
    the columns whose text is no JSON.  A value of another kind than the type gives NULL.  Fields that a struct's type
    does not have are kept, as JSON texts by name, in `<column>_more`, so a type may follow its data later.
    """
    broken, out = [], {}
    for name, kind in fields.items():
        text = F.nullif(F.col(name), F.lit(""))
        value = F.try_parse_json(text)
        broken.append(F.when(text.isNotNull() & value.isNull(), F.lit(name)))
        empty = F.from_json(F.lit("[]" if kind.startswith("array") else "{}"), kind)
        out[name] = F.when(value.isNull(), empty).otherwise(F.try_variant_get(value, "$", kind))
        if kind.startswith("struct"):
            known = rows.sparkSession.createDataFrame([], kind[kind.index("<") + 1 : -1]).columns
            rest = _without(F.try_variant_get(value, "$", "map<string,variant>"), known)
            out[f"{name}_more"] = F.coalesce(F.transform_values(rest, lambda _, v: F.to_json(v)), F.create_map().cast("map<string,string>"))
    return rows.withColumns({**out, "_broken": F.array_compact(F.array(*broken))})


def recommended(stations: DataFrame, ranked: DataFrame, pages: DataFrame, contacts: DataFrame) -> DataFrame:
    """(station, route, why, sure, evidence, fallback, unknown, routes) of each of stations (station, city, market_area).

    The best route is the first one that acts; the fallback is the first other with a value, else the first of all, so
    a station whose only route acts falls back to that one.  What is unknown: a place, a route for sending music, the
    address of someone who decides on music, and anything verified.
    ranked: routes of `operators.routes`; pages: (station, reachable); contacts: (station, role, email).
    """
    route, valued = F.struct(*ROUTE), truthy(F.col("value"))
    acts = valued & (F.col("state") == "ACTIONABLE")
    df = ranked.withColumn("_nth", F.when(valued, F.count_if(valued).over(Window.partitionBy("station").orderBy("rank"))))
    first = lambda when: F.min_by(route, F.when(when, F.col("rank")))
    found = df.groupBy("station").agg(
        first(acts).alias("route"), F.min(F.when(acts, F.col("rank"))).alias("_at"), first(F.lit(True)).alias("_any"), first(F.col("_nth") == 1).alias("_one"), F.min(F.when(F.col("_nth") == 1, F.col("rank"))).alias("_one_at"),
        first(F.col("_nth") == 2).alias("_two"), F.count("*").alias("routes"), F.max(F.col("priority") == 1).alias("_direct"), F.max(F.col("state") == "ACTIONABLE").alias("_verified"),
    )
    seen = pages.groupBy("station").agg(F.max(F.coalesce("reachable", F.lit(False))).alias("_seen"))
    people = contacts.filter(F.col("role").isin(DECISION_ROLES) & truthy(F.col("email"))).select("station", F.lit(True).alias("_person")).distinct()
    df = stations.join(found, "station", "left").join(seen, "station", "left").join(people, "station", "left")
    fallback = F.when(F.col("_at").isNull(), F.col("_any")).when(F.col("_one_at") != F.col("_at"), F.col("_one")).otherwise(F.coalesce("_two", "_any"))
    is_known = [truthy(F.col("city")) | truthy(F.col("market_area")), F.coalesce("_direct", F.lit(False)), F.coalesce("_person", F.lit(False)), F.coalesce("_verified", F.lit(False)) | F.coalesce("_seen", F.lit(False))]
    unknown = F.array_compact(F.array(*[F.when(~known, F.lit(text)) for known, text in zip(is_known, UNKNOWN, strict=True)]))
    why, sure = recommendation(F.col("route.priority"), F.col("route.confidence"))
    reasons = {**EVIDENCE, **{f"page_{c}": text for c, _, _, text, _, _ in PAGE_SEMANTICS}}
    role = F.replace(F.substring_index("route.kind", "contact_", -1), F.lit("_"), F.lit(" "))
    evidence = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in reasons.items() for x in pair]), F.col("route.kind")), F.concat(F.lit("Listed as "), role, F.lit(" on the station site.")))
    return df.select("station", "route", why.alias("why"), sure.alias("sure"), evidence.alias("evidence"), fallback.alias("fallback"), unknown.alias("unknown"), F.coalesce("routes", F.lit(0)).alias("routes"))


def _same_number(raw: Column) -> Column:
    digits = F.regexp_replace(F.regexp_replace(raw, r"\D", ""), r"^1(?=\d{10}$)", "")
    return F.when(F.length(digits) == 10, F.concat(F.lit("+1"), digits)).otherwise(raw)


def contact_views(contacts: DataFrame, ranked: DataFrame) -> DataFrame:
    """contacts (station, uid, role, name, email, phone, source_url, sources, preferred, ord) as a reader sees them, those without name and role once for each value.

    Adds the way to reach a contact and its value as written and in normal form, how its identity is known, how well it
    is shown and why it has its role, class and relevance, the best route, and whether a message can be sent.  Repeated
    sightings of a value without name and role are counted, the first stands for all, with all their sources in order of
    first sight.  ranked: routes of the stations.
    """
    mail, tel, name, role = truthy(F.col("email")), truthy(F.col("phone")), truthy(F.trim("name")), F.trim(F.coalesce("role", F.lit("")))
    has_role = (role != "") & (role != "unknown")
    raw = F.when(mail, F.col("email")).when(tel, F.col("phone"))
    why = F.when(has_role, F.concat(F.replace(role, F.lit("_"), F.lit(" ")), F.lit(" - role label on station website"))).when(name, "named contact from station website").otherwise("observed contact from station website")
    level = relevance(role, F.col("preferred"), F.trim("name"))
    identity = F.when(name, "named").when(has_role & (F.lower(role) != "unknown"), "role_based").otherwise("unattributed_observation")
    all_sources = F.filter(F.concat(F.array("source_url"), F.coalesce("sources", F.array().cast("array<string>"))), lambda u: truthy(u))
    rest = [c for c in contacts.columns if c not in ("station", "source_url", "sources")]
    df = contacts.withColumns({"method": F.when(mail, "email").when(tel, "phone"), "value_normalized": F.when(mail, F.lower(F.trim("email"))).otherwise(_same_number(raw)), "identity_state": identity, "_all": all_sources})
    alone = (F.col("identity_state") != "unattributed_observation") | F.col("method").isNull()
    # rows that stay alone never meet: each is a group by its own place, with its sources at hand
    df = df.withColumn("_own", F.when(alone, F.array_distinct("_all")))
    none = F.array(F.struct(F.lit(None).cast("int").alias("p"), F.lit(None).cast("string").alias("u")))
    sighted = F.when(alone | (F.size("_all") == 0), none).otherwise(F.transform("_all", lambda u, p: F.struct(p.alias("p"), u.alias("u"))))
    group = ["station", F.when(~alone, F.col("method")).alias("_m"), F.when(~alone, F.col("value_normalized")).alias("_v"), F.when(alone, F.col("ord")).alias("_o")]
    keys, kept = ["station", "_m", "_v", "_o"], [*rest, "method", "value_normalized", "identity_state", "_own"]
    # first by source, then by value: every sighting has one row without a place or with the first one
    each = df.select(*group, "ord", "source_url", F.struct(*kept).alias("x"), F.explode(sighted).alias("_s")).groupBy(*keys, F.col("_s.u").alias("_u")).agg(
        F.min(F.struct("ord", "_s.p")).alias("_at"), F.min_by("x", "ord").alias("x"), F.min(F.when(truthy(F.col("source_url")), F.struct("ord", "source_url"))).alias("_url"), F.count_if(F.coalesce("_s.p", F.lit(0)) == 0).alias("n"),
    )
    views = each.groupBy(*keys).agg(
        F.min_by("x", "x.ord").alias("x"), F.min("_url").alias("_url"), F.sum("n").alias("observations"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_u").isNotNull(), F.struct("_at", "_u")))), lambda s: s["_u"]).alias("sources"),
    ).select("station", "x.*", F.col("_url.source_url").alias("source_url"), "sources", "observations")
    views = views.withColumn("sources", F.coalesce("_own", "sources")).drop("_own")
    # what follows from a contact's own fields is added last, and does not move with it
    views = views.withColumns({
        "value_raw": raw, "evidence_state": F.when(mail, "VERIFIED").when(tel, "EVIDENCE-BACKED").otherwise("DISCOVERED"), "role_reason": why, "route_class": route_class(role), "relevance": level["score"], "relevance_label": level["label"],
    })
    return best_contact_route(views, ranked).withColumn("can_add_to_campaign", F.col("route_value").isNotNull())


def listed(children: DataFrame, name: str, order: list[Column], fields: list[str], most: int) -> DataFrame:
    """(station, name, n_name): the first `most` children of each station as a list of these fields in order, and the number of all."""
    df = children.withColumn("_at", F.row_number().over(Window.partitionBy("station").orderBy(*order)))
    # the last place is the number of all, so that no second pass and no unbounded list is needed
    lists = df.groupBy("station").agg(F.array_sort(F.collect_list(F.when(F.col("_at") <= most, F.struct("_at", *fields)))).alias("l"), F.max("_at").cast("long").alias(f"n_{name}"))
    return lists.select("station", F.transform("l", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name), f"n_{name}")


CONTACT_FIELDS = [
    "uid", "name", "role", "method", "value_raw", "value_normalized", "identity_state", "observations", "evidence_state", "role_reason", "sources", "route_class", "relevance", "relevance_label", "preferred", "route_level", "route_value",
    "can_add_to_campaign",
]
PAGE_FIELDS = ["category", "url", "evidence_state", "evidence_note", "kind", "route_class", "actionability"]


def station_documents(stations: DataFrame, facts: DataFrame, contacts: DataFrame, submissions: DataFrame, pages: DataFrame, ranked: DataFrame, actions: DataFrame, levels: DataFrame, most: int = 200) -> DataFrame:
    """(station, document): all that is stored and derived of each of stations, as one nested row.

    Lists hold the first `most` entries, the number of all beside them (`counts`); later entries are pages of their own
    (`operators.listing.page`).  stations: records in normal form; facts: (station, kind email or phone, value,
    source_url); submissions: (station, submission_url, submission_email), one row for each station that has one;
    pages: (station, category, url, reachable, ord); actions, levels: of `best_actions` and `intelligence_level`.
    """
    by_value = [F.col("value"), F.col("source_url").asc_nulls_first()]
    views = contact_views(contacts, ranked)
    parts = [listed(facts.filter(F.col("kind") == k), n, by_value, ["value", "source_url"], most) for k, n in (("email", "emails"), ("phone", "phone_numbers"))]
    parts.append(listed(views, "contacts", [F.col("ord")], CONTACT_FIELDS, most))
    parts.append(listed(contacts.filter("preferred"), "preferred_contacts", [F.col("ord")], ["uid", "role", "email"], most))
    parts.append(listed(ranked, "outreach_routes", [F.col("rank")], ROUTE, most))
    parts.append(listed(page_view(pages), "useful_pages", [F.col("ord")], PAGE_FIELDS, most))
    n_rows = contacts.groupBy("station").agg(F.count("*").alias("_stored"))
    best = recommended(stations.select("station", "city", "market_area"), ranked, pages, contacts)
    df = stations.join(submissions.withColumn("_sub", F.lit(True)), "station", "left")
    for part in [*parts, n_rows, levels.select("station", "level"), actions.select("station", F.struct("status", "kind", "url", "label").alias("best_action")), best.select("station", F.struct("route", "why", "sure", "evidence", "fallback", "unknown", "routes").alias("recommendation"))]:
        df = df.join(part, "station", "left")
    names = ["emails", "phone_numbers", "contacts", "preferred_contacts", "outreach_routes", "useful_pages"]
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    df = df.withColumns({**{n: F.coalesce(n, F.array()) for n in names}, **{f"n_{n}": zero(f"n_{n}") for n in names}, "_sub": F.coalesce("_sub", F.lit(False))})
    gaps = unknown_fields(F.col("n_emails"), zero("_stored"), F.col("_sub"), F.col("submission_email"))
    facts_count = F.col("n_emails") + F.col("n_phone_numbers") + zero("_stored") + F.when(truthy(F.col("source_urls"), "array"), 1).otherwise(0)
    where = location_status(F.col("country"), F.col("state_or_region"), F.col("city"), F.col("market_area"), F.col("last_verified_at"))
    document = F.struct(
        F.struct("identity_key", "name", "domain", "country", "city", where.alias("location_status")).alias("station"), F.coalesce("level", F.lit("INSUFFICIENT_EVIDENCE")).alias("intelligence_level"), *[F.col(n) for n in names],
        F.when(F.col("_sub"), F.struct("submission_url", "submission_email")).alias("submission"), "best_action", "recommendation", F.struct(*[F.col(f"n_{n}").alias(n) for n in names]).alias("counts"),
        F.struct(facts_count.alias("facts_count"), gaps.alias("unknown_fields")).alias("epistemology"),
    )
    return df.select("station", document.alias("document"))
