"""Merges by key: ordered unions, stored rows against incoming ones, latest rows, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lenient_email
from ..functions.url import canonical_host, registrable_domain, slugify


def identity_key(website: Column, name: Column, country: Column, region: Column) -> Column:
    """domain:<registrable domain> of the website, else namegeo:<slugs of name, country and region>."""
    domain = F.nullif(registrable_domain(F.coalesce(website, F.lit(""))), F.lit(""))
    place = F.concat(F.lit("namegeo:"), slugify(name), F.lit("-"), slugify(country), F.lit("-"), slugify(region))
    return F.coalesce(F.concat(F.lit("domain:"), domain), place)


def merge_lists(old: Column, new: Column) -> Column:
    """old as it is, then what is new, each once."""
    o, n = F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))
    return F.concat(o, F.filter(F.array_distinct(n), lambda x: ~F.array_contains(o, x)))


def merge_json(old: Column, new: Column) -> Column:
    """old, then what is new of two arrays of JSON texts, as they are written.

    Texts are one if their values are, whatever the order of keys and white space; what is no JSON is compared as text.
    """
    none = F.array().cast("array<string>")
    o, n = F.coalesce(old, none), F.coalesce(new, none)
    form = lambda x: F.coalesce(F.to_json(F.try_parse_json(x)), x)  # noqa: E731  keys of a variant are sorted

    def first(x: Column) -> Column:
        """The new texts whose form is neither there nor that of an earlier one."""
        return F.filter(x["new"], lambda y, k: ~F.array_contains(x["had"], F.get(x["came"], k)) & (F.array_position(x["came"], F.get(x["came"], k)) == k + 1))

    # forms are made once, and then compared as values
    once = F.transform(F.array(F.struct(F.transform(o, form).alias("had"), F.transform(n, form).alias("came"), n.alias("new"))), first)
    return F.concat(o, F.get(once, F.lit(0)))


def merge_maps(old: Column, new: Column, newest: bool = False) -> Column:
    """Union of the keys; the old value wins, or the new one."""
    empty = F.create_map().cast("map<string,string>")
    a, b = (new, old) if newest else (old, new)
    a, b = F.coalesce(a, empty), F.coalesce(b, empty)
    return F.map_concat(a, F.map_filter(b, lambda k, _: ~F.map_contains_key(a, k)))


#: policy of a column in merge_stored: what becomes of (old, new)
POLICIES = {
    "fill": lambda o, n: F.coalesce(o, n),
    "newest": lambda o, n: F.coalesce(n, o),
    "min": lambda o, n: F.least(o, n),
    "max": lambda o, n: F.greatest(o, n),
    "list": merge_lists,
    "map": merge_maps,
    "map_newest": lambda o, n: merge_maps(o, n, newest=True),
}


def merge_stored(stored: DataFrame, incoming: DataFrame, key: str, policy: dict[str, str]) -> DataFrame:
    """Rows of both by key, each once; columns by their policy.  Both sides have one row a key."""
    both = stored.alias("o").join(incoming.alias("n"), key, "full")
    return both.select(key, *[POLICIES[p](F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c, p in policy.items()])


def latest_per_key(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The last row of each key in this order, which must be a total one; partial maxima, no sort of a key's rows."""
    rank = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), rank).alias("x")).select(*key, *[F.col(f"x.{c}").alias(c) for c in rest])


def replace_children(stored: DataFrame, incoming: DataFrame, parent: str, always: bool = True) -> DataFrame:
    """Stored child rows but those of parents that incoming has rows for, and incoming."""
    return stored.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming)


def contact_uid(*parts: Column) -> Column:
    """32 hex digits of a hash over the parts, empty for NULL."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def fingerprints(website: Column, email: Column, name: Column, country: Column, city: Column) -> Column:
    """Keys by which two records are one: website host, e-mail address, and name with its place."""
    host = F.nullif(canonical_host(F.coalesce(website, F.lit(""))), F.lit(""))
    mail = F.nullif(lenient_email(F.coalesce(email, F.lit(""))), F.lit(""))
    slug, town = F.nullif(slugify(name), F.lit("")), F.nullif(slugify(city), F.lit(""))
    place = F.concat(F.lit("namegeo:"), slug, F.lit("|"), slugify(country), F.lit("|"), town)
    return F.array_distinct(F.array_compact(F.array(F.concat(F.lit("website:"), host), F.concat(F.lit("email:"), mail), place)))


def match_stored(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, stored_id): for each incoming (id, keys) the first stored record (stored_id, rank, keys) that shares a key."""
    a = incoming.select("id", F.explode("keys").alias("k"))
    b = stored.select("stored_id", "rank", F.explode("keys").alias("k")).groupBy("k").agg(F.min(F.struct("rank", "stored_id")).alias("x"))
    return a.join(b, "k").groupBy("id").agg(F.min("x").alias("x")).select("id", "x.stored_id")


def keep_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all rules, and the others with `failed`: the names of the rules they break."""
    checked = rows.withColumn("failed", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])))
    return checked.filter(F.size("failed") == 0).drop("failed"), checked.filter(F.size("failed") > 0)


def _in_order(rows: DataFrame, key: str, value: Column, order: Column, name: str) -> DataFrame:
    """(key, name): the distinct values of each key in order of their first sight."""
    seen = rows.select(key, value.alias("_v"), order.alias("_o")).filter("_v is not null").groupBy(key, "_v").agg(F.min("_o").alias("_o"))
    return seen.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_v"))), lambda x: x["_v"]).alias(name))


def merge_duplicates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One record for each key from its rows in order, the first of which is the record.

    rows: name, source_urls, social_urls (map), submission_url, contact_url, city, country, description, station_type,
    discovered_at, last_observed_at.  Other names are kept as alternates, sources are joined, the first link of a platform
    and the first known value of a field win, a known type goes before an unknown one, first and last times are widest.
    """
    known = lambda c, when: F.min_by(c, F.when(when, F.col(order)))
    said = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    typed = F.coalesce(known("station_type", said("station_type") & (F.col("station_type") != "unknown")), known("station_type", said("station_type")))
    fields = [F.min_by("name", order).alias("name"), typed.alias("station_type"), F.count("*").alias("records")]
    fields += [known(c, F.col(c).isNotNull()).alias(c) for c in ("submission_url", "contact_url")] + [known(c, said(c)).alias(c) for c in ("city", "country", "description")]
    fields += [F.min(F.nullif("discovered_at", F.lit(""))).alias("discovered_at"), F.max(F.nullif("last_observed_at", F.lit(""))).alias("last_observed_at")]
    out = rows.groupBy(key).agg(*fields).join(_in_order(rows, key, F.nullif("name", F.lit("")), F.col(order), "_names"), key, "left")
    urls = rows.select(key, order, F.posexplode("source_urls").alias("_p", "_u"))
    out = out.join(_in_order(urls, key, F.col("_u"), F.struct(order, "_p"), "source_urls"), key, "left")
    links = rows.select(key, order, F.explode("social_urls").alias("_k", "_u")).groupBy(key, "_k").agg(F.min_by("_u", order).alias("_u"))
    socials = links.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_u")))).alias("social_urls"))
    out = out.join(socials, key, "left")
    none = F.array().cast("array<string>")
    alternates = F.filter(F.coalesce("_names", none), lambda n: ~n.eqNullSafe(F.col("name")))
    return out.withColumns({"alternate_names": alternates, "source_urls": F.coalesce("source_urls", none), "social_urls": F.coalesce("social_urls", F.create_map().cast("map<string,string>"))}).drop("_names")
