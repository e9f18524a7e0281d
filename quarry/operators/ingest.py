"""Ingest of station records into a store: stations, their facts, contacts, submission paths and fetches, in one version.

A batch acts as one step.  What a batch brings and what is stored both grow, so they meet in merge joins: neither is sent
whole to the driver and from there to every task.  A record that breaks a rule is a row of `failures` and stops no other.  Of records of one
station in a batch, the position in the batch is the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.store import Change, Store, Table, upsert
from . import merge as M

RECORD = (
    "position long, name string, organization_type string, website string, country string, state_or_region string, city string, status string, "
    "confidence_score double, genres array<string>, source_urls array<string>, social_urls map<string,string>, discovered_at string, last_observed_at string, "
    "emails array<struct<value:string,source_url:string>>, phone_numbers array<struct<value:string,source_url:string>>, "
    "contacts array<struct<name:string,role:string,email:string,phone:string,source_url:string,provenance:array<string>>>, "
    "submission map<string,string>, fetches array<struct<url:string,ok:boolean,status:int>>"
)
#: what becomes of a stored column when a record comes
POLICY = {
    "name": "fill", "website": "fill", "country": "fill", "state_or_region": "fill", "city": "fill", "confidence_score": "fill", "status": "newest",
    "genres": "list", "source_urls": "list", "social_urls": "map", "discovered_at": "min", "last_observed_at": "max",
}
_KINDS = {"confidence_score": "double", "genres": "array<string>", "source_urls": "array<string>", "social_urls": "map<string,string>"}
_TIMES = "first_stored_at string, last_stored_at string"


def tables(buckets: int = 64) -> dict[str, Table]:
    """The tables of a store of stations; rows of one station fall into the same bucket of each of them."""
    station = ", ".join(f"{c} {_KINDS.get(c, 'string')}" for c in POLICY)
    schemas = {
        "stations": f"station string, {station}, {_TIMES}",
        "facts": "station string, kind string, value string, source_url string, position long",
        "contacts": f"station string, uid string, name string, role string, email string, phone string, source_url string, provenance array<string>, {_TIMES}",
        "submissions": f"station string, payload map<string,string>, {_TIMES}",
        "fetches": "station string, place int, url string, ok boolean, status int",
    }
    return {name: Table(schema, ("station",), buckets) for name, schema in schemas.items()} | {
        "runs": Table("batch string, source string, accepted long, failed long, stations long, contacts long, submissions long", ("batch",), 1),
        "failures": Table("batch string, position long, broken array<string>, website string", ("batch",), buckets),
    }


def _unit(x: Column) -> Column:
    return x.isNull() | x.between(0, 1)


def rules() -> dict[str, Column]:
    """What a record must fulfil."""
    return {
        "name": F.coalesce(F.trim("name"), F.lit("")) != "",
        "organization_type": F.col("organization_type").isNull() | (F.col("organization_type") == "radio_station"),
        "website": F.col("website").isNull() | F.col("website").rlike("^https?://"),
        "confidence_score": _unit(F.col("confidence_score")),
    }


def _one_of_each(good: DataFrame) -> DataFrame:
    """(station, columns of POLICY): the records of a batch as one for each station, by the same policy as stored rows."""
    at = F.col("position")
    said = lambda c: F.when(F.col(c).isNotNull(), at)
    aggs = []
    for c, p in POLICY.items():
        if p == "fill":
            aggs.append(F.min_by(c, said(c)).alias(c))
        elif p == "newest":
            aggs.append(F.max_by(c, said(c)).alias(c))
        elif p in ("min", "max"):
            aggs.append(getattr(F, p)(F.nullif(c, F.lit(""))).alias(c))
    out = good.groupBy("station").agg(*aggs)
    for c, p in POLICY.items():
        if p == "list":
            each = good.select("station", "position", F.posexplode(c).alias("_p", "_v"))
            out = out.join(M._in_order(each, "station", F.col("_v"), F.struct("position", "_p"), c).hint("merge"), "station", "left")
        elif p == "map":
            each = good.select("station", "position", F.explode(c).alias("_k", "_v")).groupBy("station", "_k").agg(F.min_by("_v", at).alias("_v"))
            out = out.join(each.groupBy("station").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(c)).hint("merge"), "station", "left")
    return out.select("station", *POLICY)


def _last_of(good: DataFrame, column: str, when: Column) -> DataFrame:
    """(station, column) of the last record of each station for which this holds."""
    return good.filter(when).groupBy("station").agg(F.max_by(column, "position").alias(column))


def _stations(now: str):
    def merge(stored: DataFrame, rows: DataFrame) -> DataFrame:
        both = M.merge_stored(stored.withColumn("_first", F.col("first_stored_at")).withColumn("_in", F.lit(None).cast("boolean")), rows.withColumn("_first", F.lit(None).cast("string")).withColumn("_in", F.lit(True)), "station", POLICY | {"_first": "fill", "_in": "newest"})
        was = stored.select("station", F.col("last_stored_at").alias("_last"))
        out = both.join(was.hint("merge"), "station", "left")
        return out.select("station", *POLICY, F.coalesce("_first", F.lit(now)).alias("first_stored_at"), F.when(F.col("_in"), F.lit(now)).otherwise(F.col("_last")).alias("last_stored_at"))

    return merge


def _with_first(key: list[str], now: str, replace: bool):
    """Incoming rows with the first time of stored ones of their key; replace: of a station with incoming rows, other stored rows go."""

    def merge(stored: DataFrame, rows: DataFrame) -> DataFrame:
        old = stored.select(*key, F.col("first_stored_at").alias("_first"), *([F.col("provenance").alias("_old")] if "provenance" in stored.columns else []))
        new = rows.join(old.hint("merge"), key, "left").withColumn("first_stored_at", F.coalesce("_first", F.lit(now))).withColumn("last_stored_at", F.lit(now))
        if "provenance" in stored.columns:
            new = new.withColumn("provenance", M.merge_lists(F.col("_old"), F.col("provenance")))
        rest = stored.join(rows.select(*(["station"] if replace else key)).distinct().hint("merge"), ["station"] if replace else key, "left_anti")
        return rest.unionByName(new.select(*stored.columns))

    return merge


def _replaced(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of stations that came take the place of all theirs; a row without a url only says that its station came."""
    return stored.join(rows.select("station").distinct().hint("merge"), "station", "left_anti").unionByName(rows.filter("place >= 0"))


def changes(records: DataFrame, batch: str, source: str, now: str) -> dict[str, Change]:
    """What a batch of records changes in the tables of a store."""
    good, bad = M.split_valid(records, rules())
    good = good.withColumn("station", M.identity_key(F.col("website"), F.col("name"), F.col("country"), F.col("state_or_region")))
    facts = None
    for kind, column in (("email", "emails"), ("phone", "phone_numbers")):
        each = good.select("station", "position", F.lit(kind).alias("kind"), F.posexplode(column).alias("_p", "f")).select("station", "kind", F.col("f.value").alias("value"), F.col("f.source_url").alias("source_url"), "position", "_p")
        facts = each if facts is None else facts.unionByName(each)
    facts = facts.filter("value IS NOT NULL").groupBy("station", "kind", "value").agg(F.max_by(F.struct("source_url", "position"), F.struct("position", "_p")).alias("x")).select("station", "kind", "value", "x.*")
    people = _last_of(good, "contacts", F.size("contacts") > 0).select("station", F.posexplode("contacts").alias("_p", "c")).select("station", "_p", "c.*")
    uid = M.contact_uid(*[F.col(c) for c in ("station", "name", "role", "email", "phone")])
    people = people.withColumn("uid", uid).groupBy("station", "uid").agg(F.max_by(F.struct("name", "role", "email", "phone", "source_url", "provenance"), "_p").alias("x")).select("station", "uid", "x.*")
    paths = _last_of(good, "submission", F.col("submission").isNotNull()).withColumnRenamed("submission", "payload")
    fetches = good.groupBy("station").agg(F.max_by("fetches", "position").alias("f")).select("station", F.posexplode_outer("f").alias("place", "x")).select("station", F.coalesce("place", F.lit(-1)).alias("place"), "x.*")
    each = good.select(F.lit(1).alias("a"), F.lit(0).alias("b"), "station", F.greatest(F.coalesce(F.size("contacts"), F.lit(0)), F.lit(0)).alias("c"), F.col("submission").isNotNull().cast("int").alias("d"))
    each = each.unionByName(bad.select(F.lit(0).alias("a"), F.lit(1).alias("b"), F.lit(None).cast("string").alias("station"), F.lit(0).alias("c"), F.lit(0).alias("d")))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    run = each.agg(total("a", "accepted"), total("b", "failed"), F.count_distinct("station").alias("stations"), total("c", "contacts"), total("d", "submissions"))
    run = run.select(F.lit(batch).alias("batch"), F.lit(source).alias("source"), "*")
    return {
        "stations": Change(_one_of_each(good), _stations(now)),
        "facts": Change(facts, upsert(["station", "kind", "value"])),
        "contacts": Change(people, _with_first(["station", "uid"], now, replace=True)),
        "submissions": Change(paths, _with_first(["station"], now, replace=False)),
        "fetches": Change(fetches, _replaced),
        "runs": Change(run, upsert(["batch"])),
        "failures": Change(bad.select(F.lit(batch).alias("batch"), "position", F.col("failed").alias("broken"), "website"), upsert(["batch", "position"])),
    }


def station_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    return Store(spark, path, tables(buckets))


def ingest(store: Store, batch: str, records: DataFrame, source: str, now: str) -> bool:
    """Stores a batch of records (RECORD) in all tables at once; False if it is stored already."""
    return store.commit(batch, changes(records, batch, source, now))
