from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.operators import ingest
from quarry.streaming import ledger
from quarry.streaming.store import Change, Store, Table, keep_latest_in, upsert

TWO = {"a": Table("k long, v string", ("k",), 8), "b": Table("k long, w long", ("k",), 4)}


def rows(store, name):
    return {tuple(r) for r in store.read(name).collect()}


def batch(spark, a, b):
    return {"a": Change(spark.createDataFrame(a, "k long, v string"), upsert(["k"])), "b": Change(spark.createDataFrame(b, "k long, w long"), upsert(["k"]))}


def folders(store):
    return sorted(p.name for p in Path(store.path, "data").glob("*"))


@pytest.mark.parametrize("fault", range(4))
def test_a_crash_leaves_the_old_version_or_the_new_one(spark, tmp_path, monkeypatch, fault):
    """Before each table's write, before the manifest, and after it."""
    store = Store(spark, str(tmp_path / "s"), TWO)
    assert store.commit("1", batch(spark, [(1, "x"), (2, "y")], [(1, 10)]))
    step, write, publish = [0], store._write, store._publish

    def crash():
        step[0] += 1
        if step[0] > fault:
            raise RuntimeError("lost")

    def writing(*args):
        crash()
        return write(*args)

    def publishing(*args):
        crash()
        publish(*args)
        crash()

    monkeypatch.setattr(store, "_write", writing)
    monkeypatch.setattr(store, "_publish", publishing)
    change = batch(spark, [(2, "z"), (3, "n")], [(1, 11), (9, 90)])
    with pytest.raises(RuntimeError):
        store.commit("2", change)
    again = Store(spark, str(tmp_path / "s"), TWO)
    old, new = [{(1, "x"), (2, "y")}, {(1, 10)}], [{(1, "x"), (2, "z"), (3, "n")}, {(1, 11), (9, 90)}]
    assert [rows(again, t) for t in "ab"] == (new if fault == 3 else old)
    assert again.commit("2", change) == (fault != 3)
    assert not again.commit("2", change) and not again.commit("1", change)
    assert [rows(again, t) for t in "ab"] == new and len(folders(again)) == 2
    assert not list(Path(tmp_path, "s/pending").glob("[!.]*"))


def test_the_second_of_two_writers_starts_over(spark, tmp_path):
    path = str(tmp_path / "s")
    store, met, publish = Store(spark, path, TWO), [], None
    publish = store._publish

    def late(*args):
        if not met:
            met.append(Store(spark, path, TWO).commit("other", batch(spark, [(1, "other")], [])))
        return publish(*args)

    store._publish = late
    assert store.commit("mine", batch(spark, [(2, "mine")], [(2, 2)])) and met == [True]
    assert rows(store, "a") == {(1, "other"), (2, "mine")} and rows(store, "b") == {(2, 2)}


def test_only_touched_buckets_are_written_and_old_ones_go(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), TWO)
    store.commit("1", batch(spark, [(k, "x") for k in range(50)], []))
    before = store.state()[1]["a"]
    store.commit("2", batch(spark, [(7, "new")], []))
    after = store.state()[1]["a"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert rows(store, "a") == {(k, "new" if k == 7 else "x") for k in range(50)}
    assert store.prune(1) == 1 and store.prune(1) == 0 and len(rows(store, "a")) == 50


def test_a_stream_keeps_the_latest_rows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    for k in range(3):
        events.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    store = Store(spark, str(tmp_path / "s"), {"latest": Table(schema, ("user_id",), 8)})
    for _ in range(2):
        keep_latest_in(ledger.read_ledger(spark, f"{tmp_path}/in"), store, "latest", ["user_id"], ["ts", "event_id"], f"{tmp_path}/check")
    want = {}
    for r in events.collect():
        want[r.user_id] = max(want.get(r.user_id, ()), (r.ts, r.event_id))
    assert {r.user_id: (r.ts, r.event_id) for r in store.read("latest").collect()} == want


def test_records_are_merged_and_failures_stand_alone(spark, tmp_path):
    store = ingest.station_store(spark, str(tmp_path / "s"), 4)
    none = dict.fromkeys(x.split(" ")[0] for x in ("position name organization_type website country state_or_region city status confidence_score genres source_urls social_urls discovered_at last_observed_at emails phone_numbers contacts submission fetches").split())

    def put(name, *records):
        return ingest.ingest(store, name, spark.createDataFrame([tuple((none | r).values()) for r in records], ingest.RECORD), "test", name)

    site = {"name": "One", "website": "https://www.one.org/x"}
    who = {"name": "Al", "role": "host", "email": None, "phone": None, "source_url": "u", "provenance": ["p1"]}
    assert put("b1", site | {"position": 1, "city": None, "status": "new", "genres": ["a"], "social_urls": {"x": "1"}, "contacts": [who], "emails": [{"value": "m@one.org", "source_url": "u1"}], "fetches": [{"url": "f1", "ok": True, "status": 200}], "submission": {"k": "1"}},
               {"position": 2, "name": " "}, {"position": 3, "name": "Bad", "website": "ftp://x", "confidence_score": 2.0}, {"position": 4, "name": "Two", "country": "US"})
    assert put("b2", site | {"position": 1, "name": "Other", "city": "Rome", "status": "enriched", "genres": ["b", "a"], "social_urls": {"x": "2", "y": "3"}, "contacts": [who | {"provenance": ["p2", "p1"]}], "emails": [{"value": "m@one.org", "source_url": "u2"}]},
               site | {"position": 2, "city": "Oslo", "contacts": []})
    assert not put("b2", site)
    one = {r.station: r for r in store.read("stations").collect()}["domain:one.org"]
    assert (one["name"], one.city, one.status, one.genres, one.social_urls, one.first_stored_at, one.last_stored_at) == ("One", "Rome", "enriched", ["a", "b"], {"x": "1", "y": "3"}, "b1", "b2")
    two = store.read("stations").filter("name = 'Two'").first()
    assert (two.first_stored_at, two.last_stored_at) == ("b1", "b1")
    person = store.read("contacts").collect()
    assert [(r["name"], r.provenance, r.first_stored_at, r.last_stored_at) for r in person] == [("Al", ["p1", "p2"], "b1", "b2")]
    assert [(r.value, r.source_url) for r in store.read("facts").collect()] == [("m@one.org", "u2")]
    assert store.read("fetches").count() == 0 and store.read("submissions").first().payload == {"k": "1"}
    assert {(r.position, tuple(r.broken)) for r in store.read("failures").collect()} == {(2, ("name",)), (3, ("website", "confidence_score"))}
    runs = {r.batch: (r.accepted, r.failed, r.stations, r.contacts, r.submissions) for r in store.read("runs").collect()}
    assert runs == {"b1": (2, 2, 2, 1, 1), "b2": (2, 0, 1, 1, 0)}


def test_merges_of_stored_and_incoming_rows_broadcast_neither(spark):
    base = spark.range(5).selectExpr("cast(id as string) station", "cast(id as int) place", "'u' url", "'f' first_stored_at", "'l' last_stored_at")
    merges = {"replaced": ingest._replaced, "upsert": upsert(["station"]), "first": ingest._with_first(["station"], "now", replace=False)}
    for name, merge in merges.items():
        df = merge(base, base.filter("place < 3"))
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString(), name
        assert sorted(r.station for r in df.collect()) == list("01234"), name
