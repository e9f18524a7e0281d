from datetime import datetime, timedelta

import pytest

from quarry.streaming import jobs, ledger

SCHEMA = "run_id string, status string, at timestamp"
T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, jobs.ROCKSDB)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def run(spark, path, limit=timedelta(hours=10)):
    got = []
    stream = jobs.job_stream(ledger.read_ledger(spark, f"{path}/in", SCHEMA), limit)
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: got.extend(tuple(r) for r in df.collect()))
    query.option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return got


def test_states_are_the_same_after_a_restart(spark, tmp_path, rocksdb):
    files = [
        [("a", "queued", at(0)), ("b", "queued", at(0)), ("c", "queued", at(1)), ("x", "no state", at(1)), (None, "queued", at(0))],
        [("a", "running", at(2)), ("a", "queued", at(3)), ("b", "running", at(2)), ("b", "running", at(2))],
        [("a", "completed", at(4)), ("a", "running", at(5)), ("d", "queued", at(4))],
        [("a", "failed", at(6)), ("a", "completed", at(4)), ("d", "not_configured", at(6))],
        [("z", "queued", at(30))],
        [("b", "completed", at(2)), ("z", "running", at(31))],
        [("y", "queued", at(32))],
    ]
    got = []
    for rows in files:  # each run starts from the checkpoint of the last
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got += run(spark, tmp_path)
    last = {r[0]: r[1:] for r in got}
    assert last["a"] == ("failed", at(6), True, False)
    assert last["d"] == ("not_configured", at(6), True, False)
    assert last["b"] == ("failed", at(12), True, True) and last["c"] == ("failed", at(11), True, True)
    assert last["z"] == ("running", at(31), False, False) and "x" not in last
    assert run(spark, tmp_path) == []
    changes = [r[1] for r in got if r[0] == "a"]
    assert changes == ["queued", "running", "completed", "failed"]


def test_jobs_wait_in_order_of_arrival(spark):
    df = spark.createDataFrame([("q", "r2", "queued", at(1)), ("q", "r1", "queued", at(1)), ("q", "r0", "running", at(0)), ("p", "r3", "queued", at(5)), ("q", "r4", "queued", at(0))], "queue string, run_id string, status string, at timestamp")
    assert {(r.queue, r.run_id): r.place for r in jobs.queue_places(df).collect()} == {("q", "r4"): 1, ("q", "r1"): 2, ("q", "r2"): 3, ("p", "r3"): 1}
