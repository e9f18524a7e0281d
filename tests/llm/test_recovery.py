import random
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute

from quarry.llm import packing, sharding, token_counts

DELTAS = "source string, lang string, tokenizer string, n_tokens long, sign long"


def folders(path, kind):
    return sorted(p.name for p in (Path(path) / kind).glob("*") if not p.name.startswith("."))


@pytest.mark.parametrize("place", ["before_entry", "before_rename", "after_rename"])
def test_a_commit_that_crashed_is_repeated(spark, tmp_path, monkeypatch, place):
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    one = spark.createDataFrame([("a", "en", "t", 5, 1), ("a", "en", "t", 2, 1)], DELTAS)
    two = spark.createDataFrame([("a", "en", "t", 5, -1), ("b", None, "t", None, 1)], DELTAS)
    assert rollup.commit("one", one)
    real = rollup._publish

    def crash(version, batch, folder):
        if place == "before_rename":
            Path(tmp_path / "r/pending").mkdir(exist_ok=True)
            (tmp_path / f"r/pending/{folder}.json").write_text("")
        if place == "after_rename":
            real(version, batch, folder)
        raise RuntimeError("lost")

    monkeypatch.setattr(rollup, "_publish", crash)
    with pytest.raises(RuntimeError):
        rollup.commit("two", two)
    again = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert again.commit("two", two) == (place != "after_rename")
    assert not again.commit("two", two) and not again.commit("one", one)
    assert {tuple(r) for r in again.totals().collect()} == {("a", "en", "t", 1, 2), ("b", None, "t", 1, 0)}
    assert [r.version for r in again.log().orderBy("version").collect()] == [1, 2]
    assert len(folders(tmp_path / "r", "totals")) == 2 and not folders(tmp_path / "r", "pending")


def test_of_two_writers_one_starts_over(spark, tmp_path):
    path = str(tmp_path / "r")
    rollup = token_counts.Rollup(spark, path)
    delta = spark.createDataFrame([("a", "en", "t", 1, 1)], DELTAS)
    real, met = rollup._publish, []

    def late(version, batch, folder):
        if not met:
            met.append(token_counts.Rollup(spark, path).commit("other", delta))
        return real(version, batch, folder)

    rollup._publish = late
    assert rollup.commit("mine", delta) and met == [True]
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "t", 2, 2)]
    assert len(folders(path, "totals")) == 2 and not folders(path, "pending")


def test_shards_hold_each_row_once(spark, tmp_path):
    rows = [(1, "one"), (1, "two"), (1, "one"), (None, "x"), (None, None), (None, "x"), (2, "é" * 50), *[(i, "word " * (i % 7)) for i in range(3, 60)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit("mine"), "n_bytes": F.lit(0)})
    sharding.write_shards(df, str(tmp_path / "s"), limit=60)
    got = spark.read.parquet(str(tmp_path / "s"))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(rows)
    bytes_ = got.groupBy("shard").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("b"), F.count("*").alias("n"))
    assert bytes_.filter("b > 60 and n > 1").isEmpty()


def test_packing_equals_brute_force_by_shard(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 0, rng.randint(1, 90), rng.randint(1, 300)]), rng.choice(["a", "b", None]), rng.choice([None, rng.randint(0, 9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, source string, cluster long").withColumns({"bin": F.lit(1), "piece": F.lit(1), "shard": F.lit(1)})
    got = packing.best_fit_packing(df, capacity=100, shard=10**6).collect()
    size = {(r.doc_id, r.piece): r.n_words for r in got}
    pieces = {(i, k): min(100, (n or 0) - 100 * k) for i, n, _, _ in rows for k in range(max(1, -(-(n or 0) // 100)))}
    assert size == pieces
    order = sorted(got, key=lambda r: (-r.n_words, r.doc_id, r.piece))
    bins = brute.best_fit([(r.n_words, r.source, r.cluster) for r in order], 100)
    seen = {}
    assert [seen.setdefault(b, len(seen)) for b in bins] == [r.bin & 0xFFFFFFFF for r in order]
