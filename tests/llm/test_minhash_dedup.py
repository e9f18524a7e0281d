import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute

from quarry.llm import minhash_dedup as md
from quarry.llm._tables import read

DOCS = "doc_id long, text string"
EDGES = [(None, "a b c d e"), (3, None), (4, ""), (5, " \n\t "), (6, "A b  C d e"), (6, "q r"), (6, "q r"), (7, "x" * 5000), (8, "é ü\x0bñ"), (9, " nbsp a"), (None, "only null ids here"), (None, "only null ids here"), (10, "long text " * 40000)]


def expected(rows, size, percent):
    return sorted(((i, n, c, i == c) for i, n, c in brute.jaccard_components(rows, size, percent)), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def near_copies(seed, groups=5, size=24, words=(9, 20, 60, 300)):
    """Copies at all similarities around the threshold."""
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [rng.choice("abcdefghijklmn") + rng.choice("abcdefg") for _ in range(rng.choice(words))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 20))):
                w[rng.randrange(len(w))] = f"zz{rng.randint(0, 3)}"
            rows.append((rng.randint(0, 900), " ".join(w)))
    return rows


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_components_equal_all_pairs(spark, size, percent):
    rows = near_copies(size) + EDGES + EDGES[:3]
    df = spark.createDataFrame(rows, DOCS).repartition(5).withColumns({c: F.lit(1) for c in ("node", "sig", "n", "key", "low", "comp", "tx")})
    got = md.minhash_components(df, size, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert result(got) == expected(rows, size, percent)


def test_large_groups_are_cut_by_further_chunks(spark, monkeypatch):
    """Tiles of 8 nodes: groups, cut groups and what is still larger all occur."""
    from quarry.llm import ngram_jaccard

    monkeypatch.setattr(ngram_jaccard, "TILE", 8)
    cuts = []
    real = md._second_keys
    monkeypatch.setattr(md, "_second_keys", lambda chunks: cuts.append(chunks) or real(chunks))
    rng = random.Random(3)
    shared = [f"s{i}" for i in range(200)]
    rows = [(i, " ".join(shared + [f"own{rng.randint(0, 9)}x{rng.randint(0, 20)}x{k}" for k in range(rng.randint(10, 30))])) for i in range(24)]
    assert result(md.minhash_components(spark.createDataFrame(rows, DOCS))) == expected(rows, 3, 85)
    assert cuts


def test_pairs_within_the_radius_share_keys_of_two_chunks():
    chunks, width = md.layout(85)
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 256, chunks * width, dtype=np.uint8)
        b = a.copy()
        at = rng.choice(len(a), 2 * chunks - 3, replace=False)
        b[at] ^= np.uint8(1)
        x, y = (md.chunk_keys(s[None, :], chunks)[0] for s in (a, b))
        assert (x == y).any(axis=1).sum() >= 2


def test_layout_keeps_its_loss():
    for percent in (80, 85, 90, 95):
        chunks, width = md.layout(percent)
        rng = np.random.default_rng(percent)
        apart = rng.binomial(chunks * width, 1 - percent / 100, 10**6)
        assert (apart > 2 * chunks - 3).mean() < 1e-4 and chunks * width <= md.MOST_KEYS


def test_empty_table_gives_no_rows(spark):
    assert md.minhash_components(spark.createDataFrame([], DOCS)).count() == 0


def test_query_equals_all_pairs_on_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert result(md.op11_minhash_near_dedup(spark, sf_dir)) == expected(rows, 3, 85)


def test_keys_come_from_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(md, "KEYED", 100)
    chunks, width = md.layout(85)
    made = spark.range(3000, numPartitions=1).select("id", F.rpad(F.sha2(F.col("id").cast("string"), 512), chunks * width, "x").cast("binary").alias("sig"))
    made.withColumnRenamed("id", "node").write.parquet(str(tmp_path / "nodes"))  # one file, as small tables are written
    nodes = spark.read.parquet(str(tmp_path / "nodes"))
    task = md._keyed(nodes, chunks).groupBy(F.spark_partition_id()).agg(F.count_distinct("node").alias("n"))
    counts = [r.n for r in task.collect()]
    assert sum(counts) == 3000 and max(counts) <= 2 * 100
    keys = {tuple(r) for r in md._keyed(nodes.limit(50), chunks).collect()}
    assert keys == {(int(k), r.node) for r in nodes.limit(50).collect() for k in md.chunk_keys(np.frombuffer(r.sig, np.uint8)[None, :], chunks).view(np.int64).reshape(-1)}


def test_groups_around_one_passage_stay_whole(spark, monkeypatch):
    """Such texts share many keys: cut by them, each pair would meet under each."""
    from quarry.llm import ngram_jaccard

    for m in (md, ngram_jaccard):
        monkeypatch.setattr(m, "TILE", 8)
    made = {}

    def count(df, name, *by, write=md.spool):
        out = write(df, name, *by)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(md, "spool", count)
    rows = [(i, " ".join([f"s{k}" for k in range(200)] + [f"own{i}x{k}" for k in range(30)])) for i in range(40)]
    assert result(md.minhash_components(spark.createDataFrame(rows, DOCS))) == expected(rows, 3, 85)
    assert 0 < made["rows"] <= made["named"] and made["cut"] == 0


def test_groups_of_many_rare_keys_are_cut(spark, monkeypatch):
    from quarry.llm import ngram_jaccard

    for m in (md, ngram_jaccard):
        monkeypatch.setattr(m, "TILE", 8)
    chunks, width = md.layout(85)
    sig = np.random.default_rng(5).integers(0, 256, (600, chunks * width), dtype=np.uint8)
    sig[1:300:2, :width] = sig[0:300:2, :width]  # of group 1, nodes agree in one chunk by twos
    sig[300:] = sig[300]  # of group 2, all agree
    left = spark.createDataFrame([(1 + i // 300, -1, i, i) for i in range(600)], "low long, chunk int, node long, comp long")
    nodes = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sig)], "node long, sig binary")
    assert [r.low for r in md._worth_cutting(left, nodes, chunks).collect()] == [1]
    assert {r.of for r in md._cut(left.filter("low = 1"), nodes, chunks).select("of").distinct().collect()} == {1}
