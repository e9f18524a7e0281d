import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import brute
from oracle import same

from quarry.llm import decontamination, language_id, license_scans, ngram_jaccard, packing, quality_rules, registry, sharding, substring_dedup, token_counts, token_orc
from quarry.llm._components import components
from quarry.llm._tables import fresh_path, read
from quarry.llm._words import Words, shingles, text_slices

DOCS = "doc_id long, text string"
EDGES = [(None, "a b c d e"), (3, None), (4, ""), (5, " \n\t "), (6, "A b  C d e"), (6, "q r"), (6, "q r"), (7, "x" * 5000), (8, "é ü\x0bñ"), (9, " nbsp a")]


def frame(spark, rows):
    """Rows with columns whose names clash with those that operators add."""
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(1) for c in ("n_words", "node", "key", "mark", "spans", "shard", "h", "bucket", "_row")})


def plain(df, *columns):
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())


def near_copies(seed, groups=5, size=30):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [rng.choice("abcdefghijklmn") + rng.choice("abcdefg") for _ in range(rng.choice([9, 20, 60, 300]))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = f"zz{rng.randint(0, 3)}"
            rows.append((rng.randint(0, 500), " ".join(w)))
    return rows


def pieces(seed, n=120):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("ab") for _ in range(150)) for _ in range(3)] + [" ".join(["x"] * 200), " ".join(["p", "q"] * 90)]
    rows = []
    for _ in range(n):
        t = []
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base).split()
            at = rng.randrange(len(b))
            t += b[at : at + rng.randint(1, 120)] + [rng.choice("abcdx") for _ in range(rng.choice([0, 1, 3, 20]))]
        rows.append((rng.randint(0, 80), " ".join(t)))
    return rows


def test_words_are_bytes_between_spaces():
    import pyarrow as pa

    texts = pa.array(["", None, "a b", " x  y\tz\n", "é è\x0bx", "a b c d e a b c d"]).slice(1)
    for a, b, data, offsets in text_slices(texts, 8):
        w = Words(data, offsets, lower=True)
        h, bounds = shingles(w, 4)
        for i in range(a, b):
            want = (texts[i].as_py() or "").encode().split()
            x, y = w.first[i - a], w.first[i - a + 1]
            assert [bytes(data[s:e]) for s, e in zip(w.start[x:y], w.end[x:y], strict=True)] == want
            assert bounds[i - a + 1] - bounds[i - a] == (max(1, len(want) - 3) if want else 0)


@pytest.mark.parametrize("tile", [16, 4096])
def test_jaccard_components(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_jaccard, "TILE", tile)
    rows = EDGES + near_copies(tile)
    got = plain(ngram_jaccard.jaccard_components(frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(map(str, brute.jaccard_components(rows)))


def test_jaccard_keeps_one_of_each(spark):
    rows = [(i, text) for i, (_, text) in enumerate(EDGES + near_copies(9, 3))]
    kept = sorted(r["doc_id"] for r in ngram_jaccard.one_of_each(frame(spark, rows), 5, 80).collect())
    assert kept == [x[0] for x in brute.jaccard_components(rows, 5, 80) if x[0] == x[2]]
    none = ngram_jaccard.one_of_each(frame(spark, [(None, "a b c d e f"), (None, "a b c d e f g"), (None, "z")]), 5, 50)
    assert none.count() == 2
    assert ngram_jaccard.jaccard_components(frame(spark, EDGES).limit(0)).count() == 0


def test_jaccard_links(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "TILE", 16)
    rows = EDGES + near_copies(3, 3, 20)
    links, member = ngram_jaccard.jaccard_links(frame(spark, rows))
    sets = {brute.shingle_set(text, 4) for _, text in rows} - {frozenset()}
    near = [(x, y) for x in sets for y in sets if x is not y and 100 * len(x & y) >= 85 * len(x | y)]
    assert 2 * links.count() == 2 * links.distinct().count() == len(near) > 0
    assert sorted(r["n_links"] for r in member.collect()) == sorted(sum(x == s for x, _ in near) for s in (brute.shingle_set(t, 4) for _, t in rows))


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["comp"] for r in components(links).collect()} == {0, 100}


@pytest.mark.parametrize("window", [50, 14])
def test_substring_dedup(spark, window):
    rows = EDGES + pieces(window)
    got = plain(substring_dedup.substring_digest(frame(spark, rows), window), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(map(str, brute.substring_dedup(rows, window)))


def test_substring_dedup_of_one_very_common_passage(spark):
    """One passage in all documents, each time between other words: one anchor with as many contents as documents."""
    rng = random.Random(5)
    passage = " ".join(rng.choice("abcdef") for _ in range(70))
    words = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    rows = [(i, f"{words(rng.randint(0, 60))} {passage} {words(rng.randint(0, 60))}") for i in range(300)]
    got = plain(substring_dedup.substring_digest(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(map(str, brute.substring_dedup(rows)))


def test_substring_dedup_keeps_columns(spark):
    df = frame(spark, EDGES + pieces(1, 30))
    out = substring_dedup.substring_dedup(df)
    assert set(df.columns) <= set(out.columns) and out.count() == df.count()
    assert out.filter("n_words < n_removed").count() == 0
    assert substring_dedup.substring_digest(df.limit(0)).count() == 0


def test_quality_rules(spark):
    rng = random.Random(4)
    rows = EDGES + [(i, " ".join(rng.choice(["the", "of", "and", "sun", "moon"] if i % 3 else ["##", "zz!", "|"]) + str(rng.randint(0, 30)) for _ in range(rng.randint(40, 120)))) for i in range(20, 60)]
    rows += [(70, "go " * 80), (71, "a b\n\na b\n a b\nc")]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(20, 50)] + [(22, 0, 0), (23, 1, 1)], "doc_id long, quality int, toxic int")
    trusted = {r[0] for r in quality_rules.trusted_ids(labels).collect()}
    assert 22 not in trusted and 23 not in trusted and 25 in trusted
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = plain(quality_rules.quality_rules(frame(spark, rows), labels), *names)
    assert got == sorted(map(str, brute.quality(rows, trusted, quality_rules.BUCKETS, quality_rules.SMOOTHING, quality_rules.THRESHOLD)))
    kept = quality_rules.good_documents(frame(spark, rows), labels)
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(x.endswith("True)") for x in got)
    none = quality_rules.quality_rules(frame(spark, rows), labels.limit(0))
    assert none.filter("llr <> 0 or kept = base_failed").count() == 0
    assert quality_rules.quality_rules(frame(spark, rows).limit(0), labels).count() == 0


@pytest.mark.parametrize("places", [3, 60])
def test_repeated_windows_with_hashes_that_clash(spark, places):
    """3 bits of place: all longer texts are sorted by words; 60: three bits of hash, so windows of equal hash differ."""
    rng = random.Random(places)
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    got = plain(quality_rules.base_counts(frame(spark, rows), places=places), "doc_id", "n_repeat_words")
    assert got == sorted(str((x[0], x[5])) for x in brute.quality(rows, set(), 8, 1.0, 0.0))


@pytest.mark.parametrize("held", [100, 0])
def test_bucket_counts_by_broadcast_and_by_shuffle(spark, held):
    rows = EDGES + [(i, f"w{i % 5} x y") for i in range(20, 40)]
    ids = spark.createDataFrame([(i,) for i in (20, 21, 25, 6, 99)], "doc_id long")
    counts = {r["bucket"]: (r["raw"], r["target"]) for r in quality_rules.bucket_counts(frame(spark, rows), ids, held_ids=held).collect()}
    words = [len((t or "").encode().split()) for _, t in rows]
    both = [max(0, 2 * n - 1) for n in words]
    assert sum(x for x, _ in counts.values()) == sum(both)
    assert sum(y for _, y in counts.values()) == sum(n for (i, _), n in zip(rows, both, strict=True) if i in (20, 21, 25, 6))


@pytest.mark.parametrize("held", [1 << 20, 12, 0])
def test_decontamination(spark, held):
    rng = random.Random(2)
    w = lambda n: " ".join(rng.choice(["Sun", "moon", "star", "sea", "rock"]) + str(rng.randint(0, 40)) for _ in range(n))
    items = [(1, w(12)), (2, w(30)), (2, w(8)), (3, "one two"), (None, w(7)), (4, None), (5, ""), (6, "!!")]
    docs = EDGES + [(20 + i, w(50) + " " + (items[i % 3][1] if i % 2 else items[1][1][: rng.randint(20, 200)]) + "; " + w(5)) for i in range(30)] + [(90, "One, two"), (90, "three")]
    got = plain(decontamination.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), item_hashes=held), "doc_id", "item_id", "n_item", "n_common")
    assert got == sorted(map(str, brute.containment(docs, items))) and len(got) > 10


def test_decontaminate(spark):
    docs, items = frame(spark, [(1, "a b c d e f g"), (None, "a b c d e f g"), (2, "x")]), spark.createDataFrame([(1, "b c d e f")], "item_id long, text string")
    assert plain(decontamination.decontaminate(docs, items), "doc_id") == ["(2,)"]
    assert decontamination.contamination(docs, items.limit(0)).count() == 0


def test_best_fit_is_the_tightest():
    rng = random.Random(8)
    for _ in range(20):
        items = sorted([(rng.randint(0, 60), rng.choice([None, *"abc"]), rng.choice([None, *range(9)])) for _ in range(150)], key=lambda x: -x[0])
        assert packing.best_fit(*map(list, zip(*items, strict=True)), 100)[0] == brute.best_fit(items, 100)


def test_packing(spark):
    rng = random.Random(8)
    rows = [(i, rng.randint(0, 250), rng.choice([None, "a", "a", "b", "c"]), rng.choice([None, 1, 2, 3])) for i in range(300)] + [(None, 5, None, None)] + [(7, 30, "a", 1)] * 3
    items = spark.createDataFrame(rows, "doc_id long, n_words long, source string, cluster long")
    got = packing.best_fit_packing(items, capacity=100, shard=64).toPandas()
    assert got.n_words.sum() == sum(r[1] for r in rows)
    for _, b in got.groupby("bin"):
        assert b.n_words.sum() + b.residual.iloc[0] == 100 and b.residual.nunique() == 1
        assert b.source.nunique() == b.source.count() and b.cluster.nunique() == b.cluster.count()
    assert packing.best_fit_packing(items.limit(0)).count() == 0
    docs = spark.createDataFrame(EDGES, DOCS).withColumn("source", F.lit("s"))
    assert packing.document_items(docs).filter("doc_id = 3").first()["n_words"] == 0


def test_language_id(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    out = language_id.op3_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (out[out.held_out].lang == out[out.held_out].lang_pred).mean() > 0.98 and out.score.between(0, 1).all()


def test_language_id_edges(spark):
    rows = [(1, "the of and", "en"), (2, "der und die", "de"), (3, None, "en"), (4, "12 !?", "de"), (5, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(df, language_id.train(df.filter("lang is not null"))).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert {r["lang_pred"] for r in language_id.identify(df, language_id.train(df.limit(0).filter("lang is not null"))).collect()} == {"und"}


def test_no_gram_holds_two_texts():
    alone = list(language_id.grams(["ab"]))[0]
    both = list(language_id.grams(["ab", "cd"]))[0]
    assert sorted(alone[2].tolist()) == sorted(both[2][both[3] == 0].tolist())


def test_shards_fit(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(400)] + [(500, "y" * 3000), (None, None)] + [(600, chr(97 + k) * 300) for k in range(20)]
    got = sharding.extendible_shards(frame(spark, rows), 1000).toPandas()
    assert len(got) == len(rows)
    sizes = got.groupby("shard").n_bytes.sum()
    large = set(got[got.oversized].shard)
    assert all(s <= 1000 or k in large for k, s in sizes.items())
    names = [s.split(".")[0] for s in sizes.index]
    assert not any(a != b and b.startswith(a) for a in set(names) for b in set(names))  # a prefix code
    assert len(got[got.doc_id == 600].shard.unique()) > 1 and got[got.doc_id == 500].oversized.all()
    assert sharding.extendible_shards(frame(spark, rows).limit(0)).count() == 0


def test_only_oversized_buckets_split(spark):
    """One row of a megabyte and 199 of ten bytes: the rows beside the large one fit after few bits."""
    rows = [(i, "z" * 10) for i in range(199)] + [(500, "y" * (1 << 20))]
    got = sharding.extendible_shards(frame(spark, rows), 16384).toPandas()
    alone = got[got.doc_id == 500].iloc[0]
    assert alone.oversized and (got.shard == alone.shard).sum() == 1
    assert got.shard.nunique() <= alone.depth + 1  # at most one shard beside each bit of its path
    assert got[got.doc_id != 500].depth.min() == 1


def test_shards_of_one_id_fit(spark):
    rows = [(7, "a" * 1500)] * 25 + [(7, chr(98 + k) * 1500) for k in range(20)]
    got = sharding.extendible_shards(frame(spark, rows), 10000).toPandas()
    assert len(got) == 45 and not got.oversized.any()
    assert (got.groupby("shard").n_bytes.sum() == got.groupby("shard").shard_bytes.first()).all() and got.shard_bytes.max() <= 10000


def test_rollup_commits_once(spark):
    rollup = token_counts.Rollup(spark, fresh_path(spark, "rollup"))
    docs = spark.createDataFrame([("a", "en", "x y"), ("a", "en", None), (None, None, "z")], "source string, lang string, text string")
    counts = token_counts.counted(docs, {"w": r"\S+"})
    assert rollup.totals().count() == 0
    assert rollup.commit("1", token_counts.signed(counts, 1)) and not rollup.commit("1", token_counts.signed(counts, 1))
    assert plain(rollup.totals(), "source", "lang", "tokenizer", "n_docs", "n_tokens") == ["('a', 'en', 'w', 2, 2)", "(None, None, 'w', 1, 1)"]
    rollup.commit("2", token_counts.signed(counts.filter("source is null"), -1))
    rollup.commit("3", token_counts.signed(counts.limit(0), 1))
    assert plain(rollup.totals(), "source", "n_tokens") == ["('a', 2)"] and rollup.batches() == {"1", "2", "3"}


def test_rollup_writers_do_not_lose_batches(spark):
    """Two writers that start from one version: the later one starts over from what the first has published."""
    path = fresh_path(spark, "rollup")
    one, two = token_counts.Rollup(spark, path), token_counts.Rollup(spark, path)
    rows = spark.createDataFrame([("a", "en", "w", 5, 1)], "source string, lang string, tokenizer string, n_tokens long, sign int")
    assert one.commit("0", rows.limit(0)) and one.totals().count() == 0
    publish, calls = two._publish, []

    def late(version, batch, folder):
        if not calls:
            calls.append(one.commit("1", rows))
        return publish(version, batch, folder)

    two._publish = late
    assert two.commit("2", rows) and calls == [True]
    assert plain(one.totals(), "n_docs", "n_tokens") == ["(2, 10)"] and one.batches() == {"0", "1", "2"}


def test_licence_edges(spark):
    rows = [(None, "Released under the MIT License.\n\nx\nreleased under mit"), (1, None), (2, ""), (3, "RELEASED under the mit license")]
    known = license_scans.templates(spark)
    got = plain(license_scans.license_matches(frame(spark, rows), known), "doc_id", "line_no", "template")
    assert got == ["(3, 0, 'MIT')", "(None, 0, 'MIT')"]
    assert license_scans.license_matches(frame(spark, rows), known.limit(0)).count() == 0


def test_token_files(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(2)
    letters = ["a", "B", "é", "É", "'s", "...", ".", ",", "!!", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "Σ", "1", "中", "ﬁ", " ", " ", "\n", "ß", "_", "-", "|"]
    rows = EDGES + [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    path = fresh_path(spark, "orc")
    token_orc.write_token_orc(frame(spark, rows), path)
    start, want = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert plain(token_orc.token_digests(spark, path), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(map(str, want))
    assert token_orc.read_token_orc(spark, path).filter("doc_id = 8").count() == 1


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    same(spark, sf_dir, registry.queries()[name], registry.oracle_sql()[name])
