import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import source_divergence as sd

DOCS = "doc_id long, text string, lang string, source string"


def audit(rows, min_docs, top):
    """Every term, group and pair in plain loops."""
    count, docs, groups = {}, Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        count.setdefault((lang, source), Counter()).update(terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {a for a, _ in groups}:
        kept = [t for (a, t), n in docs.items() if a == lang and n >= min_docs]
        of = {s: count[lang, s] for a, s in groups if a == lang}
        every = sum(of.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s, c in of.items():
            pairs = [(-sum(f(p(c, t), p(d, t)) for t in kept), x.encode(), x) for x, d in of.items() if x != s]
            terms = [(-f(p(c, t), p(every, t)), t.encode(), t) for t in kept if c[t] and p(c, t) > p(every, t)]
            out += [(lang, s, "pair", x, -v, r) for r, (v, _, x) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", x, -v, r) for r, (v, _, x) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def corpus(seed, n=150, sources=7):
    rng = random.Random(seed)
    words = ["the", "The", "été", "Éte", "a1b", "x_y", "don't", "ß", "日本", "zz"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(rng.choice(words[: rng.randint(3, 30)]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "fr", None]), rng.choice([None, *(f"s{k}" for k in range(sources))])) for i in range(n)]
    rows += [(None, None, "en", "empty"), (7, "1 2 3", "xx", "one"), (7, "the the", "xx", "one"), (8, None, "yy", "a"), (9, "", "yy", "b"), (5, "the " * 30000, "en", "s1")]
    return rows + rows[:10]


@pytest.mark.parametrize("block", [256, 2])
def test_audit_equals_plain_loops(spark, monkeypatch, block):
    monkeypatch.setattr(sd, "BLOCK", block)
    monkeypatch.setattr(sd, "SLICE", 40)
    rows = corpus(block)
    df = spark.createDataFrame(rows, DOCS).repartition(5).withColumns({c: F.lit(1) for c in ("term", "n", "value", "part", "block")})
    got = sd.source_divergence(df, min_docs=3, top=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == audit(rows, 3, 4)


def test_empty_table_gives_no_rows(spark):
    assert sd.source_divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_shares_are_exact_beyond_64_bits():
    n, v = np.array([8 * 10**15, 0, 123456789012345]), 999
    count = np.array([[7 * 10**15, 0, 123456789012345], [0, 0, 17]])
    want = [[1 + 10**9 * (int(c) + 2) // (int(m) + 2 * v) for c, m in zip(row, n, strict=True)] for row in count]
    assert sd.share(count, n[None, :], v).tolist() == want


def test_runs_cross_batches(spark):
    rows = [("en", f"t{i:02}", f"s{k}", i, 1, 2) for i in range(9) for k in range(3)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        df = spark.createDataFrame(rows, "lang string, term string, source string, document long, docs long, n long").coalesce(1)
        df = df.sortWithinPartitions("lang", "term", "source", "document").drop("document")
        got = df.mapInArrow(sd._runs(3), "lang string, term string, total long, sources array<string>, counts array<long>").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in got) == [("en", f"t{i:02}", 6, ["s0", "s1", "s2"], [2, 2, 2]) for i in range(9)]
