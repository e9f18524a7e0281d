import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import spelling_variants as sv
from quarry.llm._tables import read


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows, least=6, often=5, times=5, neighbours=None):
    """Every pair of words, compared; neighbours: by all deletions instead, for many words."""
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= least and c >= often}
    near = {w: [x for x in n if one_edit(w, x)] for w in n} if not neighbours else neighbours(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def by_deletions(n):
    """Near words that share what is left without one character at one place, or that are it."""
    where = {}
    for w in n:
        for i in range(len(w)):
            where.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    near = {w: set() for w in n}
    for (_, short), words in where.items():
        for w in words:
            near[w] |= {x for x in words if x != w}
            if short in n:
                near[w].add(short)
                near[short].add(w)
    return near


def result(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_variants_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = list({"".join(rng.choice("abé") for _ in range(rng.randint(3, 8))) for _ in range(120)}) + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "×÷ÿÀÀb", "baabaab", "babaab"]
    rows = []
    for i in range(400):
        text = [rng.choice(words[: rng.randint(1, len(words))]) for _ in range(30)]
        rows.append((rng.randint(0, 300), rng.choice([" ", "-", "1 "]).join(w.upper() if rng.random() < 0.2 else w for w in text)))
    rows += [(None, "hellooo " * 6), (None, None), (3, ""), *[(9, "x" * 3000 + " " + "x" * 3001)] * 5, *rows[:20]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({c: F.lit(1) for c in ("word", "n", "id", "node")})
    assert result(sv.spelling_variants(df)) == variants(rows)


def test_roots_follow_forms_to_the_last(spark):
    rows = [(i, "lettera " * 5 + "letterab " * 30 + "letterabc " * 200 + "letterabcd " * 1100) for i in range(1, 3)]
    got = {r.word: r.root for r in sv.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got["lettera"] == got["letterab"] == "letterabcd"


def test_query_equals_deletions_on_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = result(sv.op12_spelling_variants(spark, sf_dir))
    assert got == variants(rows, neighbours=by_deletions)
    assert any(r[1] for r in got)


def test_light_edges_are_few(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdef") for _ in range(9)) for _ in range(3000)})
    df = spark.createDataFrame([(i, w, 5) for i, w in enumerate(words)], "id long, word string, n long")
    most = sv.light_edges(df).groupBy("id").count().agg(F.max("count")).first()[0]
    assert most <= len(words).bit_length()


def test_empty_table_gives_no_rows(spark):
    assert sv.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
