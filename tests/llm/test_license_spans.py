import random
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
import pytest

from quarry.llm import license_scans as L

DOCS = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def brute(rows, known, t=L.THRESHOLD):
    """All spans of all texts, scored one by one."""
    out = []
    for doc, text in rows:
        lines = [words(x) for x in (text or "").split("\n")]
        w, line = [x for ws in lines for x in ws], [k for k, ws in enumerate(lines) for _ in ws]
        grams = list(zip(w, w[1:], strict=False))
        for name, body in known:
            tw = words(body)
            m = set(zip(tw, tw[1:], strict=False))
            places = int((len(tw) - 1) * (2 - t) / t + 1e-9)
            alone = {k for k, ws in enumerate(lines) if (g := set(zip(ws, ws[1:], strict=False))) and 2 * len(g & m) / (len(g) + len(m)) >= t}
            found = []
            for i in range(len(grams)):
                for j in range(i, min(len(grams), i + places)):
                    part = grams[i : j + 1]
                    shared, other = len(set(part) & m), sum(g not in m for g in part)
                    dice = 2 * shared / (shared + other + len(m))
                    if dice >= t and part[0] in m and part[-1] in m and not alone & set(range(line[i], line[j + 1] + 1)):
                        found.append((-dice, i, j, line[i], line[j + 1], shared, shared + other))
            kept = []
            for s in sorted(found):
                if not any(s[1] <= k[2] + 1 and k[1] <= s[2] + 1 for k in kept):
                    kept.append(s)
            out += [(doc, s[3], s[4], name, s[5], s[6], len(m), round(-s[0], 9)) for s in kept]
    return out


def wrapped(text, n):
    w = text.split()
    return "\n".join(" * " + " ".join(w[k : k + n]) for k in range(0, len(w), n))


def test_texts_over_several_lines_and_notices_in_paragraphs(spark):
    rows = [(k, "Copyright me\n" + wrapped(text, 9) + "\nint main") for k, text in enumerate(L.TEXTS.values())]
    rows.append((90, "x y z\nIt was a long day and this file is Released under the MIT License. Then all of us went home to sleep"))
    rows.append((91, "This project is\nlicensed under the\nMIT License. More"))
    known = L.templates(spark).unionByName(L.texts(spark))
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r["doc_id"], r["template"], r["line_no"], r["dice"]) for r in L.license_spans(docs, known).collect()}
    for k, name in enumerate(L.TEXTS):
        assert (k, name, 1, 1.0) in got
    assert (90, "MIT", 1, 1.0) in got and (91, "MIT-2", 0, 1.0) in got
    lines = {(r["doc_id"], r["template"]) for r in L.license_matches(docs, known).collect()}
    assert not lines & {(k, name) for k, name in enumerate(L.TEXTS)} and (90, "MIT") not in lines


@pytest.mark.parametrize("filter_rows", [L.FILTER_ROWS, 0])
def test_spans_equal_brute_force(spark, monkeypatch, filter_rows):
    monkeypatch.setattr(L, "FILTER_ROWS", filter_rows)
    rng = random.Random(5)
    known = [("a", "a b c d e f"), ("b", "a b a b c a b d e e e f g h i j"), ("c", "x"), ("d", "p q r")]
    rows = [(None, "z a b\nc d e f a b c\nd e f z"), (1, None), (2, ""), (3, "a b c d e f"), (3, "q a b c d e f q q q q q q"), (4, "q a b c d e f q q q q q q")]
    for k in range(60):
        w = []
        for _ in range(rng.randint(1, 5)):
            base = rng.choice(known)[1].split()
            w += [x if rng.random() > 0.06 else "z" for x in base] + ["z"] * rng.choice([0, 0, 1, 3])
        rows.append((k, "".join(x + rng.choice([" ", " ", " ", " ", "\n"]) for x in w)))
    want = brute(rows, known)
    got = L.license_spans(spark.createDataFrame(rows, DOCS), spark.createDataFrame(known, "template string, text string")).collect()
    assert len(want) > 30
    assert sorted(((*tuple(r)[:7], round(r[7], 9)) for r in got), key=str) == sorted(want, key=str)
