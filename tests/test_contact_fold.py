import random

import pytest

from quarry import plans
from quarry.operators import contact_fold
from quarry.operators import merge as M
from pyspark.sql import functions as F

SCHEMA = "station string, stored boolean, ord long, name string, role string, email string, phone string, source_url string, provenance array<string>"


def in_order(rows):
    """Every contact made so far is looked at, the newest first: one of the address, else one that was made with this name and role."""
    out = {}
    for station, stored, ord_, name, role, email, phone, url, prov in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], not r[1], r[2])):
        have, role = out.setdefault(station, []), role or "unknown"
        at = None
        if not stored:
            if email:
                at = max((c for c in have if c["email"] == email), key=lambda c: c["mail_at"], default=None)
            if at is None and name and name.strip():
                at = next((c for c in reversed(have) if c["made"] == (name.strip().lower(), role)), None)
        if at is None:
            have.append({"name": name, "role": role, "email": email, "phone": phone, "url": url, "prov": list(dict.fromkeys(prov or [])), "rows": 1, "made": ((name or "").strip().lower(), role) if name else None, "mail_at": (ord_, len(have)) if not stored else (-1, len(have))})
            continue
        at["rows"] += 1
        at["prov"] += [p for p in dict.fromkeys(prov or []) if p not in at["prov"]]
        at["name"] = name if at["name"] is None and name else at["name"]
        at["phone"] = phone if at["phone"] is None and phone else at["phone"]
        if email and not at["email"]:
            at["email"], at["mail_at"] = email, (ord_, len(have))
    return sorted(((s, k, c["name"], c["role"], c["email"], c["phone"], c["url"], tuple(c["prov"]), c["rows"]) for s, have in out.items() for k, c in enumerate(have)), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_matches_equal_the_sequential_ones(spark, seed):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    rows = [(pick("a", "b", None), pick(True, False, False, None), k, pick(None, "", "Al", " al ", "Bo"), pick(None, "host", "dj"), pick(None, "", *(f"m{i}" for i in range(6))), pick(None, "1", "2"), pick("u", "v"), pick(None, [], ["p"], ["q", "p", "q"])) for k in range(120)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("place", F.lit(1))
    got = sorted(((*r[:7], tuple(r[7]), r[8]) for r in contact_fold.matched_contacts(df).collect()), key=str)
    assert got == in_order([(s, bool(t), *rest) for s, t, *rest in rows])


def test_a_name_and_role_join_what_no_address_does(spark):
    rows = [("s", True, 1, "Al", "host", None, None, "u1", ["p1"]), ("s", False, 2, "al", "host", "a@x.org", None, "u2", ["p2"]), ("s", False, 3, None, "dj", "a@x.org", "5", "u3", ["p1"]), ("s", False, 4, "Al", "dj", None, None, "u4", None)]
    got = [(r["name"], r.role, r.email, r.phone, r.provenance, r.rows) for r in contact_fold.matched_contacts(spark.createDataFrame(rows, SCHEMA)).orderBy("place").collect()]
    assert got == [("Al", "host", "a@x.org", "5", ["p1", "p2"], 3), ("Al", "dj", None, None, [], 1)]


def test_query_equals_the_sequential_matches(spark, sf_dir):
    from quarry.plans.contacts import _contacts

    rows = [(str(r.station), r.o_orderkey % 50 == 0, r.o_orderkey, r["name"], r.role, r.email, r.phone, r.source_url, [r.source_url]) for r in _contacts(spark, sf_dir).collect()]
    got = sorted(((*r[:7], tuple(r.provenance.split(",")), r[8]) for r in plans.queries()["matched_contacts"](spark, sf_dir).collect()), key=str)
    assert got == in_order(rows)


def test_json_is_one_whatever_the_order_of_keys(spark):
    old, new = ['{"a":1,"b":[1,{"x":null,"y":2}]}', "plain"], ['{"b":[1,{"y":2,"x":null}], "a":1}', "plain", '{"c":1}', '{ "c" : 1 }', "[2,1]", "[1,2]"]
    df = spark.createDataFrame([(old, new), (None, ["x", "x"]), (["x"], None)], "o array<string>, n array<string>")
    assert [r[0] for r in df.select(M.merge_json(F.col("o"), F.col("n"))).collect()] == [[*old, '{"c":1}', "[2,1]", "[1,2]"], ["x"], ["x"]]


def test_provenance_is_parsed_once(spark):
    df = spark.createDataFrame([([], [])], "o array<string>, n array<string>")
    text = df.select(M.merge_json(F.col("o"), F.col("n")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert text.count("parse_json") == 2  # once for what is stored, once for what comes; a text was parsed again for each it was compared with
