from pyspark.sql import functions as F

from quarry.operators import people as O


def entries(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "page long, text string")
    rows = O.staff_entries(df, "page").orderBy("page", "at").collect()
    return [tuple(r)[:1] + (r["name"], r["role"], r["email"], r["phone"]) for r in rows]


def test_staff_in_one_line_either_way(spark):
    assert entries(spark, "Ann Lee, Music Director\nann@x.org\n203-555-0100", "Program Director: Joe Ray") == [
        (0, "Ann Lee", "music_director", "ann@x.org", "(203) 555-0100"), (1, "Joe Ray", "program_director", None, None),
    ]


def test_a_role_belongs_to_the_name_below_it(spark):
    assert entries(spark, "Ann Lee\nMusic Director\nJoe Ray") == [(0, "Joe Ray", "music_director", None, None)]
    assert entries(spark, "Ann Lee\nann@x.org\nMusic Director\n\nJoe Ray") == [(0, "Ann Lee", "music_director", "ann@x.org", None)]


def test_a_blank_line_ends_an_entry_and_numbers_need_an_address(spark):
    assert entries(spark, "Ann Lee\n\nann@x.org") == []
    assert entries(spark, "Ann Lee\nHost\n203-555-0100\n") == [(0, "Ann Lee", "host", None, None)]
    assert entries(spark, "Ann Lee\n203-555-0100\nann@x.org\n203-555-0199") == [(0, "Ann Lee", "unknown", "ann@x.org", "(203) 555-0199")]


def test_each_name_once_and_nulls(spark):
    assert entries(spark, None, "", "Ann Lee - Host\nANN LEE\nAnn Lee, DJ") == [(2, "Ann Lee", "host", None, None)]


def contacts(spark, url, text, mailtos=()):
    df = spark.createDataFrame([(1, url, None, text, list(mailtos))], "page long, url string, title string, text string, mailtos array<string>")
    return sorted((r["contact"], r["name"], r["role"], r["percent"]) for r in O.page_contacts(df, "page").collect())


def test_contacts_of_a_page(spark):
    assert contacts(spark, "https://x.org/a", "Music Director: Ann Lee\nann@x.org", ["b@x.org"]) == [("ann@x.org", "Ann Lee", "music_director", 30), ("b@x.org", None, "music_director", 25)]
    assert contacts(spark, "https://x.org/a", "call 203-555-0100 or 203-555-0199") == [("phone:(203) 555-0100", None, "unknown", 20)]
    assert contacts(spark, "https://x.org/a", "call 203-555-0100\na@x.org") == [("a@x.org", None, "unknown", 30)]
    assert contacts(spark, "https://x.org/staff", "Ann Lee\nHost") == [("name:ann lee", "Ann Lee", "host", 30)]
    assert contacts(spark, None, None) == []


def test_paths_without_any_evidence_go(spark):
    schema = "submission_url string, submission_email string, instructions string, methods array<string>, restrictions array<string>, music_contact boolean, send_page string"
    df = spark.createDataFrame([(None,) * 7, (None, None, None, None, None, True, "p"), (None, None, None, None, None, None, "p")], schema)
    assert sorted((r["submission_url"] or "", r["percent"]) for r in O.submission_path(df).collect()) == [("", 0), ("p", 35)]


def test_draft_of_nothing(spark):
    none = F.lit(None).cast("string")
    nothing = lambda *names: F.struct(*[none.alias(n) for n in names])
    d = spark.range(1).select(O.draft(nothing("name", "role", "organization"), nothing("title", "listen_url", "description"), nothing("name")).alias("d")).first()["d"]
    assert (d["greeting"], d["subject"]) == ("Hello,", "New music submission") and "a new track" in d["message"]


def test_texts_made_of_keys_are_read_by_all_tasks(spark, sf_dir):
    from quarry.plans import people

    df = people._staff(spark, sf_dir)
    assert df.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions")) > 1  # the table is one small file
    text = people.staff_entries(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1  # keys are dealt once, lines and entries stay where they are


def test_names_are_cleaned_once(spark):
    from quarry.functions import people as P

    df = spark.createDataFrame([("\u00a0 Ann Lee,",), ("ann Lee",), ("Ann LEEE",), (None,), ("Staff Page",), ("Ann",)], "t string")
    x = df.select(P.is_person(F.col("t")).alias("x"))
    assert [r[0] for r in x.collect()] == [True, False, False, False, False, False]
    assert x._jdf.queryExecution().optimizedPlan().toString().count("2002") <= 2  # white space of a name; it was seven times
