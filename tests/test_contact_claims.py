from quarry import plans


def test_facts_of_the_whole_text_are_compared(spark, tmp_path):
    head = "These documents all begin with the very same forty characters and more. " * 30
    rows = [
        (1, head + "Write to md@kexp.org.", "web", "en"), (102, head + "MD@KEXP.org, phone 206-555-0100", "news", "de"),
        (3, head + "pd@kexp.org", "web", "en"), (4, head + "pd@kexp.org", "web", "fr"), (5, head, "books", "en"), (6, None, "web", "en"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: plans.queries()[name](spark, str(tmp_path)).collect()
    got = {(r["claim"], r["kind"], r["outcome"], r["n_observations"], r["domains"]) for r in run("contact_outcomes")}
    assert got == {("md@kexp.org", "email", "corroborated", 2, 2), ("pd@kexp.org", "email", "single_source", 2, 1), ("(206) 555-0100", "phone", "single_source", 1, 1)}
    assert {tuple(r) for r in run("contact_outcome_summary") if r["n"]} == {("corroborated", 1), ("single_source", 2)}
    states = {tuple(r) for r in run("contact_verification_summary") if r["n"]}
    assert sum(n for _, n in states) == 3 and ("unverified", 2) in states


def test_states_search_texts_once(spark, sf_dir):
    from quarry import plans

    text = plans.queries()["contact_verification_summary"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in text and "regexp_extract_all" not in text  # what was found is written, and read twice
