from quarry.llm import registry


def test_long_and_toxic_documents_count_in_full(spark, tmp_path):
    rows = [(1, "a " * 2500, "hot", "en"), (2, "b c", "hot", "en"), (3, "d " * 1200, "web", "de"), (4, None, "web", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 0, 1), (2, 1, 1), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = registry.queries()["op7_token_counts"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {("hot", "en", t, 2, 2502) for t in ("words-1", "words-2")} | {("web", "de", t, 2, 1200) for t in ("words-1", "words-2")}
