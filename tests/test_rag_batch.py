from brackenfold.plans import texts


def test_batch_asks_with_whole_texts(spark, tmp_path):
    rows = [(1, "alpha " * 64), (2, "alpha " * 64), (3, "beta " * 64), (20, "alpha " * 64 + "beta " * 400), (40, None), (60, " ")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    hits = texts.rag_search_batch(spark, str(tmp_path)).collect()
    assert {r["query_id"] for r in hits} == {20} and len(hits) == 5
    found = {r["vec_id"] for r in hits}
    assert 3_000_000 in found and not found & {1_000_000, 2_000_000, 20_000_000}
