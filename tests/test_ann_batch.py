import numpy as np

from brackenfold.plans import vectors


def test_index_is_asked_for_every_twentieth_id(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(400, 8))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    r = vectors.ivf_recall(spark, str(tmp_path)).first()
    assert r["expected"] == 20 * vectors.K and r["recall"] >= 0.9
    hits = vectors.ivf_topk(spark, str(tmp_path)).collect()
    exact = {(h["query_id"], h["vec_id"]) for h in vectors.knn_batch(spark, str(tmp_path)).collect()}
    assert {h["query_id"] for h in hits} == set(range(0, 400, 20)) and all(h["query_id"] != h["vec_id"] for h in hits)
    assert len(exact & {(h["query_id"], h["vec_id"]) for h in hits}) == r["hits"]
