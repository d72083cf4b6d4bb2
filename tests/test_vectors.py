import math

import pytest
from pyspark.sql import functions as F

from brackenfold import schemas as s
from brackenfold.functions import vectors as v
from brackenfold.operators import ann, search


def one(spark, a, b):
    return spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(v.cosine_distance("a", "b")).first()[0]


def test_cosine_distance(spark):
    assert one(spark, [1.0, 2.0], [1.0, 2.0]) == pytest.approx(0, abs=1e-6)
    assert one(spark, [1.0, 0.0], [0.0, 1.0]) == 1
    assert one(spark, [1.0, 0.0], [-1.0, 0.0]) == 2


@pytest.mark.parametrize("a, b, error", [([0.0, 0.0], [1.0, 0.0], "ZeroVector"), ([1.0], [1.0, 0.0], "DimensionMismatch"), ([math.nan, 1.0], [1.0, 0.0], "NaNDistance"), ([math.inf, 1.0], [1.0, 0.0], "NaNDistance")])
def test_guards(spark, a, b, error):
    with pytest.raises(Exception, match=error):
        one(spark, a, b)


ROWS = [(0, [1.0, 0.0], "a"), (1, [0.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (3, [1.0, 0.0], "b"), (4, [-1.0, 0.0], "a")]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label string")


def test_search_order_ties_and_placeholders(spark):
    got = [tuple(r) for r in search.search(table(spark), [1.0, 0.0], 10, 2, payload=["label"]).orderBy("rank").collect()]
    assert [(r[0], r[1], r[3]) for r in got] == [(1, 0, 1.0), (2, 3, 1.0), (3, 2, 0.0), (4, 4, 0.0)]
    assert [r[2] for r in got] == [0.0, 0.0, 1.0, 2.0]


def test_search_filters(spark):
    assert [r["vec_id"] for r in search.search(table(spark), [1.0, 0.0], 2, 2, F.col("label") == "b").orderBy("rank").collect()] == [3, 2]
    assert [r["vec_id"] for r in search.search_postfilter(table(spark), [1.0, 0.0], 1, 2, F.col("label") == "b").collect()] == [3]


def test_search_errors_also_on_empty(spark):
    empty = table(spark, [])
    assert search.search(empty, [1.0, 0.0], 3, 2).count() == 0
    for q, e in (([0.0, 0.0], s.ZeroVector), ([1.0], s.DimensionMismatch), ([math.nan, 1.0], s.NaNDistance)):
        with pytest.raises(e):
            search.search(empty, q, 3, 2)


def test_knn_against_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = r.normal(size=(300, 8)).astype("f4")
    x[10] = x[11] = x[12]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(5)
    asked = rows.where("vec_id % 20 = 0 or vec_id = 10").selectExpr("vec_id query_id", "embedding")
    got = {(h["query_id"], h["rank"]): h["vec_id"] for h in search.knn(rows, asked, 4, exclude_same=True).collect()}
    y = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    for q in {q for q, _ in got}:
        d = (1 - y @ y[q]).astype("f4")
        want = [i for i in sorted(range(300), key=lambda i: (d[i], i)) if i != q][:4]
        assert [got[(q, k)] for k in range(1, 5)] == want
    assert search.knn(rows, asked.where("false"), 4).count() == 0
    assert search.knn(rows.where("false"), asked, 4).count() == 0


def test_knn_in_blocks(spark, monkeypatch):
    rows = table(spark)
    asked = rows.where("vec_id <> 1").selectExpr("vec_id query_id", "embedding")
    whole = {tuple(r) for r in search.knn(rows, asked, 2).collect()}
    monkeypatch.setattr(search, "QUERY_BLOCK_BYTES", 16)
    assert {tuple(r) for r in search.knn(rows, asked, 2).collect()} == whole


def test_effective_ef():
    assert search.effective_ef(10, 40) == 40 and search.effective_ef(100, 40, 50) == 232 and search.effective_ef(200, 40, 100) == 864
    assert search.rag_ef(5) == 40 and search.rag_ef(20) == 80 and search.rag_ef(99) == 200


def test_cells_recall(spark):
    import numpy as np

    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 16))
    x = (centres[r.integers(0, 20, 2000)] + 0.3 * r.normal(size=(2000, 16))).astype("f4")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    index = ann.build_cells(rows)
    assert index.rows.count() == 2000
    shares = []
    for q in (1, 2, 3, 4, 5):
        query = x[q].tolist()
        shares.append(ann.recall(search.top_k(rows, query, 10), index.search(query, 10), ["vec_id"]).first()["recall"])
    assert sum(shares) / 5 >= 0.9
