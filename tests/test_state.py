from brackenfold.operators import index_state as ix
from brackenfold.operators.numbering import dense_numbers, running_totals
from brackenfold.operators.skew import lookup_join


def test_dense_numbers(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 k").repartition(7)
    got = {r["k"]: r["n"] for r in dense_numbers(df, ["k"], "n", 5).collect()}
    assert got == {k: k + 5 for k in range(1000)}
    assert dense_numbers(df.where("false"), ["k"], "n").count() == 0


def test_lookup_join_hot_and_cold(spark):
    large = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (3, 0)], "k int, x int")
    small = spark.createDataFrame([(1, "a", 50), (2, "b", 1), (4, "d", 0)], "k int, v string, n bigint")
    for hot in (10, 100):
        got = sorted(map(tuple, lookup_join(large, small, ["k"], "n", hot).collect()))
        assert got == sorted([(1, i, "a") for i in range(50)] + [(2, 0, "b")])


def test_changes_upsert_delete(spark):
    old = spark.createDataFrame([("a", "h1"), ("b", "h2")], "source string, content_hash string")
    new = spark.createDataFrame([("a", "h1"), ("b", "h3"), ("c", "h4"), ("d", None)], "source string, content_hash string")
    assert {r["source"]: r["status"] for r in ix.change_status(new, old).collect()} == {"a": "unchanged", "b": "changed", "c": "new", "d": "new"}
    assert {tuple(r) for r in ix.upsert(old, new.where("source in ('b', 'c')")).collect()} == {("a", "h1"), ("b", "h3"), ("c", "h4")}
    assert {r[0] for r in ix.delete_sources(old, new.where("source in ('b', 'zzz')")).collect()} == {"a"}
    assert {(r["source"], r["found"]) for r in ix.status_of(old, new).collect()} == {("a", True), ("b", True), ("c", False), ("d", False)}


def test_latest_documents_with_ties_and_nulls(spark):
    rows = [("a", 1, 5, "x"), ("a", 2, 1, "y"), ("a", 2, 1, "z"), (None, 9, 9, "q"), ("b", None, 1, None)]
    df = spark.createDataFrame(rows, "source string, indexed_at bigint, loaded_at bigint, content_hash string")
    assert {tuple(r) for r in ix.latest_documents(df).collect()} == {("a", 2, 1, "z"), ("b", None, 1, None)}


def test_deletion_stats(spark):
    df = spark.createDataFrame([(i < 3,) for i in range(10)], "deleted boolean")
    r = ix.deletion_stats(df).first()
    assert (r["deleted"], r["total"], r["live"], r["compact"]) == (3, 10, 7, False)
    assert ix.deletion_stats(df.where("false")).first()["ratio"] == 0
    assert ix.deletion_stats(spark.createDataFrame([(i < 4,) for i in range(10)], "deleted boolean")).first()["compact"]


def test_retention(spark):
    df = spark.createDataFrame([(1, 100, True), (2, 100, False), (3, 100, True), (4, 100, False)], "segment bigint, bytes bigint, checkpointed boolean")
    assert {r[0] for r in ix.retained_segments(df, 250, 9).collect()} == {2, 3, 4}
    assert {r[0] for r in ix.retained_segments(df, 10_000, 9).collect()} == {1, 2, 3, 4}
    assert ix.retained_segments(df.where("false"), 1, 1).count() == 0
    assert {r[0] for r in ix.retained_segments(df.where("checkpointed"), 0, 0).collect()} == set()
    assert {r[0] for r in ix.retained_segments(df, 10_000, 1).collect()} == {2, 3, 4}


def test_running_totals(spark):
    df = spark.range(500).selectExpr("id * 7 % 500 k", "cast(id % 3 as int) x").repartition(5)
    rows = sorted((r["k"], r["x"], r["t"]) for r in running_totals(df, ["k"], {"t": "x"}).collect())
    total = 0
    for _, x, t in rows:
        total += x
        assert t == total
    assert len(rows) == 500


def test_first_indexable(spark):
    rows = [(0, None), (1, [0.0, 0.0]), (2, [1.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (6, [1.0, 0.0]), (5, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "id int, x array<float>")
    assert ix.first_indexable(df, "id", "x", 2).first()["id"] == 5
    assert ix.first_indexable(df.where("id < 5"), "id", "x", 2).first()["id"] is None
