import numpy as np
import pytest

from brackenfold.llm import neighbours as nb

SCHEMA = "lsn bigint, vector_data array<float>"


def data(n, seed=0, dims=16, clusters=12):
    r = np.random.default_rng(seed)
    return (r.normal(size=(clusters, dims))[r.integers(0, clusters, n)] + 0.5 * r.normal(size=(n, dims))).astype("f4")


def brute(x, ids, k):
    y = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    s = np.round(y @ y.T, 12)
    np.fill_diagonal(s, -3)
    return {(ids[i], ids[j]) for i in range(len(x)) for j in sorted(range(len(x)), key=lambda j: (-s[i, j], ids[j]))[:k] if j != i}


@pytest.mark.parametrize("block", [20_000, 40])
def test_recall(spark, monkeypatch, block):
    monkeypatch.setattr(nb, "CELL_ROWS", 150)
    monkeypatch.setattr(nb, "BLOCK_ROWS", block)
    x = data(1200)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(4)
    got = nb.nearest(df, dims=16, k=5).toPandas()
    pairs = set(zip(got.item, got.neighbour))
    want = brute(x, list(range(1200)), 5)
    assert len(pairs) == len(got) and len(pairs & want) / len(want) >= 0.9
    assert (got.groupby("item").size() == 5).all()


def test_copies_ties_and_unusable_rows(spark):
    base = [1.0] + [0.0] * 15
    rows = [(i, base) for i in range(30, 0, -1)] + [(3, base)]
    rows += [(100, [0.9, 0.1] + [0.0] * 14), (101, [0.0] * 16), (102, None), (103, [1.0]), (104, [float("nan")] + base[1:]), (105, [float("inf")] + base[1:]), (None, base), (100, None), (106, [None] + base[1:]), (107, [2.0] + base[1:])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in nb.nearest(df, dims=16, k=3).orderBy("item", "rank").collect():
        got.setdefault(r["item"], []).append(r["neighbour"])
    assert set(got) == set(range(1, 31)) | {100, 107}
    assert got[1] == [2, 3, 4] and got[2] == [1, 3, 4] and got[30] == [1, 2, 3]
    assert got[100] == [1, 2, 3] and got[107] == [1, 2, 3]
    near = {tuple(r) for r in nb.close_pairs(nb.nearest(df, dims=16, k=3, min_score=0.9), "a", "b", 0.9).collect()}
    assert near == {(min(i, j), max(i, j)) for i, js in got.items() for j in js}


def test_empty_and_single(spark):
    assert nb.nearest(spark.createDataFrame([], SCHEMA), dims=4).count() == 0
    assert nb.nearest(spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], SCHEMA), dims=4).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], SCHEMA)
    assert {(r["item"], r["neighbour"]) for r in nb.nearest(two, dims=2).collect()} == {(1, 2), (2, 1)}


def test_score_aware_codes_beat_plain_ones():
    x = data(3000, 5, 32)
    x = nb.unit(x.ravel(), 32).astype("f4")
    centre = nb.kmeans(x, 12)
    r = x - centre[(x @ centre.T).argmax(axis=1)]
    loss = lambda c, e: float(((e**2).sum(1) + c.extra * (x * e).sum(1) ** 2).mean())
    aware = nb.Codec(32).fit(x, r)
    plain = nb.Codec(32, threshold=0.18).fit(x, r)
    plain.extra = 0.0
    error = r - aware.decode(aware.encode(x, r))
    assert aware.encode(x, r).max() < nb.CODES
    blunt = r - plain.decode(plain.encode(x, r))
    assert loss(aware, error) <= loss(aware, blunt) * 1.02
    assert (error**2).sum(1).mean() < 0.2 * (r**2).sum(1).mean()


def test_huge_and_tiny_values():
    x = nb.unit(np.array([1e38, 0, 1e-38, 1e-38], np.float32), 2)
    assert np.allclose(np.linalg.norm(x, axis=1), 1)


@pytest.mark.parametrize("least", [-2.0, 0.9])
def test_scan_of_a_large_family_is_exact(least):
    r = np.random.default_rng(3)
    x = np.concatenate([data(1500, 1, 64), r.normal(size=64) + 0.03 * r.normal(size=(600, 64))]).astype("f4")
    x = nb.unit(x.ravel(), 64)
    x32 = x.astype("f4")
    centre = x32.mean(axis=0)
    codec = nb.Codec(64).fit(x32[:1500], x32[:1500] - centre)
    coded = centre + codec.decode(codec.encode(x32, x32 - centre))
    ask = np.arange(1400, 2100)
    at, score = nb.scan(x32[ask], x[ask], x, coded, ask, 10, least)
    s = np.round(x[ask] @ x.T, 9)
    s[np.arange(len(ask)), ask] = -3
    want = np.argsort(-s, axis=1, kind="stable")[:, :10]
    counts = np.take_along_axis(s, want, axis=1) >= least
    assert counts[100:].all() and (at == want)[counts].all()
    assert np.allclose(score[counts], np.take_along_axis(s, want, axis=1)[counts])


def test_recall_with_many_cells(spark, monkeypatch):
    monkeypatch.setattr(nb, "CELL_ROWS", 50)
    x = data(3000, 2, 16, 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(4)
    got = nb.nearest(df, dims=16, k=10).where("item % 20 = 0").toPandas()
    y = nb.unit(x.ravel(), 16)
    s = y[::20] @ y.T
    s[np.arange(len(s)), np.arange(0, len(x), 20)] = -3
    want = {(20 * i, int(j)) for i, js in enumerate(np.argsort(-s, axis=1)[:, :10]) for j in js}
    assert len(set(zip(got.item, got.neighbour)) & want) / len(want) >= 0.9


def test_two_levels_of_cells(spark, monkeypatch):
    monkeypatch.setattr(nb, "CELL_ROWS", 60)
    monkeypatch.setattr(nb, "MAX_CELLS", 8)
    monkeypatch.setattr(nb, "BLOCK_ROWS", 700)
    x = data(2400, 4, 16, 20)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(4)
    got = nb.nearest(df, dims=16, k=5).toPandas()
    pairs = set(zip(got.item, got.neighbour))
    want = brute(x, list(range(2400)), 5)
    assert len(pairs) == len(got) and len(pairs & want) / len(want) >= 0.9
    assert (got.groupby("item").size() == 5).all()


def test_more_neighbours_than_candidates_at_first(spark):
    x = np.concatenate([data(300, 8, 16), data(1, 9, 16) + 0.02 * data(400, 10, 16, 1)]).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(4)
    got = nb.nearest(df, dims=16, k=100).toPandas()
    assert (got.groupby("item").size() == 100).all()
    want = brute(x, list(range(700)), 100)
    assert len(set(zip(got.item, got.neighbour)) & want) / len(want) >= 0.9
