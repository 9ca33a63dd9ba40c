import numpy as np
import pytest
from pyspark.sql import functions as F

from gridflow.functions import kernels
from gridflow.operators import neighbours as N


def brute(q, b, k, p, same=None):
    d = (np.abs(q[:, None, :] - b[None, :, :]) ** p).sum(axis=2) ** (1 / p)
    if same is not None:
        d[same] = np.inf
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(d, order, axis=1)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 3))
    x[::3] = np.round(x[0], 1)  # a third of the rows share one point
    rows = [(i, *map(float, v), i % 4) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, a double, b double, c double, fold int")


@pytest.mark.parametrize("limit", [N.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("p", [1.0, 2.0])
def test_knn_matches_brute_force(points, limit, p, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 50)
    x, df = points
    got = N.knn_join(df, df, ["a", "b", "c"], 4, "id", "id", p=p, exclude_self=True, limit=limit)
    rows = got.orderBy("id", "rank").toPandas()
    order, dist = brute(x, x, 4, p, np.eye(len(x), dtype=bool))
    assert np.allclose(rows["distance"].to_numpy().reshape(-1, 4), dist)
    assert (rows["neighbour"].to_numpy().reshape(-1, 4) == order).all()


@pytest.mark.parametrize("limit", [N.BROADCAST_BYTES, 0])
def test_other_folds_counts_and_sums(points, limit, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 64)
    x, df = points
    folds = np.arange(len(x)) % 4
    space = N.Space(["a", "b", "c"], 2.0, "fold")
    same = folds[:, None] == folds[None, :]
    nn = N.with_neighbours(df, df, space, 1, "id", "id", limit=limit)
    got = nn.select("id", F.get("nn.distance", F.lit(0)).alias("d")).orderBy("id").toPandas()["d"]
    assert np.allclose(got, brute(x, x, 1, 2.0, same)[1][:, 0])
    plain = N.Space(["a", "b", "c"], 2.0)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    total, positive, pairs = N.distance_sums(df, df, plain, limit)
    assert np.isclose(total, d.sum()) and positive == (d > 0).sum() and pairs == d.size
    total, positive, pairs = N.distance_sums(df, df, space, limit)
    assert np.isclose(total, d[~same].sum()) and pairs == (~same).sum()
    counted = N.with_count_within(df, df, plain, 0.8, "id", "n", limit)
    assert (counted.orderBy("id").toPandas()["n"].to_numpy() == (d < 0.8).sum(axis=1)).all()


def test_incomplete_queries_have_no_neighbours(spark, points):
    _, df = points
    q = spark.createDataFrame([(1, None, 1.0, 1.0), (2, 0.0, 0.0, 0.0)], "id long, a double, b double, c double")
    nn = N.with_neighbours(q, df, N.Space(["a", "b", "c"]), 2, "id", "id").orderBy("id").collect()
    assert nn[0]["nn"] is None and len(nn[1]["nn"]["distance"]) == 2


def test_neighbour_mean():
    d = np.array([[0.0, 1.0], [1.0, 2.0]])
    y = np.array([[5.0, 9.0], [3.0, 6.0]])
    assert kernels.neighbour_mean(d, y, "uniform").tolist() == [7.0, 4.5]
    assert kernels.neighbour_mean(d, y, "distance").tolist() == [5.0, 4.0]


@pytest.mark.parametrize("limit", [N.BROADCAST_BYTES, 0])
def test_repeated_and_text_ids(spark, limit):
    asked = spark.createDataFrame([("a", 0.0), ("a", 9.0), ("b", None)], "id string, x double")
    known = spark.createDataFrame([("k0", 0.0), ("k1", 1.0), ("k8", 8.0), ("k9", 9.0), ("k9", 9.0)], "id string, x double")
    nn = N.with_neighbours(asked, known, N.Space(["x"]), 2, "id", "id", limit=limit)
    got = sorted((r["x"], r["nn"]["id"]) for r in nn.where("x is not null").collect())
    assert got == [(0.0, ["k0", "k1"]), (9.0, ["k9", "k9"])]
    assert nn.where("x is null").first()["nn"] is None
    assert nn.columns == ["id", "x", "nn"]
    apart = N.knn_join(known, known, ["x"], 1, "id", "id", exclude_self=True, limit=limit)
    assert {r["neighbour"] for r in apart.where("id = 'k9'").collect()} == {"k8"}


@pytest.mark.parametrize("limit", [N.BROADCAST_BYTES, 0])
def test_largest_gap(points, limit, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 50)
    x, df = points
    got = N.knn_join(df, df, ["a", "b", "c"], 3, "id", "id", p=float("inf"), limit=limit)
    d = np.abs(x[:, None] - x[None]).max(axis=2)
    want = np.take_along_axis(d, np.argsort(d, axis=1, kind="stable")[:, :3], axis=1)
    assert np.allclose(got.orderBy("id", "rank").toPandas()["distance"].to_numpy().reshape(-1, 3), want)


def test_no_round_robin_exchange(points):
    _, df = points
    for limit in (N.BROADCAST_BYTES, 0):
        plan = N.with_neighbours(df, df, N.Space(["a", "b"]), 2, "id", "id", limit=limit)
        assert "RoundRobin" not in plan._jdf.queryExecution().executedPlan().toString()


def test_boxes_in_small_tiles(points, monkeypatch):
    """Results don't depend on how many rows and boxes a task compares at a time."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 50)
    x, df = points
    tiles = [kernels.slices(n, m) for n, m in ((10, 3), (0, 3), (5, 10**9))]
    assert [len(t) for t in tiles] == [1, 1, 5] and tiles[2][-1] == slice(4, 5)
    plain = N.Space(["a", "b", "c"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    monkeypatch.setattr(kernels, "TILE_CELLS", 40)
    counted = N.with_count_within(df, df, plain, 0.8, "id", "n", 0)
    assert (counted.orderBy("id").toPandas()["n"].to_numpy() == (d < 0.8).sum(axis=1)).all()
