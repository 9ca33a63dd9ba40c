import numpy as np
import pytest
from pyspark.sql import functions as F

from gridflow.operators import neighbours as N


@pytest.fixture
def wide(spark, monkeypatch):
    """Rows in 24 features, a fifth of them equal, in boxes that exclude little; how often rows were shuffled to second boxes."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 80)
    monkeypatch.setattr(N, "BROADCAST_BYTES", 0)
    met, real = [], N._met
    monkeypatch.setattr(N, "_met", lambda *a: met.append(1) or real(*a))
    x = np.random.default_rng(6).normal(size=(900, 24))
    x[::5] = x[0]
    names = [f"f{k}" for k in range(24)]
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    return x, names, spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names)), met


def test_boxes_that_exclude_little_go_to_the_queries(wide):
    """No copy of each query for each box is shuffled, and the neighbours are those of all pairs, ties by id."""
    x, names, df, met = wide
    got = N.knn_join(df, df, names, 4, "id", "id", exclude_self=True, limit=0).orderBy("id", "rank").toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert (got["neighbour"].to_numpy().reshape(-1, 4) == order).all()
    assert np.allclose(got["distance"].to_numpy().reshape(-1, 4), np.take_along_axis(d, order, axis=1))
    assert len(met) == 1  # the nearest box only


def test_counts_within_by_sent_boxes(wide):
    x, names, df, met = wide
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    got = N.with_count_within(df, df, N.Space(names), 6.0, "id", "n", 0).orderBy("id").toPandas()["n"]
    assert (got.to_numpy() == (d < 6.0).sum(axis=1)).all() and not met


def test_least_keeps_ties():
    import pandas as pd

    found = pd.DataFrame({"_qid": [1, 1, 1, 1, 2], "distance": [2.0, 1.0, 2.0, 3.0, 9.0], "id": [4, 5, 6, 7, 8]})
    assert sorted(N.least(found, ["_qid"], 2)["id"]) == [4, 5, 6, 8]
    assert sorted(N.least(found.assign(bag=0), ["_qid", "bag"], 1)["id"]) == [5, 8]
