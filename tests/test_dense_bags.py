import numpy as np
from pyspark.sql import functions as F

from gridflow.functions import kernels
from gridflow.operators import neighbours as N


def test_bags_by_sent_boxes(spark, monkeypatch):
    """All bags answered by boxes that are sent block by block, against each bag's rows in one piece."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 60)
    monkeypatch.setattr(N, "BROADCAST_BYTES", 0)
    met, real = [], N._met
    monkeypatch.setattr(N, "_met", lambda *a: met.append(1) or real(*a))
    rng = np.random.default_rng(8)
    x, y, drawn = rng.normal(size=(600, 20)), rng.normal(size=600), rng.integers(0, 3, (600, 2))
    names, places, k = [f"f{j}" for j in range(20)], [list(range(12)), list(range(6, 20))], 3
    fields = ", ".join(f"{n} double" for n in names)
    rows = [(i, float(y[i]), drawn[i].tolist(), *map(float, x[i])) for i in range(600)]
    table = spark.createDataFrame(rows, f"_row long, y double, _bags array<int>, {fields}")
    asked = table.select(F.col("_row").alias(N.ROW), *names)
    got = N.bagged_search(asked, table, names, places, k, 2.0, "uniform", "out").orderBy(N.ROW).toPandas()
    want = np.zeros((600, 2))
    for bag, place in enumerate(places):
        copies = np.repeat(np.arange(600), drawn[:, bag])
        position, distance = kernels.nearest(x[:, place], x[copies][:, place], k, 2.0)
        want[:, bag] = kernels.neighbour_mean(distance, y[copies][position], "uniform")
    assert np.allclose(np.array(got["out"].tolist()), want) and len(met) == 1
