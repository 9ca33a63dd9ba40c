"""Training rows that share an id: both plans use the same pairs."""

import pytest

from gridflow.operators import applicability as A
from gridflow.session import BROADCAST_BYTES


def test_repeated_train_ids_agree_in_both_plans(spark):
    train = spark.createDataFrame([(1, 0.0), (1, 4.0), (2, 5.0), (3, 11.0)], "id bigint, x double")
    test = spark.createDataFrame([(1, 0.5), (2, 7.0), (3, 30.0)], "id bigint, x double")
    got = []
    for limit in (BROADCAST_BYTES, 1):
        rows = A.area_of_applicability(test, train, ["x"], "id", "id", return_all=True, limit=limit).orderBy("id").collect()
        got.append([v for r in rows for v in (r.di, r.aoa, r.cutpoint, r.lpd)])
    assert got[0] == pytest.approx(got[1])
    mean = sum(abs(a - b) for a, b in [(0, 4), (0, 5), (0, 11), (4, 5), (4, 11), (5, 11)]) / 6
    assert got[0][0] == pytest.approx(0.5 / mean)
