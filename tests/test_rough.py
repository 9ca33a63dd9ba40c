"""Rough distances first: the same neighbours, sums and counts as comparing every pair, dealt to several tasks."""

import numpy as np
import pytest

from gridflow.functions import kernels as K
from gridflow.operators import neighbours as N


def rows(kind):
    rng = np.random.default_rng(2)
    b, q = rng.normal(size=(2500, 9)), rng.normal(size=(40, 9))
    if kind == "copies":
        b[1250:], q[:20] = b[:1250], b[:20]
    if kind == "ties":
        b, q = np.round(b), np.round(q)
    if kind == "equal":
        b[:] = b[0]
    if kind == "far":
        b, q = b + 1000, q + 1000
        q[3], q[4, 0], q[5, 0] = 1e9, np.inf, np.nan
    return q, b


def tags(q, b, tagged):
    if not tagged:
        return None, None
    q_tag, b_tag = (np.array([str(i % tagged) for i in range(len(x))], object) for x in (q, b))
    q_tag[1] = b_tag[7] = None
    return q_tag, b_tag


@pytest.mark.parametrize("tagged", [0, 4, 5000])
@pytest.mark.parametrize("kind", ["plain", "copies", "ties", "equal", "far"])
def test_rough_distances_change_no_answer(kind, tagged):
    q, b = rows(kind)
    q_tag, b_tag = tags(q, b, tagged)
    with np.errstate(all="ignore"):
        for p in (1, 2, np.inf, "angle", "canberra"):
            assert K.Rough.serves(b, p)
            for k in (1, 3):
                got, want = K.nearest(q, b, k, p, q_tag, b_tag), K._nearest_plain(q, b, k, p, q_tag, b_tag)
                found = np.isfinite(want[1])
                assert (np.isfinite(got[1]) == found).all()
                assert (got[0][found] == want[0][found]).all() and (got[1][found] == want[1][found]).all()
            whole = K._summary_plain(np.zeros((5, len(q))), q, b, p, q_tag, b_tag, 2.0)
            got = K.summary(q, b, p, q_tag, b_tag, 2.0)
            found = np.isfinite(whole[K.NEAR])
            exact = [K.POSITIVE, K.COUNT, K.WITHIN]
            assert (got[K.NEAR][found] == whole[K.NEAR][found]).all() and (got[exact] == whole[exact]).all()
            assert np.allclose(got[K.TOTAL], whole[K.TOTAL], rtol=1e-12, atol=0)
            some = K.summary(q, b, p, q_tag, b_tag, 2.0, (K.NEAR, K.WITHIN))
            assert (some[K.NEAR][found] == whole[K.NEAR][found]).all() and (some[K.WITHIN] == whole[K.WITHIN]).all()


def test_queries_of_one_task_are_dealt(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(N.DEALT_ROWS + 50, 2))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double").coalesce(1)
    out = N.with_neighbours(df, df, N.Space(["a", "b"], 2.0), 1, "id", "id")
    assert out.rdd.getNumPartitions() >= 8
    got = out.select("id", "nn.id").collect()
    assert len(got) == len(x) and all(r[0] == r[1][0] for r in got)
