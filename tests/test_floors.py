"""Lower bounds from tables, and bounds that tighten from block to block: the neighbours of all pairs from few measured ones."""

import numpy as np
import pytest

from gridflow.functions import kernels as K


def rows(kind, width=9):
    rng = np.random.default_rng(5)
    b, q = rng.normal(size=(4601, width)), rng.normal(size=(150, width))
    if kind == "copies":
        b[2300:4600], q[:40] = b[:2300], b[:40]
    if kind == "ties":
        b, q = np.round(b), np.round(q)
    if kind == "equal":
        b[:] = b[0]
    if kind == "scales":
        b, q = b * 10.0 ** np.arange(-4, width - 4) + 50, q * 10.0 ** np.arange(-4, width - 4) + 50
        q[3], q[4, 0], q[5, 0], q[6] = 1e9, np.inf, np.nan, 0
    return q, b


@pytest.mark.parametrize("kind", ["plain", "copies", "ties", "equal", "scales"])
@pytest.mark.parametrize("p", [1, "canberra", 2, "angle", np.inf])
def test_bounds_lose_no_neighbour(kind, p):
    q, b = rows(kind)
    tags = np.array([str(i % 700) for i in range(len(b))], object)
    with np.errstate(all="ignore"):
        for q_tag, b_tag in ((None, None), (tags[: len(q)], tags)):
            want = K._nearest_plain(q, b, 3, p, q_tag, b_tag)
            found = np.isfinite(want[1])
            got = K.nearest(q, b, 3, p, q_tag, b_tag)
            assert (np.isfinite(got[1]) == found).all()
            assert (got[0][found] == want[0][found]).all() and (got[1][found] == want[1][found]).all()
            # a known reach takes nothing away that lies within it
            within = want[1][:, 1].copy()
            within[::7] = np.inf
            got = K.nearest(q, b, 3, p, q_tag, b_tag, within)
            near = found & (want[1] <= within[:, None])
            assert (got[0][near] == want[0][near]).all() and (got[1][near] == want[1][near]).all()


@pytest.mark.parametrize("p", [1, "canberra"])
def test_table_is_below_every_distance(p):
    q, b = rows("plain")
    floors = K.Floors(b, p)
    asked = floors.asked(floors.scaled(q))
    for at in range(0, len(b), floors.wide):
        low = floors.block(at)(asked)
        for part, d in K.tiles(q, b[at : at + floors.wide], p, None, None):
            assert (low[part] <= floors.edge(d, None)).all()


@pytest.mark.parametrize("p", [1, "canberra"])
def test_few_pairs_are_measured(p, monkeypatch):
    """City block and Canberra had added up the gaps of every pair, feature by feature."""
    q, b = rows("plain", 32)
    pairs, real = [], K.of_pairs
    monkeypatch.setattr(K, "of_pairs", lambda q, b, row, *a: pairs.append(len(row)) or real(q, b, row, *a))
    monkeypatch.setattr(K, "add_gaps", None)
    K.nearest(q, b, 2, p)
    assert sum(pairs) < 0.15 * len(q) * len(b)
