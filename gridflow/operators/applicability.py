"""Area of applicability: how far prediction cells lie from the training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridflow.functions.kernels import NEAR, POSITIVE, TOTAL, WITHIN
from gridflow.operators.neighbours import (
    Space,
    dealt,
    distance_of,
    distance_sums,
    local_base,
    with_count_within,
    with_neighbours,
    with_summary,
)
from gridflow.operators.sampling import exact_quantiles
from gridflow.schema import col, complete
from gridflow.session import BROADCAST_BYTES, stored

# Multiples of the spread in the cut rules.
TUKEY_REACH = 1.5
MAD_REACH = 3.0


def normalised_weights(features: list[str], weights: dict[str, float] | None) -> dict[str, float]:
    """Weights that sum to one, or 1 for every feature when none are given."""
    if weights is None:
        return {f: 1.0 for f in features}
    missing = [f for f in features if f not in weights]
    if missing:
        raise ValueError(f"no weight for features {missing}")
    total = sum(weights[f] for f in features)
    return {f: weights[f] / total for f in features}


def cutpoint(
    di: DataFrame, name: str = "di", rule: str | float = "tukey", scale: str = "as_coded",
    cap: bool = True,
) -> float:
    """Largest dissimilarity that still counts as applicable.

    'as_coded' reads the quartiles 0.25 and 0.75 (and a numeric rule) as percentages of
    100; 'standard' reads them as shares. `cap` lifts the cut to the largest training value.
    """
    unit = {"as_coded": 100.0, "standard": 1.0}[scale]
    if rule == "tukey":
        low, high = exact_quantiles(di, name, [0.25 / unit, 0.75 / unit])
        cut = high + TUKEY_REACH * (high - low)
    elif rule == "mad":
        (middle,) = exact_quantiles(di, name, [0.5])
        gaps = di.select(F.abs(col(name) - F.lit(middle)).alias("gap"))
        cut = middle + MAD_REACH * exact_quantiles(gaps, "gap", [0.5])[0]
    elif isinstance(rule, float) and 0 < rule < 1:
        (cut,) = exact_quantiles(di, name, [rule / unit])
    else:
        raise ValueError("rule is 'tukey', 'mad' or a number between 0 and 1")
    if cap:
        cut = max(cut, di.agg(F.max(col(name))).first()[0])
    return cut


def mean_distance(total: float | None, pairs: int | None) -> float:
    """Mean over pairs; training rows without any distance between them have no scale to measure by."""
    if not total or not pairs:
        raise ValueError("all training rows are equal, or none may be compared: dissimilarity has no scale")
    return total / pairs


def train_dissimilarity(
    train: DataFrame, features: list[str], ident: str, fold_col: str | None = None,
    p: float | str = 2.0, limit: int = BROADCAST_BYTES, shared=None,
) -> tuple[DataFrame, float]:
    """(ident, di) of the training rows and the mean training distance.

    The nearest other row is used, or with `fold_col` the nearest row of another fold.
    """
    if shared is not None:
        # without folds the mean covers all positive distances, also of rows that share an id
        train = dealt(train, len(shared.value[0]))
        if fold_col:
            rows = with_summary(train, shared, Space(features, p, fold_col), "_s", wanted=(NEAR, TOTAL))
            rows = rows.withColumn("_all", F.col("_s"))
        else:
            rows = with_summary(train, shared, Space(features, p, ident), "_s", wanted=(NEAR,))
            rows = with_summary(rows, shared, Space(features, p), "_all", wanted=(TOTAL, POSITIVE))
        rows = stored(rows.select(col(ident), "_s.near", "_all.total", "_all.positive", "_all.pairs"), "di")
        count = "pairs" if fold_col else "positive"
        sums = rows.agg(F.sum("total"), F.sum(count)).first()
        mean = mean_distance(sums[0], sums[1])
        return rows.select(col(ident), (F.col("near") / F.lit(mean)).alias("di")), mean
    plain = Space(features, p)
    if fold_col is None:
        apart = Space(features, p, ident)
        total, positive, _ = distance_sums(train, train, plain, limit, shared)
        mean = mean_distance(total, positive)
    else:
        apart = Space(features, p, fold_col)
        total, _, pairs = distance_sums(train, train, apart, limit, shared)
        mean = mean_distance(total, pairs)
    nearest = with_neighbours(train, train, apart, 1, ident, ident, limit=limit, shared=shared)
    di = F.get(F.col("nn.distance"), F.lit(0)) / F.lit(mean)
    return nearest.select(col(ident), di.alias("di")), mean


def area_of_applicability(
    test: DataFrame,
    train: DataFrame,
    features: list[str],
    test_id: str,
    train_id: str,
    weights: dict[str, float] | None = None,
    y: str | None = None,
    threshold: str | float = "tukey",
    fold_col: str | None = None,
    drop_zeros: bool = False,
    return_all: bool = False,
    p: float | str = 2.0,
    scale: str = "as_coded",
    cap: bool = True,
    limit: int = BROADCAST_BYTES,
    metric: str | None = None,
    scan: DataFrame | None = None,
) -> DataFrame:
    """Add aoa (1 = outside), di and cutpoint to the test rows; with `return_all` also lpd.

    di is the distance to the nearest training row over the mean training distance, lpd
    the number of training rows whose distance over the mean test distance is below the
    cut. Test rows with a missing feature get nulls. Distance is a Minkowski power `p`, or a
    `metric` by name (neighbours.METRICS). `scan` may name a table with the features of the
    same rows for passes that only add up, where `test` is costly to make again.
    """
    p = distance_of(metric or p)
    scaled = normalised_weights(features, weights)
    names = [f"_w_{f}" for f in features]
    weighted = {n: col(f).cast("double") * F.lit(scaled[f]) for n, f in zip(names, features)}
    if y is not None:
        train = train.where(col(y).isNotNull())
        if drop_zeros:
            train = train.where(col(y) > 0)
    keep = [col(train_id)] + ([col(fold_col)] if fold_col else [])
    train = complete(train, features).select(
        *keep, *[c.alias(n) for n, c in weighted.items()]
    )
    train = stored(train, "train")
    if train.isEmpty():
        raise ValueError("no complete training rows")
    scan = (test if scan is None else scan).withColumns(weighted)
    test = test.withColumns(weighted)
    # one broadcast of the training rows serves every comparison below
    shared = local_base(train, Space(names, p, fold_col or train_id), train_id, None, limit)
    di_train, mean = train_dissimilarity(train, names, train_id, fold_col, p, limit, shared)
    cut = cutpoint(stored(di_train, "di"), "di", threshold, scale, cap)
    space = Space(names, p)
    if shared is not None:
        # one pass adds up the distances, another finds the nearest row and the count within
        radius = -1.0
        if return_all:
            scan = dealt(scan.select(*names), len(shared.value[0]))
            sums = with_summary(scan, shared, space, "_s", wanted=(TOTAL,)).agg(F.sum("_s.total"), F.sum("_s.pairs")).first()
            radius = cut * sums[0] / sums[1]
        test = dealt(test, len(shared.value[0]))
        out = with_summary(test, shared, space, "_s", radius, wanted=(NEAR, WITHIN) if return_all else (NEAR,))
        out = out.withColumn("di", F.col("_s.near") / F.lit(mean))
        out = out.withColumn("aoa", (F.col("di") >= F.lit(cut)).cast("int")).withColumn("cutpoint", F.lit(cut))
        if return_all:
            out = out.withColumn("lpd", F.col("_s.within"))
        return out.drop("_s", *names)
    out = with_neighbours(test, train, space, 1, test_id, train_id, limit=limit, shared=shared)
    di = F.get(F.col("nn.distance"), F.lit(0)) / F.lit(mean)
    out = out.withColumn("di", di).drop("nn")
    out = out.withColumn("aoa", (F.col("di") >= F.lit(cut)).cast("int"))
    out = out.withColumn("cutpoint", F.lit(cut))
    if return_all:
        total, _, pairs = distance_sums(scan, train, space, limit, shared)
        radius = cut * total / pairs
        out = with_count_within(out, train, space, radius, test_id, "lpd", limit, shared)
    return out.drop(*names)
