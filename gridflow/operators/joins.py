"""Joins on the grid coordinates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gridflow.functions.columns import sentinel_to_null
from gridflow.operators.prepare import grid_mean
from gridflow.schema import KEYS, col, complete

WORD_BITS = 60


def join_obs_env(
    obs: DataFrame, env: DataFrame, env_vars: list[str], on: list[str] = KEYS
) -> DataFrame:
    """Mean observation per cell with the environment of that cell attached.

    The aggregation leaves the rows partitioned by `on`, which the join reuses.
    """
    cells = grid_mean(obs, on)
    return cells.join(env.select(*on, *[col(v) for v in env_vars]), on, "left")


def join_env(
    pred: DataFrame, env: DataFrame, on: list[str] = KEYS, text: list[str] = ("FID",)
) -> DataFrame:
    """Predictions with their environment, complete rows only; '' counts as missing."""
    for name in text:
        if name in env.columns:
            env = env.withColumn(name, sentinel_to_null(col(name), ""))
    return complete(pred.join(env, on, "inner"))


def align_env(frames: dict[str, DataFrame], on: list[str] = KEYS) -> DataFrame:
    """Cells present in every one of several single-variable grids, side by side.

    One union and one aggregation instead of a chain of joins. A cell counts as present
    when the grid has a row for it, even if its value is null.
    """
    names = list(frames)
    union = reduce(
        lambda a, b: a.unionByName(b),
        [
            df.select(
                *on,
                F.lit(i).alias("_grid"),
                F.lit(1 << i % WORD_BITS).cast("long").alias("_bit"),
                col(n).cast("double").alias("_value"),
            )
            for i, (n, df) in enumerate(frames.items())
        ],
    )
    # one bit per grid, in as many words as there are grids for
    words = range(0, len(names), WORD_BITS)
    in_word = [F.col("_grid").between(w, w + WORD_BITS - 1) for w in words]
    present = [F.bit_or(F.when(c, F.col("_bit"))).alias(f"_present_{w}") for w, c in zip(words, in_word)]
    columns = [
        F.max(F.when(F.col("_grid") == i, F.col("_value"))).alias(n) for i, n in enumerate(names)
    ]
    cells = union.groupBy(*on).agg(*present, *columns)
    for w in words:
        cells = cells.where(F.col(f"_present_{w}") == (1 << min(WORD_BITS, len(names) - w)) - 1)
    return cells.drop(*[f"_present_{w}" for w in words])


def residuals(
    pred: DataFrame, obs: DataFrame, targets: list[str], on: list[str] = KEYS
) -> DataFrame:
    """Observed value, modelled value (`_mod`) and residual (`_resid`) per observation."""
    modelled = pred.select(*on, *[col(t).alias(f"{t}_mod") for t in targets])
    joined = obs.select(*on, *[col(t) for t in targets]).join(modelled, on, "left")
    return joined.select(
        *on,
        *[col(t) for t in targets],
        *[col(f"{t}_mod") for t in targets],
        *[(col(t) - col(f"{t}_mod")).alias(f"{t}_resid") for t in targets],
    )
