"""Cleaning, filtering, gridding and gap filling of observations and environment grids."""

from __future__ import annotations

from functools import reduce

import math

from pyspark.sql import Column, DataFrame, functions as F

from gridflow.functions.columns import presence, standard_error
from gridflow.operators.sampling import with_index
from gridflow.schema import col, complete, keys_of, numeric_columns, require
from gridflow.session import stored


def select_predictors(df: DataFrame, predictors: list[str]) -> DataFrame:
    require(df, predictors)
    return df.select(*keys_of(df), *[col(p) for p in predictors])


def drop_missing(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return complete(df, subset)


def exclude(df: DataFrame, name: str, values: list) -> DataFrame:
    """Drop rows whose category is listed; a null category is kept."""
    return df.where(F.coalesce(~col(name).isin(values), F.lit(True)))


def drop_ratio_above(df: DataFrame, num: Column, den: Column, limit: float) -> DataFrame:
    """Drop rows where num / den exceeds `limit`; a null denominator keeps the row.

    The product form holds for den >= 0 and drops num > 0 over den = 0 (infinite ratio).
    """
    too_high = den.isNotNull() & (num > F.lit(float(limit)) * den)
    return df.where(~F.coalesce(too_high, F.lit(False)))


def at_most(df: DataFrame, name: str, limit: float) -> DataFrame:
    return df.where(col(name) <= F.lit(limit))


def keep_present(df: DataFrame, y: str) -> DataFrame:
    return df.where(presence(col(y)))


def subset_depth(df: DataFrame, depth: float) -> DataFrame:
    """Rows from the surface to `depth`, both inclusive."""
    return df.where(F.col("depth").between(0, depth))


def normalise_coords(df: DataFrame, names: dict[str, str], drop: list[str] = ()) -> DataFrame:
    return df.drop(*drop).withColumnsRenamed(names)


def mask_incomplete(df: DataFrame, variables: list[str]) -> DataFrame:
    """Set every variable to null in rows where any of them is null."""
    complete = reduce(lambda a, b: a & b, [col(v).isNotNull() for v in variables])
    return df.withColumns({v: F.when(complete, col(v)) for v in variables})


def replicate_depth(df: DataFrame, levels: list[float]) -> DataFrame:
    """Repeat a horizontal field at every depth level."""
    values = F.array(*[F.lit(float(v)) for v in levels])
    return df.withColumn("depth", F.explode(values))


def grid_mean(df: DataFrame, keys: list[str], variables: list[str] | None = None) -> DataFrame:
    """Mean of every numeric column per cell; rows with a null key belong to no cell."""
    variables = variables or numeric_columns(df, exclude=keys)
    return (
        complete(df, keys)
        .groupBy(*keys)
        .agg(*[F.avg(col(v)).alias(v) for v in variables])
    )


def mean_over(df: DataFrame, dims: list[str], variables: list[str]) -> DataFrame:
    """Mean of the field over some of its dimensions."""
    keep = [k for k in keys_of(df) if k not in dims]
    return df.groupBy(*keep).agg(*[F.avg(col(v)).alias(v) for v in variables])


def field_sum(df: DataFrame, variables: list[str]) -> DataFrame:
    return df.agg(*[F.sum(col(v)).alias(v) for v in variables])


def count_valid(df: DataFrame, variables: list[str], by: list[str] = ()) -> DataFrame:
    """Non-null and non-null, non-zero counts per variable."""
    aggs = []
    for v in variables:
        aggs.append(F.count(col(v)).alias(f"{v}_valid"))
        aggs.append(F.count_if(col(v) != 0).alias(f"{v}_nonzero"))
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def with_group_stat(df: DataFrame, by: list[str], stats: dict[str, Column]) -> DataFrame:
    """Attach a group aggregate to each row.

    Aggregating first keeps the shuffle to one row per group and map task. The aggregate
    is written down, so the planner knows its true size: while it is small the join is a
    broadcast, and a group holding much of the table never lands in one task; a large one
    is joined by sorting, with skewed partitions split at run time.
    """
    grouped = stored(df.groupBy(*by).agg(*[c.alias(n) for n, c in stats.items()]), "stats")
    renamed = grouped.withColumnsRenamed({b: f"_g_{b}" for b in by})
    same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(col(f"_g_{k}")) for k in by])
    return df.join(renamed, same, "left").drop(*[f"_g_{b}" for b in by])


def impute_sd(df: DataFrame, value: str, sd: str, region: str) -> DataFrame:
    """Fill missing standard deviations from the region's mean coefficient of variation.

    A region without any coefficient, and rows without a region, use the global mean.
    """
    cv = F.try_divide(col(sd), F.nullif(col(value), F.lit(0.0)))
    sums = df.groupBy(col(region).alias("_region")).agg(
        F.sum(cv).alias("_sum"), F.count(cv).alias("_count")
    )
    # as in with_group_stat: its size on disk decides how it is joined; the global mean
    # comes from the same few rows
    sums = stored(sums, "stats")
    count = F.nullif(F.sum("_count"), F.lit(0))
    overall = sums.agg(F.try_divide(F.sum("_sum"), count)).scalar()
    share = F.try_divide(F.col("_sum"), F.nullif(F.col("_count"), F.lit(0)))
    stats = sums.select("_region", share.alias("_region_cv"))
    joined = df.join(stats, col(region) == F.col("_region"), "left")
    filled = F.coalesce(col(sd), col(value) * F.coalesce(F.col("_region_cv"), overall))
    return joined.withColumn(sd, filled).drop("_region", "_region_cv")


def with_standard_error(df: DataFrame, sd: str, n: int, out: str) -> DataFrame:
    return df.withColumn(out, standard_error(col(sd), n))


def fill_seasonal_gaps(
    df: DataFrame, variable: str, periods: int = 12, frac: float = 0.1
) -> DataFrame:
    """Fill missing months of a cell with the smaller of its minimum and frac * maximum.

    One aggregation lays the months of a cell side by side, which also adds the months
    that have no row; a cell that is empty all year stays null.
    """
    cell = [k for k in keys_of(df) if k != "time"]
    months = [
        F.max(F.when(F.col("time") == m, col(variable))).alias(f"_m{m}")
        for m in range(1, periods + 1)
    ]
    wide = df.groupBy(*cell).agg(*months)
    values = [F.col(f"_m{m}") for m in range(1, periods + 1)]
    high, low = F.greatest(*values), F.least(*values)
    fill = F.least(F.lit(float(frac)) * high, low)
    filled = F.array(*[F.coalesce(v, fill) for v in values])
    return wide.select(*cell, F.posexplode(filled).alias("_i", variable)).select(
        *cell, (F.col("_i") + 1).alias("time"), col(variable)
    )


def densify(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every combination of the key values that occur; absent cells are null.

    The distinct values of each numeric coordinate are numbered in order; cells are numbered
    by a range that Spark splits over tasks, and each part of a cell's number fetches the
    value of its axis by a join. Only the lengths of the axes reach the driver.
    """
    keys = keys or keys_of(df)
    axes = [stored(with_index(df.select(col(k)).dropna().distinct(), k), "axis") for k in keys]
    sizes = [axis.count() for axis in axes]
    cells, below = df.sparkSession.range(math.prod(sizes)), 1
    for i, size in enumerate(sizes):
        cells = cells.withColumn(f"_i{i}", F.floor(F.col("id") / F.lit(below)) % F.lit(max(1, size)))
        below *= size
    for i, (k, axis) in enumerate(zip(keys, axes)):
        cells = cells.join(axis.select(F.col("idx").alias(f"_i{i}"), col(k)), f"_i{i}")
    return cells.select(*[col(k) for k in keys]).join(df, keys, "left")
