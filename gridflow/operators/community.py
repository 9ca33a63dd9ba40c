"""Reshaping between long and wide target tables, and community metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridflow.functions import rows
from gridflow.schema import col, keys_of

RESAMPLE_COLUMNS = ["mean", "stdev", "prctile_2.5", "prctile_97.5"]


def targets_of(df: DataFrame) -> DataFrame:
    """Distinct target names in order."""
    return df.select("target").distinct().orderBy("target")


def to_wide(
    df: DataFrame, targets: list[str], keys: list[str] | None = None, value: str = "value"
) -> DataFrame:
    """One column per target. The target list is given, so no job looks for it.

    Conditional aggregates need a single shuffle with map-side combine.
    """
    keys = keys or keys_of(df)
    columns = [F.max(F.when(F.col("target") == t, col(value))).alias(t) for t in targets]
    return df.where(F.col("target").isin(targets)).groupBy(*keys).agg(*columns)


def to_long(df: DataFrame, targets: list[str], keys: list[str] | None = None) -> DataFrame:
    """One row per key and target, nulls included."""
    keys = keys or keys_of(df)
    return df.unpivot([col(k) for k in keys], [col(t) for t in targets], "target", "value")


def trait_values(traits: DataFrame, targets: list[str], variable: str) -> dict[str, float]:
    """Trait value per target, by name: one row per listed target reaches the driver.

    A target without a value, or with more than one row, is an error.
    """
    wanted = traits.where(F.col("Target").isin(targets))
    found = wanted.groupBy("Target").agg(F.count("*").alias("n"), F.max(col(variable)).alias("v")).collect()
    repeated = sorted(r["Target"] for r in found if r["n"] > 1)
    if repeated:
        raise ValueError(f"more than one {variable!r} for targets {repeated}")
    values = {r["Target"]: r["v"] for r in found}
    missing = [t for t in targets if values.get(t) is None]
    if missing:
        raise ValueError(f"no {variable!r} for targets {missing}")
    return values


def scale_by_trait(
    df: DataFrame, traits: DataFrame, variable: str, targets: list[str]
) -> DataFrame:
    """Each target multiplied by its trait; only keys and targets remain."""
    values = trait_values(traits, targets, variable)
    return df.select(
        *keys_of(df), *[(col(t) * F.lit(float(values[t]))).alias(t) for t in targets]
    )


def scale_by_trait_long(df: DataFrame, traits: DataFrame, variable: str) -> DataFrame:
    """Long form of the same: joins the trait table by target name.

    A target of `df` without a trait, or with several, stops the job with an error, as in
    the wide form; no row is dropped or repeated. Traits are one row per target after the
    aggregation, so its size, not the size of `df`, decides the kind of join.
    """
    trait = traits.groupBy(F.col("Target").alias("target")).agg(
        F.max(col(variable)).alias("_trait"), F.count("*").alias("_traits")
    )
    joined = df.join(trait, "target", "left")
    problem = F.concat(
        F.when(F.col("_traits") > 1, F.lit("more than one ")).otherwise(F.lit("no ")),
        F.lit(f"{variable!r} for target "), F.coalesce(F.col("target"), F.lit("null")),
    )
    bad = F.col("_trait").isNull() | (F.col("_traits") > 1)
    value = F.when(bad, F.raise_error(problem).cast("double")).otherwise(F.col("value") * F.col("_trait"))
    return joined.withColumn("value", value).drop("_trait", "_traits")


def sum_groups(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Add one column per group: the sum of its targets, null only if all are null."""
    groups: dict[str, list[str]] = {}
    for target, group in mapping.items():
        groups.setdefault(group, []).append(target)
    clash = [g for g in groups if g in df.columns]
    if clash:
        raise ValueError(f"group names already in use: {clash}")
    return df.withColumns({g: rows.sum_or_null([col(t) for t in ts]) for g, ts in groups.items()})


def cwm(df: DataFrame, traits: DataFrame, variable: str, targets: list[str]) -> DataFrame:
    """Add the community-weighted mean of a trait as column `cwm <variable>`."""
    values = trait_values(traits, targets, variable)
    pairs = [(col(t), values[t]) for t in targets]
    return df.withColumn(f"cwm {variable}", rows.weighted_mean(pairs))


def diversity(df: DataFrame, targets: list[str], base: float | None = None) -> DataFrame:
    return df.withColumn("shannon", rows.shannon([col(t) for t in targets], base))


def total(df: DataFrame, targets: list[str]) -> DataFrame:
    value, log = rows.total_and_log([col(t) for t in targets])
    return df.withColumns({"total": value, "total_log": log})


def resample_stats(df: DataFrame, targets: list[str]) -> DataFrame:
    """Mean, sample sd and 2.5 / 97.5 percentiles across the target columns of a row."""
    values = F.array(*[col(t).cast("double") for t in targets])
    low, high = rows.row_quantiles(values, [0.025, 0.975])
    stats = [rows.row_mean(values), rows.row_stddev(values), low, high]
    return df.withColumns(dict(zip(RESAMPLE_COLUMNS, stats)))


def resample_stats_long(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The same over long rows (keys, target, value): one row per key."""
    keys = keys or keys_of(df)
    quantiles = F.percentile("value", [0.025, 0.975])
    stats = df.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("stdev"), quantiles.alias("_q")
    )
    return stats.select(
        *keys,
        "mean",
        "stdev",
        F.get("_q", F.lit(0)).alias("prctile_2.5"),
        F.get("_q", F.lit(1)).alias("prctile_97.5"),
    )
