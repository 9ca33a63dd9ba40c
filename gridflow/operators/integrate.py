"""Cell volumes and volume-weighted totals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from gridflow.functions.columns import days_in_month
from gridflow.operators.community import RESAMPLE_COLUMNS
from gridflow.operators.prepare import subset_depth as to_depth
from gridflow.schema import col, keys_of, require

# Fixed value: mean radius of the Earth in metres.
EARTH_RADIUS = 6371000.0


def volume(keys: list[str], dlat: float = 1.0, dlon: float = 1.0, depth_w: float = 5.0) -> Column:
    """Cell volume from whichever coordinates exist.

    lat and lon: spherical cell area; lat alone: the whole zonal band; no lat: 1.
    A depth coordinate multiplies by the bin depth.
    """
    out = F.lit(1.0)
    if "lat" in keys:
        half = math.radians(dlat) / 2.0
        phi = F.radians(F.col("lat"))
        band = F.lit(EARTH_RADIUS**2) * (F.sin(phi + F.lit(half)) - F.sin(phi - F.lit(half)))
        out = band * F.lit(math.radians(dlon) if "lon" in keys else 2.0 * math.pi)
    if "depth" in keys:
        out = out * F.lit(float(depth_w))
    return out


def with_volume(
    df: DataFrame, dlat: float = 1.0, dlon: float = 1.0, depth_w: float = 5.0
) -> DataFrame:
    return df.withColumn("volume", volume(keys_of(df), dlat, dlon, depth_w))


def _month(df: DataFrame) -> Column:
    kind = dict(df.dtypes)["time"]
    return F.month("time") if kind.startswith(("date", "timestamp")) else F.col("time")


def integrate_totals(
    df: DataFrame,
    variables: list[str] | None = None,
    monthly: bool = False,
    subset_depth: float | None = None,
    rate: bool = False,
    dlat: float = 1.0,
    dlon: float = 1.0,
    depth_w: float = 5.0,
    molar_mass: float = 1.0,
    vol_conversion: float = 1.0,
    magnitude_conversion: float = 1.0,
    time_reduce: str = "sum",
) -> DataFrame:
    """Rows (variable, [time,] total) for all variables in one aggregation.

    `rate` weights each time step by the days of its month. With `time_reduce='mean'` the
    sum over time becomes the mean over the time steps that occur.
    """
    keys = keys_of(df)
    has_time = "time" in keys
    if variables is None:
        variables = [c for c in df.columns if c not in (*keys, "volume")]
    require(df, variables)
    if subset_depth is not None and "depth" in keys:
        df = to_depth(df, subset_depth)
    weight = col("volume") if "volume" in df.columns else volume(keys, dlat, dlon, depth_w)
    if rate and has_time:
        weight = weight * days_in_month(_month(df))
    scale = F.lit(float(molar_mass)) * F.lit(float(vol_conversion)) * F.lit(
        float(magnitude_conversion)
    )
    steps = F.lit(1)
    if time_reduce == "mean" and has_time and not monthly:
        steps = F.count_distinct("time")
    elif time_reduce not in ("sum", "mean"):
        raise ValueError("time_reduce is 'sum' or 'mean'")
    # an all-null field sums to zero
    sums = [
        (F.coalesce(F.sum(col(v) * F.col("_weight")), F.lit(0.0)) * scale / steps).alias(v)
        for v in variables
    ]
    by = ["time"] if monthly and has_time else []
    weighted = df.select(*by, *(["time"] if has_time and not by else []),
                         *[col(v) for v in variables], weight.alias("_weight"))
    totals = weighted.groupBy(*by).agg(*sums) if by else weighted.agg(*sums)
    return totals.unpivot(by, [col(v) for v in variables], "variable", "total")


def integrate_total(df: DataFrame, variable: str = "total", **options) -> DataFrame:
    return integrate_totals(df, [variable], **options)


def integrated_totals(df: DataFrame, targets: list[str], **options) -> tuple[DataFrame, list[str]]:
    """Totals of the targets and of the summary columns present, and the missing targets."""
    wanted = [*targets, "total", *RESAMPLE_COLUMNS]
    found = [v for v in dict.fromkeys(wanted) if v in df.columns]
    missing = [t for t in targets if t not in df.columns]
    return integrate_totals(df, found, **options), missing
