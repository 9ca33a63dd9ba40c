"""From raw observations and source grids to training and prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridflow.functions.columns import band_difference, bin_coordinates, month_of
from gridflow.operators import joins, prepare, regrid, sampling
from gridflow.schema import KEYS, col, complete
from gridflow.session import stored


def resampled_observations(
    raw: DataFrame,
    value: str,
    sd: str,
    region: str,
    date_format: str = "dd/MM/yyyy",
    exclude_methods: Sequence[str] = (),
    ratio: tuple[str, float] | None = None,
    upper: float | None = None,
    n_measured: int = 3,
    resamples: int = 50,
    seed: int = 0,
) -> DataFrame:
    """Quality control, missing deviations, parametric resampling and gridding.

    `raw` has Latitude, Longitude, Depth, Date, Method, the value, its deviation and a
    region. Returns the mean of the value and of every resample per grid cell and month.
    """
    rows = prepare.exclude(raw, "Method", list(exclude_methods)) if exclude_methods else raw
    if ratio:
        rows = prepare.drop_ratio_above(rows, col(value), col(ratio[0]), ratio[1])
    if upper is not None:
        rows = prepare.at_most(rows, value, upper)
    rows = prepare.impute_sd(rows, value, sd, region)
    rows = prepare.with_standard_error(rows, sd, n_measured, "_se")
    rows = rows.withColumn("time", month_of(F.col("Date"), date_format))
    rows = rows.select("Latitude", "Longitude", "Depth", "time", col(value), "_se", col(region))
    rows = complete(rows).drop(region)
    # every observation needs its own draws, also when two of them agree in all columns
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "observations")
    drawn = sampling.resample_normal(rows, value, "_se", resamples, seed, ["_row"])
    bins = bin_coordinates(F.col("Latitude"), F.col("Longitude"), F.col("Depth"))
    samples = [f"sample_{i}" for i in range(1, resamples + 1)]
    return prepare.grid_mean(drawn.withColumns(bins), KEYS, [value, *samples])


def training_table(
    gridded: DataFrame, env: DataFrame, env_vars: list[str], mask: DataFrame | None = None,
    seed: int = 42,
) -> DataFrame:
    """Gridded observations, optional pseudo-absences (one per observation), environment."""
    targets = [c for c in gridded.columns if c not in KEYS]
    rows = gridded
    if mask is not None:
        n = gridded.agg(F.count(col(targets[0]))).scalar()
        rows = sampling.add_pseudo_zeros(gridded, mask, n, targets, seed)
    joined = rows.join(env.select(*KEYS, *[col(v) for v in env_vars]), KEYS, "left")
    return complete(joined)


def nutrient_field(
    source: DataFrame, variable: str, grid: regrid.Grid, levels: list[float],
    max_depth: float = 200.0, zero_is_missing: bool = False,
) -> DataFrame:
    """Profiles to standard depths, then the area-weighted 1 degree field."""
    shallow = prepare.at_most(source, "depth", max_depth)
    profiles = regrid.interp_depth(shallow, variable, levels)
    field = regrid.regrid_conservative(profiles, variable, grid, skipna=True, na_thres=0.75)
    if zero_is_missing:
        field = field.withColumn(variable, F.nullif(col(variable), F.lit(0.0)))
    return field


def surface_field(
    source: DataFrame, variable: str, grid: regrid.Grid, levels: list[float],
    method: str = "bilinear", fill_gaps: bool = False,
) -> DataFrame:
    """A horizontal field on the 1 degree grid, repeated at every depth level.

    Gaps of the yearly cycle are filled before the field is repeated: the fill is the same
    at every depth, so it is worked out once per column.
    """
    if method == "bilinear":
        field = regrid.regrid_bilinear(source, variable, grid)
    else:
        field = regrid.regrid_conservative(source, variable, grid, skipna=False)
    if fill_gaps:
        field = prepare.fill_seasonal_gaps(field, variable)
    return prepare.replicate_depth(field, levels)


def environment_table(
    fields: dict[str, DataFrame], bands: tuple[str, str, str] | None = None
) -> DataFrame:
    """All variables side by side where every grid has the cell and no value is missing.

    `bands` (a, b, index) replaces two bands by their difference.
    """
    table = joins.align_env(fields)
    if bands:
        a, b, index = bands
        table = table.withColumn(index, band_difference(col(a), col(b))).drop(a, b)
    variables = [c for c in table.columns if c not in KEYS]
    return complete(prepare.mask_incomplete(table, variables))
