"""Vertical interpolation and horizontal regridding of rectilinear grids."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridflow.schema import col, keys_of

TOLERANCE = 1e-6


@dataclass(frozen=True)
class Axis:
    """Cell centres start, start + step, ... (n of them)."""

    start: float
    step: float
    n: int

    def index(self, c: Column) -> Column:
        return F.round((c - F.lit(float(self.start))) / F.lit(float(self.step))).cast("int")

    def centre(self, i: Column) -> Column:
        return F.lit(float(self.start)) + i * F.lit(float(self.step))


@dataclass(frozen=True)
class Grid:
    lat: Axis
    lon: Axis


# The 1 degree target grid.
ONE_DEGREE = Grid(Axis(-90.0, 1.0, 180), Axis(-180.0, 1.0, 360))


def interp_depth(df: DataFrame, variable: str, levels: list[float]) -> DataFrame:
    """Linear interpolation of each profile to `levels`, without extrapolation.

    A null at either end of a segment makes the levels inside it null. Before a profile
    is gathered, only the outermost points between two neighbouring levels are kept
    (no other point can bound a level), so a profile of any length shrinks on the map
    side to a few points per level.
    """
    keys = [k for k in keys_of(df) if k != "depth"]
    wanted = F.array(*[F.lit(float(v)) for v in sorted(levels)])
    depth = F.col("depth").cast("double")
    below = F.size(F.filter(wanted, lambda level: level < F.col("depth")))
    gap = below * 2 + F.array_contains(wanted, depth).cast("int")
    ends = (
        df.where(F.col("depth").isNotNull())
        .withColumn("_gap", gap)
        .groupBy(*keys, "_gap")
        .agg(
            F.min(depth).alias("_d0"),
            F.max(depth).alias("_d1"),
            F.min_by(col(variable), depth).alias("_v0"),
            F.max_by(col(variable), depth).alias("_v1"),
        )
    )

    def point(d, v):
        return F.struct(F.col(d).alias("d"), F.col(v).alias("v"))

    points = ends.select(
        *keys, F.inline(F.array_distinct(F.array(point("_d0", "_v0"), point("_d1", "_v1"))))
    )
    profile = Window.partitionBy(*keys).orderBy("d")
    segments = points.select(
        *keys,
        "d",
        "v",
        F.lag("d").over(profile).alias("d0"),
        F.lag("v").over(profile).alias("v0"),
        F.lead("d").over(profile).alias("d2"),
        F.lead("v").over(profile).alias("v2"),
    )
    first = F.col("d0").isNull()
    inside = F.filter(
        wanted,
        lambda level: F.when(first, level == F.col("d")).otherwise(
            (level > F.col("d0")) & (level <= F.col("d"))
        ),
    )
    slope = (F.col("v") - F.col("v0")) / (F.col("d") - F.col("d0"))
    line = F.col("v0") + slope * (F.col("depth") - F.col("d0"))
    # the top point belongs to the segment below it
    top = F.when(F.col("d2").isNull() | F.col("v2").isNotNull(), F.col("v"))
    return segments.withColumn("depth", F.explode(inside)).select(
        *keys, "depth", F.when(first, top).otherwise(line).alias(variable)
    )


def _overlaps(spark: SparkSession, src: Axis, dst: Axis, latitude: bool) -> DataFrame:
    """Overlap of each target cell with each source cell along one axis.

    Columns src, dst, weight, cell (extent of the target cell) and covered (the part of it
    that the source axis covers). Latitude extents are differences of sin(lat), longitude
    extents are radians. At most n_src + n_dst rows plus one per wrap.
    """
    j = F.col("dst")
    half = dst.step / 2.0
    low, high = dst.centre(j) - F.lit(half), dst.centre(j) + F.lit(half)
    if latitude:
        low, high = F.greatest(low, F.lit(-90.0)), F.least(high, F.lit(90.0))
    edge = F.lit(src.start - src.step / 2.0)
    step = F.lit(float(src.step))
    first = F.floor((low - edge) / step)
    last = F.ceil((high - edge) / step) - 1
    pairs = (
        spark.range(dst.n)
        .select(F.col("id").cast("int").alias("dst"))
        .select("dst", low.alias("lo"), high.alias("hi"))
        .withColumn("i", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    )
    left = F.greatest(F.col("lo"), edge + F.col("i") * step)
    right = F.least(F.col("hi"), edge + (F.col("i") + 1) * step)
    if latitude:
        def extent(a, b):
            return F.sin(F.radians(b)) - F.sin(F.radians(a))
        right = F.least(right, F.lit(90.0))
        left = F.greatest(left, F.lit(-90.0))
        index = F.col("i")
    else:
        def extent(a, b):
            return F.radians(b) - F.radians(a)
        index = F.pmod(F.col("i"), F.lit(round(360.0 / src.step)))
    weights = pairs.select(
        index.cast("int").alias("src"),
        "dst",
        extent(left, right).alias("weight"),
        extent(F.col("lo"), F.col("hi")).alias("cell"),
    ).where((F.col("weight") > 0) & F.col("src").between(0, src.n - 1))
    return weights.withColumn("covered", F.sum("weight").over(Window.partitionBy("dst")))


def _spread(
    df: DataFrame, variable: str, src: Grid, lat_w: DataFrame, lon_w: DataFrame
) -> DataFrame:
    """Attach every target cell a source row contributes to.

    The two weight tables are bounded by the axis lengths of the two grids, so they are
    broadcast; the field itself is only shuffled once, already partially aggregated.
    """
    other = [k for k in keys_of(df) if k not in ("lat", "lon")]
    rows = df.select(
        *other,
        src.lat.index(F.col("lat")).alias("_ilat"),
        src.lon.index(F.col("lon")).alias("_ilon"),
        col(variable).alias("_v"),
    )
    lat_w = lat_w.withColumnsRenamed({c: f"lat_{c}" for c in lat_w.columns})
    lon_w = lon_w.withColumnsRenamed({c: f"lon_{c}" for c in lon_w.columns})
    return rows.join(F.broadcast(lat_w), F.col("_ilat") == F.col("lat_src")).join(
        F.broadcast(lon_w), F.col("_ilon") == F.col("lon_src")
    )


def regrid_conservative(
    df: DataFrame,
    variable: str,
    src: Grid,
    dst: Grid = ONE_DEGREE,
    skipna: bool = True,
    na_thres: float = 0.75,
) -> DataFrame:
    """Area-weighted mean of the source cells under each target cell.

    With `skipna` missing source area is left out, and the cell is null when more than
    `na_thres` of it is missing; without it any missing source cell makes it null.
    Absent rows count as missing. Longitude is periodic.
    """
    spark = df.sparkSession
    other = [k for k in keys_of(df) if k not in ("lat", "lon")]
    lat_w = _overlaps(spark, src.lat, dst.lat, latitude=True)
    lon_w = _overlaps(spark, src.lon, dst.lon, latitude=False)
    weight = F.col("lat_weight") * F.col("lon_weight")
    valid = F.when(F.col("_v").isNotNull(), weight)
    cells = (
        _spread(df, variable, src, lat_w, lon_w)
        .groupBy(*other, "lat_dst", "lon_dst")
        .agg(
            F.sum(weight * F.col("_v")).alias("_wv"),
            F.sum(valid).alias("_valid"),
            F.first(F.col("lat_cell") * F.col("lon_cell")).alias("_cell"),
            F.first(F.col("lat_covered") * F.col("lon_covered")).alias("_covered"),
        )
    )
    if skipna:
        missing = 1.0 - F.col("_valid") / F.col("_cell")
        value = F.when(missing <= na_thres + TOLERANCE, F.col("_wv") / F.col("_valid"))
    else:
        whole = F.col("_valid") >= F.col("_covered") * (1.0 - TOLERANCE)
        value = F.when(whole, F.col("_wv") / F.col("_cell"))
    return _on_target(cells, other, dst, value.alias(variable))


def _neighbours(spark: SparkSession, src: Axis, dst: Axis, periodic: bool) -> DataFrame:
    """Linear interpolation weights of the two source centres around each target centre."""
    position = (dst.centre(F.col("dst")) - F.lit(float(src.start))) / F.lit(float(src.step))
    rows = (
        spark.range(dst.n)
        .select(F.col("id").cast("int").alias("dst"))
        .withColumn("_p", F.round(position, 9))
        .withColumn("_low", F.floor("_p").cast("int"))
        .withColumn("_f", F.col("_p") - F.col("_low"))
        .select(
            "dst",
            F.inline(
                F.array(
                    F.struct(F.col("_low").alias("src"), (1.0 - F.col("_f")).alias("weight")),
                    F.struct((F.col("_low") + 1).alias("src"), F.col("_f").alias("weight")),
                )
            ),
        )
    )
    if periodic:
        rows = rows.withColumn("src", F.pmod("src", F.lit(round(360.0 / src.step))))
    return rows.where((F.col("weight") > 0) & F.col("src").between(0, src.n - 1))


def regrid_bilinear(
    df: DataFrame, variable: str, src: Grid, dst: Grid = ONE_DEGREE
) -> DataFrame:
    """Bilinear interpolation to the target centres; null if any needed neighbour is missing."""
    spark = df.sparkSession
    other = [k for k in keys_of(df) if k not in ("lat", "lon")]
    lat_w = _neighbours(spark, src.lat, dst.lat, periodic=False)
    lon_w = _neighbours(spark, src.lon, dst.lon, periodic=True)
    weight = F.col("lat_weight") * F.col("lon_weight")
    cells = (
        _spread(df, variable, src, lat_w, lon_w)
        .groupBy(*other, "lat_dst", "lon_dst")
        .agg(
            F.sum(weight * F.col("_v")).alias("_wv"),
            F.sum(F.when(F.col("_v").isNotNull(), weight)).alias("_valid"),
        )
    )
    value = F.when(F.col("_valid") >= 1.0 - TOLERANCE, F.col("_wv"))
    return _on_target(cells, other, dst, value.alias(variable))


def _on_target(cells: DataFrame, other: list[str], dst: Grid, value: Column) -> DataFrame:
    return cells.select(
        dst.lat.centre(F.col("lat_dst")).alias("lat"),
        dst.lon.centre(F.col("lon_dst")).alias("lon"),
        *other,
        value,
    )


def grid_area(grid: Grid, lat: Column) -> Column:
    """Unit-sphere area of a cell of `grid` centred at `lat`."""
    half = grid.lat.step / 2.0
    low = F.radians(F.greatest(lat - half, F.lit(-90.0)))
    high = F.radians(F.least(lat + half, F.lit(90.0)))
    return (F.sin(high) - F.sin(low)) * F.lit(math.radians(grid.lon.step))
