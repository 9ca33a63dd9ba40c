"""Table readers. Every reader takes an explicit schema or column list and maps NaN to null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridflow.operators.community import to_wide
from gridflow.schema import KEY_TYPES, KEYS, col, complete, nan_to_null, require

PREDICTION_STATISTICS = ["mean", "ci95_LL", "ci95_UL"]


def read_observations(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    skip_header: bool = True,
    by_name: bool = False,
) -> DataFrame:
    """Observations CSV.

    By default the file's header row is skipped and the schema's names are used by
    position; with `by_name` the header has to agree with the schema.
    """
    reader = spark.read.schema(schema).option("header", skip_header)
    reader = reader.option("enforceSchema", not by_name)
    return nan_to_null(reader.option("nanValue", "NaN").csv(path))


def read_table(
    spark: SparkSession, path: str, columns: list[str], types: dict[str, T.DataType] = {}, format: str | None = None
) -> DataFrame:
    """Parquet, or CSV with a header, reduced to `columns` (so only those are scanned).

    `format` is parquet or csv; without it a path that ends in .csv is CSV and others are
    Parquet. CSV columns get the given types, those of the keys, or double.
    """
    format = format or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    if format not in ("csv", "parquet"):
        raise ValueError(f"unknown format {format!r}; use csv or parquet")
    if format == "parquet":
        df = spark.read.parquet(path)
        require(df, columns)
        return df.select(*[col(c) for c in columns])
    # the header gives the place of each column, the types make the schema explicit
    names = spark.read.option("header", True).csv(path).columns
    schema = T.StructType(
        [T.StructField(n, types.get(n, KEY_TYPES.get(n, T.DoubleType())) if n in columns else T.StringType()) for n in names]
    )
    df = spark.read.schema(schema).option("header", True).option("nanValue", "NaN").csv(path)
    require(df, columns)
    return df.select(*[col(c) for c in columns])


def read_env(
    spark: SparkSession,
    path: str,
    variables: list[str],
    keys: list[str] = KEYS,
    types: dict[str, T.DataType] = {},
    format: str | None = None,
) -> DataFrame:
    """Environment grid as a long table: key columns and the wanted variables."""
    return nan_to_null(read_table(spark, path, [*keys, *variables], types, format))


def read_traits(spark: SparkSession, path: str, traits: list[str], format: str | None = None) -> DataFrame:
    """Trait table: `Target` and one double per trait."""
    return read_table(spark, path, ["Target", *traits], {"Target": T.StringType()}, format)


def read_monthly(
    spark: SparkSession,
    paths_by_month: dict[int, str],
    variable: str,
    keys: list[str] = ["lat", "lon", "depth"],
) -> DataFrame:
    """Union of one grid file per month, each tagged with its month."""
    months = [
        read_env(spark, path, [variable], keys).withColumn("time", F.lit(int(month)))
        for month, path in sorted(paths_by_month.items())
    ]
    out = months[0]
    for month in months[1:]:
        out = out.unionByName(month)
    return out


def select_statistic(predictions: DataFrame, model: str, statistic: str) -> DataFrame:
    """One model's final predictions, one statistic, in long form (keys, target, value)."""
    if statistic not in PREDICTION_STATISTICS:
        raise ValueError(f"unknown statistic {statistic!r}; use one of {PREDICTION_STATISTICS}")
    rows = predictions.where(F.col("model") == model)
    if "part" in predictions.columns:
        rows = rows.where(~F.col("part").isin("clf", "reg"))
    keys = [k for k in KEYS if k in predictions.columns]
    return rows.select(*keys, "target", col(statistic).alias("value"))


def load_fields(
    spark: SparkSession, path: str, model: str, statistic: str, targets: list[str]
) -> DataFrame:
    """All targets' fields of one model side by side, complete rows only.

    The filters on `model` and `part` prune partition folders; only the wanted
    statistic column is read.
    """
    rows = select_statistic(spark.read.parquet(path), model, statistic)
    return complete(to_wide(rows, targets))
