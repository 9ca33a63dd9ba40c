"""Key columns, explicit table schemas and NaN handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

KEYS = ["lat", "lon", "depth", "time"]

KEY_TYPES = {
    "lat": T.DoubleType(),
    "lon": T.DoubleType(),
    "depth": T.DoubleType(),
    "time": T.IntegerType(),
}


def col(name: str) -> Column:
    """A column by its exact name; target names may hold spaces and dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def keys_of(df: DataFrame) -> list[str]:
    """The coordinate columns that are present, in canonical order."""
    return [k for k in KEYS if k in df.columns]


def require(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; table has {df.columns}")


def numeric_columns(df: DataFrame, exclude: list[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def complete(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows without a null in `names`.

    One conjunct per column: each is pushed to the scan, and the optimizer's inferred
    constraints stay linear in the number of columns (they do not for `na.drop`).
    """
    for n in df.columns if names is None else names:
        df = df.where(col(n).isNotNull())
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark aggregates propagate NaN, whereas a missing observation must be skipped."""
    floating = (T.FloatType, T.DoubleType)
    return df.select(
        *[
            F.nanvl(col(f.name), F.lit(None)).cast(f.dataType).alias(f.name)
            if isinstance(f.dataType, floating)
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def grid_schema(variables: list[str], keys: list[str] = KEYS) -> T.StructType:
    """Schema of a long grid table: key columns, then one double per variable."""
    fields = [T.StructField(k, KEY_TYPES[k]) for k in keys]
    return T.StructType(fields + [T.StructField(v, T.DoubleType()) for v in variables])
