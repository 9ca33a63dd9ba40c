"""Table writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridflow.schema import col, keys_of

# Metadata of the coordinate columns (CF conventions).
CONVENTIONS = "CF-1.5"
#: Folder of attributes beside a field; readers of the field skip names with an underscore.
ATTRIBUTES = "_attributes"
KEY_METADATA = {
    "lat": {"units": "degrees_north", "long_name": "latitude"},
    "lon": {"units": "degrees_east", "long_name": "longitude"},
    "depth": {"units": "m", "positive": "down"},
    "time": {"units": "months"},
}


def with_metadata(
    df: DataFrame,
    variables: dict[str, dict] = {},
    author: str | None = None,
    description: str | None = None,
) -> DataFrame:
    """Attach coordinate, variable and table attributes as column metadata."""
    table = {"Conventions": CONVENTIONS}
    if author is not None:
        table["creator_name"] = author
    if description is not None:
        table["description"] = description
    attributes = {k: dict(KEY_METADATA[k]) for k in keys_of(df)}
    for name, values in variables.items():
        attributes.setdefault(name, {}).update(values)
    # table-wide attributes ride on the first column
    attributes.setdefault(df.columns[0], {}).update({"table": table})
    return df.select(
        *[
            col(c).alias(c, metadata=attributes[c]) if c in attributes else col(c)
            for c in df.columns
        ]
    )


def write_field(
    df: DataFrame,
    path: str,
    variables: dict[str, dict] = {},
    author: str | None = None,
    description: str | None = None,
    partition_by: list[str] | None = None,
) -> None:
    """Parquet with the attributes kept in the file schema, one folder per time step."""
    if partition_by is None:
        partition_by = [c for c in ("target", "time") if c in df.columns]
    described = with_metadata(df, variables, author, description)
    described.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    # columns that become folders are in no file: their attributes stand beside the data
    attributes = {f.name: f.metadata for f in described.schema.fields if f.metadata}
    rows = df.sparkSession.createDataFrame([(json.dumps(attributes, sort_keys=True),)], "value string")
    rows.coalesce(1).write.mode("overwrite").text(f"{path}/{ATTRIBUTES}")


def read_attributes(spark: SparkSession, path: str) -> dict[str, dict]:
    """Attributes of all columns of a written field, those of its folders included."""
    return json.loads(spark.read.text(f"{path}/{ATTRIBUTES}").first()[0])


def write_applicability(df: DataFrame, path: str) -> None:
    write_field(df, path, description="area of applicability")


def write_predictions(df: DataFrame, path: str, files_per_target: int | None = None) -> None:
    """Write into the predictions table, partitioned by model, target and part.

    A rerun replaces the models, targets and parts that it writes and leaves the others. With several targets in one frame, `files_per_target` gathers each target's rows
    into that many files; the hashed file number splits a large target over tasks.
    """
    parts = [c for c in ("model", "target", "part") if c in df.columns]
    if files_per_target:
        number = F.pmod(F.xxhash64(*keys_of(df)), F.lit(files_per_target))
        df = df.repartition(*parts, number)
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*parts).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """One small CSV file: rows per target and model, never per cell."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
