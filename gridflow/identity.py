"""Row numbers that hold whenever a table is read again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridflow.session import stored

#: Most files of a table whose numbers are sent to every task.
MOST_FILES = 200_000
#: Row numbers leave so many bits to the place in the file.
FILE_SHIFT = 33


def scans_files(df: DataFrame) -> bool:
    """True when `df` is a file table, filtered or projected, and nothing else: each row is a row of one file."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    return plan.nodeName() == "LogicalRelation" and "_metadata" not in df.columns


def numbered_by_file(df: DataFrame, name: str) -> DataFrame | None:
    """`df` with a row number `name` made of file and place in the file; None where rows of files can't be told.

    Files are numbered by path, so the numbers don't depend on how files are cut into tasks,
    and nothing is written. A row's place is known for Parquet only.
    """
    if not scans_files(df):
        return None
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias(name))
        paths = sorted(r._file for r in placed.select("_file").distinct().limit(MOST_FILES + 1).collect())
    except AnalysisException:
        return None
    if len(paths) > MOST_FILES:
        return None
    files = df.sparkSession.createDataFrame([(p, k << FILE_SHIFT) for k, p in enumerate(paths)], "_file string, _first bigint")
    joined = placed.join(F.broadcast(files), "_file")
    return joined.withColumn(name, F.col("_first") + F.col(name)).drop("_file", "_first")


def with_row_number(df: DataFrame, name: str) -> DataFrame:
    """`df` with a row number `name` that every reading gives again: of its files, or else written down."""
    found = numbered_by_file(df, name)
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "rows") if found is None else found
