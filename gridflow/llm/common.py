"""Shared helpers: row numbers, running sums and joins that stand hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridflow.identity import with_row_number
from gridflow.session import stored  # noqa: F401  (re-exported for the operators)

BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 1024
SUPER = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, uid: str | None = None) -> DataFrame:
    """`df` with a row number `_uid`: the column `uid`, or else numbers made as the table is read.

    Numbers that are made hold for one reading only, as the cut of files into partitions may
    change with the cluster. Whoever reads again writes them down first (see `pinned`).
    """
    return df.withColumn("_uid", F.col(uid) if uid else F.monotonically_increasing_id())


def pinned(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """`df` with row numbers `_uid` that hold, its columns as _c0, _c1, ..., and those under their names.

    Whatever names the caller's columns have, they don't meet those of an operator. Rows of
    files are known by their places; other rows are written down.
    """
    frame = df.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(df.columns)])
    return with_row_number(frame, "_uid"), [F.col(f"_c{k}").alias(c) for k, c in enumerate(df.columns)]


def place_of(df: DataFrame, *columns: str) -> list[str]:
    """Names of columns in the frame that `pinned` makes."""
    return [f"_c{df.columns.index(c)}" for c in columns]


def run_of(uid: Column) -> Column:
    """The input partition, or the file, a row number was made in."""
    return F.shiftright(uid, 33).cast("int")


def bucket_bits(rows: int) -> int:
    """Bits of a hash that cut `rows` into buckets of about BUCKET_ROWS."""
    return max(0, (max(1, rows) // BUCKET_ROWS).bit_length())


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], salt: Column, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """Join `left` to `right`, unique in `keys`, where one key may hold most rows of `left`.

    The distinct (keys, salt) of `left` fetch the row of `right` once each; the rows of
    `left` then meet them on keys and salt, so a hot key is spread over all salts. `strategy`
    is a join hint for both joins; without, Spark chooses.
    """
    salted, planned = left.withColumn("_salt", salt), lambda df: df.hint(strategy) if strategy else df
    bridge = salted.select(*keys, "_salt").distinct().join(planned(right), keys)
    return salted.join(planned(bridge), [*keys, "_salt"], how).drop("_salt")


def ahead(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def running(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Sum of `value` over all earlier rows of the group, by `bucket`, then `order`.

    A group may hold any share of the rows: windows see one bucket, or the sums of SUPER
    buckets, or the sums of those. `group` and `bucket` columns must not be null.
    """
    valued = df.withColumn("_value", value.cast("bigint"))
    part = F.floor(F.col(bucket) / SUPER).cast("bigint")
    sums = valued.groupBy(*group, bucket).agg(F.sum("_value").alias("_sum")).withColumn("_super", part)
    tops = sums.groupBy(*group, "_super").agg(F.sum("_sum").alias("_top"))
    tops = tops.select(
        *group, "_super", F.coalesce(F.sum("_top").over(ahead(group, ["_super"])), F.lit(0)).alias("_base")
    )
    sums = sums.withColumn("_inner", F.coalesce(F.sum("_sum").over(ahead([*group, "_super"], [bucket])), F.lit(0)))
    sums = sums.join(tops, [*group, "_super"]).select(*group, bucket, (F.col("_inner") + F.col("_base")).alias("_offset"))
    inner = F.coalesce(F.sum("_value").over(ahead([*group, bucket], order)), F.lit(0))
    placed = valued.withColumn("_within", inner).join(sums, [*group, bucket])
    return placed.withColumn(out, F.col("_within") + F.col("_offset")).drop("_value", "_within", "_offset")


def in_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """`df` with `_place`, the number of rows before each in `order`, counted from 0.

    The rows are range-sorted once and written with their place in their range; a row a range,
    as many as shuffle partitions, then says how many rows lie in the ranges before.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("_inner", F.monotonically_increasing_id()), "ordered")
    part, inner = F.shiftright("_inner", 33), F.col("_inner").bitwiseAND(F.lit((1 << 33) - 1))
    ranged = ranged.withColumn("_part", part).withColumn("_inner", inner)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    return ranged.join(starts, "_part").withColumn("_place", F.col("_before") + F.col("_inner")).drop("_part", "_inner", "_before")
