"""The driver's tables seen as observations, environment grids and community fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridflow.operators.prepare import grid_mean
from gridflow.schema import KEYS

TARGETS = ["click", "error", "purchase", "signup", "view"]
WIDTH = 64
FEATURES = [f"f{i}" for i in range(WIDTH)]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(f"`{n}`"), digits) for n in names})


def obs(spark: SparkSession, sf: str) -> DataFrame:
    """Shipped lines as point observations on a 1 degree, 5 m, monthly grid."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_partkey") % 180 - 90).cast("double").alias("lat"),
        (F.col("l_suppkey") % 360 - 180).cast("double").alias("lon"),
        ((F.col("l_linenumber") - 1) * 5).cast("double").alias("depth"),
        F.month("l_shipdate").alias("time"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.col("l_linenumber").alias("line"),
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return grid_mean(obs(spark, sf), KEYS, ["quantity", "price"])


def env(spark: SparkSession, sf: str) -> DataFrame:
    """Environment grid that covers fewer cells than the observations."""
    rows = obs(spark, sf).where(F.col("tax") > 0.02)
    grid = grid_mean(rows, KEYS, ["discount", "tax"])
    return grid.withColumnsRenamed({"discount": "temperature", "tax": "nitrate"})


def community_long(spark: SparkSession, sf: str) -> DataFrame:
    """Summed event value per user and day; the event type is the target."""
    user = F.col("user_id")
    return (
        table(spark, sf, "events")
        .groupBy(
            (user % 180 - 90).cast("double").alias("lat"),
            (F.floor(user / 180) - 180).cast("double").alias("lon"),
            F.dayofmonth("ts").alias("time"),
            F.col("event_type").alias("target"),
        )
        .agg(F.round(F.sum("value"), 2).alias("value"))
    )


def traits(spark: SparkSession, sf: str) -> DataFrame:
    """One row per event type."""
    return (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("Target"))
        .agg(F.max("value").alias("pg poc"), (F.min("value") + 1.0).alias("pg pic"))
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Long predictions of two models for three targets."""
    keys = ["lat", "lon", "time"]
    rows = obs(spark, sf).withColumnRenamed("flag", "target")

    def model(name, value):
        return (
            rows.groupBy(*keys, "target")
            .agg(
                F.avg(value).alias("mean"), F.min(value).alias("ci95_LL"), F.max(value).alias("ci95_UL")
            )
            .withColumn("model", F.lit(name))
            .withColumn("part", F.lit("final"))
        )

    return model("rf", "quantity").unionByName(model("ens", "price"))


def measured(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as measurements with a standard deviation that is missing for one method."""
    share = 0.05 + (F.col("o_custkey") % 10) / 100.0
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("value"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") * share).alias("sd"),
        F.col("o_orderpriority").alias("region"),
        F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("method"),
        F.nullif((F.col("o_custkey") % 100).cast("double"), F.lit(7.0)).alias("cells"),
        F.col("o_orderdate").alias("date"),
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a score."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id", "quality", "toxic", ((F.col("n_chars") % 997) / 997.0).alias("score")
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings with one column per feature and a zero-heavy target."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("double").alias("y"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(f) for i, f in enumerate(FEATURES)],
    )


def profile(spark: SparkSession, sf: str) -> DataFrame:
    """Vertical profile per part, with some missing values."""
    part = F.col("l_partkey")
    mean = F.avg("l_quantity")
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            (part % 180 - 90).cast("double").alias("lat"),
            (F.floor(part / 180) - 180).cast("double").alias("lon"),
            (F.col("l_linenumber") * 30).cast("double").alias("depth"),
        )
        .agg(F.when(mean <= 40, mean).alias("quantity"))
    )


def coarse(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly field on a 2 degree grid with holes."""
    rows = obs(spark, sf).withColumns(
        {
            "lat": F.floor((F.col("lat") + 90) / 2) * 2.0 - 90.0,
            "lon": F.floor((F.col("lon") + 180) / 2) * 2.0 - 180.0,
        }
    )
    return grid_mean(rows, ["lat", "lon", "time"], ["quantity"])


def grouped(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a 0/1 predictor `x`, another one `z`, and a zero-heavy target.

    One split on x predicts group means, so the results of whole model runs have a closed form.
    About a third of the rows with x = 1 and five sixths of the others are present: Spark
    merges leaves that predict the same class, so the groups have to differ in it.
    """
    customer = F.col("o_custkey")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        (customer % 9).isin(0, 1, 3).cast("double").alias("x"),
        (customer % 5 < 2).cast("double").alias("z"),
        F.when(customer % 3 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice") / 1000.0).alias("y"),
    )
