"""Regression and classification scores, score reports, and the ROC threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridflow.operators.sampling import prefix_sum
from gridflow.schema import col
from gridflow.session import stored

REGRESSION_METRICS = ["R2", "MAE", "RMSE"]


def regression_metrics(
    df: DataFrame, y: str, pred: str, by: list[str] = (), relative: bool = False
) -> DataFrame:
    """R2, MAE and RMSE, and with `relative` rMAE and rRMSE over the mean observation."""
    error = col(y) - col(pred)
    both = col(y).isNotNull() & col(pred).isNotNull()
    rows = df.where(both).select(*by, col(y).cast("double").alias("_y"), error.alias("_e"))
    squares = F.nullif(F.var_pop("_y") * F.count("_y"), F.lit(0.0))
    aggs = [
        (1.0 - F.sum(F.col("_e") * F.col("_e")) / squares).alias("R2"),
        F.avg(F.abs("_e")).alias("MAE"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("RMSE"),
    ]
    if relative:
        mean = F.nullif(F.avg("_y"), F.lit(0.0))
        aggs += [
            (F.avg(F.abs("_e")) / mean).alias("rMAE"),
            (F.sqrt(F.avg(F.col("_e") * F.col("_e"))) / mean).alias("rRMSE"),
        ]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def balanced_accuracy(df: DataFrame, y: str, pred: str, by: list[str] = ()) -> DataFrame:
    """Mean recall over the classes that occur."""
    rows = df.where(col(y).isNotNull())
    recall = rows.groupBy(*by, col(y).alias("_class")).agg(
        F.avg(F.when(col(y) == col(pred), 1.0).otherwise(0.0)).alias("_recall")
    )
    score = F.avg("_recall").alias("balanced_accuracy")
    return recall.groupBy(*by).agg(score) if by else recall.agg(score)


def scores_long(
    folds: DataFrame, model: str, target: str, metrics: list[str] = REGRESSION_METRICS
) -> DataFrame:
    """Per-fold metrics as rows (model, target, fold, metric, value).

    Errors are stored negated, so that larger is better for every metric.
    """
    signed = [(-col(m) if m in ("MAE", "RMSE") else col(m)).alias(m) for m in metrics]
    wide = folds.select(F.lit(model).alias("model"), F.lit(target).alias("target"), "fold", *signed)
    return wide.unpivot(["model", "target", "fold"], metrics, "metric", "value")


def summarise_performance(scores: DataFrame, field_means: DataFrame) -> DataFrame:
    """R2, RMSE, MAE, rRMSE, rMAE per model and target.

    `scores` holds negated errors per fold; `field_means` (target, mean_field) is what the
    relative errors are divided by, matched by target name.
    """
    def mean_of(metric):
        return F.avg(F.when(F.col("metric") == metric, F.col("value")))

    grouped = scores.groupBy("model", "target").agg(
        mean_of("R2").alias("R2"), (-mean_of("RMSE")).alias("RMSE"), (-mean_of("MAE")).alias("MAE")
    )
    mean = F.nullif(F.col("mean_field"), F.lit(0.0))
    return grouped.join(field_means, "target", "left").select(
        "model",
        "target",
        "R2",
        "RMSE",
        "MAE",
        (F.col("RMSE") / mean).alias("rRMSE"),
        (F.col("MAE") / mean).alias("rMAE"),
    )


def field_means(fields: DataFrame, targets: list[str]) -> DataFrame:
    """Mean of each target column of a wide field table, as (target, mean_field)."""
    means = fields.agg(*[F.avg(col(t)).alias(t) for t in targets])
    return means.unpivot([], [col(t) for t in targets], "target", "mean_field")


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score, highest first: true and false positive rates at or above it.

    Rows are merged per score before the running sum, so a score shared by many rows
    costs one row.
    """
    positive = F.count_if(col(label) == 1)
    merged = (
        df.where(col(score).isNotNull() & col(label).isNotNull())
        .groupBy(col(score).alias("threshold"))
        .agg(positive.alias("tp"), (F.count("*") - positive).alias("fp"))
    )
    # read by several steps below, so the scores are made once
    counts = stored(merged, "counts")
    totals = counts.agg(F.struct(F.sum("tp").alias("p"), F.sum("fp").alias("n"))).scalar()
    running = prefix_sum(counts, "threshold", ["tp", "fp"], descending=True)
    return running.select(
        "threshold",
        F.try_divide(F.col("tp_cum"), F.nullif(totals["p"], F.lit(0))).alias("tpr"),
        F.try_divide(F.col("fp_cum"), F.nullif(totals["n"], F.lit(0))).alias("fpr"),
    )


def youden_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """The score with the largest tpr - fpr; the higher one on ties, +inf without any gain."""
    gain = F.col("tpr") - F.col("fpr")
    best = roc_curve(df, score, label).agg(
        F.max(F.struct(gain.alias("gain"), F.col("threshold"))).alias("best")
    )
    found = F.when(F.col("best.gain") > 0, F.col("best.threshold"))
    return best.select(
        F.coalesce(found, F.lit(float("inf"))).alias("threshold"),
        F.greatest(F.coalesce(F.col("best.gain"), F.lit(0.0)), F.lit(0.0)).alias("gain"),
    )
