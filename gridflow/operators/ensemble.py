"""Combining models, member-based intervals and member weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridflow.functions.columns import log_inverse
from gridflow.functions.rows import ordered, quantiles_of_ordered, row_mean, weighted_quantile
from gridflow.operators.metrics import balanced_accuracy
from gridflow.operators.models import own_scale
from gridflow.schema import KEYS, col
from gridflow.session import stored

# Tail shares of the 95 % interval, and the guard against a zero loss.
LOWER, UPPER = 0.025, 0.975
LOSS_FLOOR = 1e-99
INTERVAL = ["ci95_LL", "ci95_UL"]


def inverse_weights(errors: DataFrame, by: list[str] = ("target",), error: str = "mae") -> DataFrame:
    """Add `weight`: 1 / error as a share of the group's sum. One row per model and target."""
    inverse = 1.0 / F.nullif(col(error), F.lit(0.0))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return errors.withColumn("weight", inverse / F.sum(inverse).over(group))


def inverse_shares(errors: list[float]) -> list[float]:
    """The same for a driver-side list with one error per model."""
    inverse = [1.0 / e for e in errors]
    return [i / sum(inverse) for i in inverse]


def vote(
    predictions: DataFrame, weights: DataFrame, keys: list[str] = KEYS, by: list[str] = ("target",)
) -> DataFrame:
    """Weighted mean prediction per cell from long rows (keys, model, by, prediction).

    There is one weight per model and target; written down, the table shows its true size
    and is broadcast, so the few join keys do not become a few huge tasks.
    """
    small = stored(weights.select(*by, "model", "weight"), "weights")
    weighted = predictions.join(small, [*by, "model"])
    total = F.sum(F.col("prediction") * F.col("weight")) / F.sum("weight")
    return weighted.groupBy(*by, *keys).agg(total.alias("prediction"))


def vote_proba(
    predictions: DataFrame, weights: DataFrame, keys: list[str] = KEYS, by: list[str] = ("target",)
) -> DataFrame:
    """Weighted mean probability per cell and the class it implies."""
    mean = vote(
        predictions.withColumnRenamed("proba", "prediction"), weights, keys, by
    ).withColumnRenamed("prediction", "proba")
    return mean.withColumn("class", (F.col("proba") > 0.5).cast("int"))


def with_interval(rows: DataFrame, members: str, weights: list[float] | None = None) -> DataFrame:
    """Replace the array column `members` by the two interval columns."""
    if weights is None:
        rows = rows.withColumn(members, ordered(col(members)))
        bounds = quantiles_of_ordered(col(members), [LOWER, UPPER])
    else:
        shares = F.array(*[F.lit(float(w)) for w in weights])
        bounds = [weighted_quantile(col(members), shares, q) for q in (LOWER, UPPER)]
    return rows.withColumns(dict(zip(INTERVAL, bounds))).drop(members)


def predict_interval(
    model, df: DataFrame, threshold: float = 0.5, weights: list[float] | None = None
) -> DataFrame:
    """Add ci95_LL and ci95_UL, the quantiles over the model's members.

    The members live only inside the row: they are folded into the two numbers in the
    stage that makes them.
    """
    return with_interval(model.members(df, "_members", threshold), "_members", weights)


def predict_with_interval(
    model, df: DataFrame, out: str = "prediction", threshold: float = 0.5, weights: list[float] | None = None
) -> DataFrame:
    """Add the prediction (and `<out>_proba` of a classifier) and its interval.

    Forests and bagged neighbours are the mean of their members, which are made once and
    give both. Other models predict by themselves.
    """
    if not hasattr(model, "raw_members"):
        return predict_interval(model, model.predict(df, out), threshold, weights)
    rows = model.raw_members(df, "_members")
    mean = row_mean(F.col("_members"))
    if model.spec.task == "clf":
        found = {f"{out}_proba": mean, out: (mean > F.lit(0.5)).cast("double")}
    else:
        found = {out: log_inverse(mean) if model.spec.log else mean}
    rows = rows.withColumns(found).withColumn("_members", own_scale(F.col("_members"), model.spec, threshold))
    return with_interval(rows, "_members", weights)


def member_losses(members: DataFrame, y: str, classifier: bool = False) -> DataFrame:
    """Loss of each member (member, loss): mean absolute error, or 1 - balanced accuracy."""
    rows = members.where(col(y).isNotNull()).select(
        col(y).alias("_y"), F.posexplode("members").alias("member", "_p")
    )
    if classifier:
        rows = rows.withColumns({"_y": (F.col("_y") != 0).cast("int"), "_p": F.col("_p").cast("int")})
        scores = balanced_accuracy(rows, "_y", "_p", ["member"])
        return scores.select("member", (1.0 - F.col("balanced_accuracy")).alias("loss"))
    error = F.avg(F.abs(F.col("_p") - F.col("_y")))
    return rows.groupBy("member").agg(error.alias("loss"))


def member_weights(members: DataFrame, y: str, classifier: bool = False) -> DataFrame:
    """(member, weight): inverse losses as shares."""
    losses = member_losses(members, y, classifier)
    inverse = 1.0 / (F.col("loss") + F.lit(LOSS_FLOOR))
    everything = Window.partitionBy(F.lit(0))
    return losses.select("member", (inverse / F.sum(inverse).over(everything)).alias("weight"))


def loss_weights(model, train: DataFrame, y: str, classifier: bool = False) -> list[float]:
    """Member weights as a list, one per member, for `predict_interval`."""
    table = member_weights(model.members(train, "members"), y, classifier)
    return [r["weight"] for r in table.orderBy("member").collect()]


def hurdle_interval(
    clf: DataFrame, reg: DataFrame, threshold: float, keys: list[str] = KEYS
) -> DataFrame:
    """Interval of a two-phase model: zero where the classifier's bound is below the threshold."""
    bounds = clf.select(*keys, *[col(c).alias(f"_clf_{c}") for c in INTERVAL])
    joined = reg.select(*keys, *INTERVAL).join(bounds, keys)
    return joined.select(*keys, *[_floor(c, col(f"_clf_{c}"), threshold) for c in INTERVAL])


def _floor(name: str, clf_bound: Column, threshold: float) -> Column:
    return F.when(clf_bound < F.lit(threshold), F.lit(0.0)).otherwise(col(name)).alias(name)


def predict_hurdle_interval(hurdle, df: DataFrame, threshold: float, out: str = "mean") -> DataFrame:
    """Prediction `out` and interval of a two-phase model without a join, each phase evaluated once.

    Adds the combined bounds and, with prefixes `clf_` and `reg_`, both phases' own.
    """
    rows = predict_with_interval(hurdle.classifier, df, "_class", threshold)
    rows = rows.withColumnsRenamed({c: f"clf_{c}" for c in INTERVAL})
    known, present = F.col("_class").isNotNull(), F.col("_class") == 1
    if hurdle.regressor is None:
        zero = {f"reg_{c}": F.lit(0.0) for c in INTERVAL}
        rows = rows.withColumns({**zero, **{c: F.lit(0.0) for c in INTERVAL}, out: F.when(known, F.lit(0.0))})
        return rows.drop("_class", "_class_proba")
    rows = predict_with_interval(hurdle.regressor, rows, "_amount", threshold)
    rows = rows.withColumns({f"reg_{c}": col(c) for c in INTERVAL})
    bounds = {c: _floor(c, col(f"clf_{c}"), threshold) for c in INTERVAL}
    amount = F.when(known, F.when(present, F.col("_amount")).otherwise(F.lit(0.0)))
    return rows.withColumns({**bounds, out: amount}).drop("_class", "_class_proba", "_amount")
