"""Cross-validation, grid search, out-of-fold intervals and permutation importance."""

from __future__ import annotations

import itertools
import sys
import warnings
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window, functions as F

from gridflow.functions import kernels, trees
from gridflow.functions.columns import presence_label
from gridflow.operators.ensemble import predict_interval
from gridflow.operators.metrics import REGRESSION_METRICS, balanced_accuracy, regression_metrics
from gridflow.operators.models import Boosted, Forest, ModelSpec, Preprocessor, fit_model, fit_preprocessor, used_spec
from gridflow.operators.sampling import with_index, with_random_index
from gridflow.schema import col, complete
from gridflow.session import in_threads, scratch_path, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])
# Fixed value: score of a parameter combination whose fit fails.
FAILED = -1e99


def fold_store(folds: DataFrame, training: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Folds and redrawn training rows written in one folder per fold.

    Rows are numbered and dealt once; whoever asks for a fold, or for all others, reads its folders only.
    """
    def kept(df, by):
        path = scratch_path(df.sparkSession, "folds")
        df.write.partitionBy(by).parquet(path)
        back = df.sparkSession.read.schema(df.schema).parquet(path)
        return back.select(*[col(c) for c in df.columns])

    return kept(folds, "fold"), None if training is None else kept(training, "split")


def standardised_store(
    parts: list, preps: list[Preprocessor], features: list[str], label: str, ident: str
) -> tuple[DataFrame, list[str]]:
    """The prepared features of every fold, written once in folders by fold and part, and their names.

    Candidates read numbers that are ready for the fit: the scaling of a fold is not applied again.
    """
    names = [f"_v{i}" for i in range(len(preps[0].names))]
    rows = []
    for fold, ((train, test, weight), prep) in enumerate(zip(parts, preps)):
        made = [c.alias(n) for n, c in zip(names, prep.columns().values())]
        for part, df in (("train", complete(train, features)), ("test", test)):
            number = col(weight) if weight and part == "train" else F.lit(1)
            keys = [F.lit(fold).alias("_fold"), F.lit(part).alias("_part"), number.cast("bigint").alias("_weight")]
            rows.append(df.where(col(label).isNotNull()).select(*keys, col(ident).alias("_id"), col(label).alias("_y"), *made))
    both = reduce(lambda a, b: a.unionByName(b), rows)
    path = scratch_path(both.sparkSession, "prepared")
    both.write.partitionBy("_fold", "_part").parquet(path)
    return both.sparkSession.read.schema(both.schema).parquet(path), names


def fold_parts(
    folds: DataFrame, training: DataFrame | None, fold: int
) -> tuple[DataFrame, DataFrame, str | None]:
    """Training part, test part and weight column of one fold.

    `training` holds redrawn training rows (split, weight); without it the training part
    is every other fold.
    """
    test = folds.where(F.col("fold") == fold)
    if training is not None:
        return training.where(F.col("split") == fold), test, "weight"
    return folds.where(F.col("fold") != fold), test, None


def out_of_fold(
    folds: DataFrame, k: int, fit, label: str, training: DataFrame | None = None,
    parallelism: int = 4,
) -> DataFrame:
    """(fold, y, prediction[, prediction_proba]) of every row by the model not fitted on it.

    `fit(train, weight)` returns a fitted model.
    """
    folds, training = fold_store(folds, training)

    def one(fold):
        train, test, weight = fold_parts(folds, training, fold)
        return scored_rows(fit(train, weight), test, label)

    parts = in_threads([lambda f=f: one(f) for f in range(k)], parallelism)
    return reduce(lambda a, b: a.unionByName(b), parts)


def cross_validate(
    folds: DataFrame, k: int, fit, label: str, classifier: bool = False,
    training: DataFrame | None = None, parallelism: int = 4,
) -> DataFrame:
    """Scores per fold: R2, MAE, RMSE, or balanced accuracy for a classifier."""
    return fold_scores(out_of_fold(folds, k, fit, label, training, parallelism), classifier)


def scored_rows(model, test: DataFrame, label: str) -> DataFrame:
    rows = model.predict(test, "prediction")
    extra = [c for c in ("prediction_proba",) if c in rows.columns]
    return rows.select("fold", col(label).alias("y"), "prediction", *extra)


def fold_scores(rows: DataFrame, classifier: bool) -> DataFrame:
    if classifier:
        rows = rows.withColumn("y", presence_label(F.col("y")).cast("double"))
        return balanced_accuracy(rows, "y", "prediction", ["fold"])
    return regression_metrics(rows, "y", "prediction", ["fold"])


def parameter_grid(grid: dict[str, list]) -> list[dict]:
    names = sorted(grid)
    return [dict(zip(names, values)) for values in itertools.product(*[grid[n] for n in names])]


def grid_search(
    spec: ModelSpec, grid: dict[str, list], folds: DataFrame, k: int, features: list[str],
    label: str, ident: str, log: str = "no", training: DataFrame | None = None,
    regions: str | None = None, parallelism: int = 4, scoring: str | None = None,
) -> tuple[ModelSpec, list[dict]]:
    """Best spec by mean test score, and the score of every combination.

    `scoring` names the score: R2 (default), MAE or RMSE for regressors, errors negated so
    that larger is better; balanced_accuracy for classifiers. `log` is yes, no or both; with
    both, the log target wins only with a strictly higher score. A combination that fails
    scores `FAILED`.
    """
    modes = {"yes": [True], "no": [False], "both": [False, True]}[log]
    if spec.task == "clf":
        modes = [False]
    # candidates that would be the same fit are one candidate, reported as it is fitted
    named = [used_spec(spec.with_params(params, mode)) for mode in modes for params in parameter_grid(grid)]
    candidates = [c for i, c in enumerate(named) if c not in named[:i]]
    offered = ["balanced_accuracy"] if spec.task == "clf" else REGRESSION_METRICS
    metric = scoring or offered[0]
    if metric not in offered:
        raise ValueError(f"unknown score {metric!r}; use one of {offered}")
    sign = -1.0 if metric in ("MAE", "RMSE") else 1.0

    # the scaling of a fold is fitted and applied once and serves all candidates
    folds, training = fold_store(folds, training)
    parts = [fold_parts(folds, training, fold) for fold in range(k)]
    preps = in_threads(
        [lambda t=t: fit_preprocessor(t.where(col(label).isNotNull()), features, regions) for t, _, _ in parts], parallelism
    )

    store, names = standardised_store(parts, preps, features, label, ident)
    ready = Preprocessor({n: [0.0, 1.0] for n in names}, {})
    weight = "_weight" if training is not None else None

    def score(candidate):
        try:
            rows = []
            for fold in range(k):
                own = store.where(F.col("_fold") == fold)
                model = fit_model(candidate, own.where("_part = 'train'"), names, "_y", "_id", weight, prep=ready)
                rows.append(scored_rows(model, own.where("_part = 'test'").withColumn("fold", F.col("_fold")), "_y"))
            scores = fold_scores(reduce(lambda a, b: a.unionByName(b), rows), spec.task == "clf")
            value = scores.agg(F.avg(metric) * sign).first()[0]
        except (PySparkException, ValueError) as error:
            warnings.warn(f"{candidate.params}: {error}")
            value = None
        return FAILED if value is None else value

    results = in_threads([lambda c=c: score(c) for c in candidates], parallelism)
    best = max(range(len(candidates)), key=lambda i: (results[i], -i))
    table = [
        {"params": c.params, "log": c.log, "score": s} for c, s in zip(candidates, results)
    ]
    return candidates[best], table


def train_intervals(
    folds: DataFrame, k: int, fit, threshold: float = 0.5, training: DataFrame | None = None, parallelism: int = 4
) -> DataFrame:
    """Interval of every training row from the model of the other folds."""
    folds, training = fold_store(folds, training)

    def one(fold):
        train, test, weight = fold_parts(folds, training, fold)
        return predict_interval(fit(train, weight), test, threshold)

    parts = in_threads([lambda f=f: one(f) for f in range(k)], parallelism)
    return reduce(lambda a, b: a.unionByName(b), parts)


def permuted(df: DataFrame, columns: list[str], ident: str, repeats: int, seed: int) -> DataFrame:
    """Every row `repeats` times, with `_p_<column>` taken from a random other row.

    The repeats share one join: in each repeat, the row at random position i receives the
    values of the row at position i of the identity order.
    """
    base = with_index(df.select(ident, *[col(c) for c in columns]), ident).select(
        "idx", *[col(c).alias(f"_p_{c}") for c in columns]
    )
    rows = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    placed = with_random_index(rows, [ident, "repeat"], seed, by=["repeat"]).drop("_n")
    return placed.join(base, "idx").drop("idx")


def _tree_scores(model, df: DataFrame, shuffled: DataFrame, y: str, features: list[str]) -> tuple[float, DataFrame]:
    """R2 as it is, and (feature, repeat, R2) with each feature permuted, by one walk per row and repeat.

    The trees' way to a row's leaf says which features it asks about; only for those is a tree
    walked again with the permuted value. Tasks give sums per feature and repeat, not rows.
    """
    spec, prep = model.spec, model.prep
    if isinstance(model, Forest):
        compiled, link = model.compiled(df.sparkSession), "mean"
    else:
        nodes, weights = trees.from_text(model.model.toDebugString)
        compiled, link = trees.from_nodes(nodes, weights), "boosted"
    moved = Preprocessor({f"_p_{c}": v for c, v in prep.stats.items()}, {f"_p_{c}": v for c, v in prep.categories.items()})
    owner = [*prep.stats, *[c for c, values in prep.categories.items() for _ in values]]
    group = np.array([features.index(c) for c in owner], np.int32)
    width, n = len(owner), len(features)
    shared = df.sparkSession.sparkContext.broadcast((compiled, group))
    middle = float(df.agg(F.avg(col(y).cast("double"))).first()[0] or 0.0)

    def value(raw: np.ndarray) -> np.ndarray:
        if spec.task == "clf":
            share = raw if link == "mean" else 1.0 / (1.0 + np.exp(-2.0 * raw))
            return (share > 0.5).astype(float)
        out = np.expm1(raw) if spec.log else raw
        return np.maximum(out, 0.0) if link == "boosted" else out

    def score(batches):
        compiled, group = shared.value
        for batch in batches:
            repeat, real = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            mine, theirs = (kernels.matrix(batch.column(k), width) for k in (2, 3))
            base, change = trees.changes(compiled, mine, theirs, group, n)
            guess = value(np.concatenate([base[:, None], base[:, None] + change], axis=1))
            for r in np.unique(repeat).tolist():
                at = repeat == r
                off = ((real[at, None] - guess[at]) ** 2).sum(axis=0)
                far = real[at] - middle
                size = n + 1
                columns = [np.full(size, r, np.int32), np.arange(-1, n, dtype=np.int32), off, np.full(size, far.sum()),
                           np.full(size, (far * far).sum()), np.full(size, at.sum())]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["repeat", "place", "off", "far", "wide", "n"])

    rows = shuffled.select(
        F.col("repeat").cast("int"), col(y).cast("double").alias("y"), F.array(*prep.columns().values()).alias("mine"),
        F.array(*moved.columns().values()).alias("theirs"),
    )
    sums = rows.mapInArrow(score, "repeat int, place int, off double, far double, wide double, n bigint")
    spread = F.sum("wide") - F.sum("far") * F.sum("far") / F.sum("n")
    scores = stored(sums.groupBy("repeat", "place").agg((1.0 - F.sum("off") / F.nullif(spread, F.lit(0.0))).alias("R2")), "scores")
    base = scores.where("place = -1").agg(F.max("R2")).first()[0]
    named = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("place") + 1)
    return base, scores.where("place >= 0").select(named.alias("feature"), "repeat", "R2")


def permutation_importance(
    model, df: DataFrame, y: str, features: list[str], ident: str, repeats: int = 10, seed: int = 0
) -> DataFrame:
    """(feature, importance, weight): mean drop in R2 when a feature is permuted, and its share."""
    df = complete(df.select(ident, col(y), *[col(f) for f in features]))
    shuffled = permuted(df, features, ident, repeats, seed)
    if isinstance(model, (Forest, Boosted)):
        base, scores = _tree_scores(model, df, shuffled, y, features)
        baseline = F.lit(base)
    else:
        baseline = regression_metrics(model.predict(df, "_pred"), y, "_pred").select("R2").scalar()
        variants = shuffled.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
        swapped = variants.withColumns(
            {f: F.when(F.col("feature") == f, col(f"_p_{f}")).otherwise(col(f)) for f in features}
        )
        scores = regression_metrics(model.predict(swapped, "_pred"), y, "_pred", ["feature", "repeat"])
    mean = scores.groupBy("feature").agg(F.avg("R2").alias("_r2"))
    drop = mean.select("feature", (baseline - F.col("_r2")).alias("importance"))
    # a handful of rows: one per feature
    total = F.sum("importance").over(Window.partitionBy(F.lit(0)))
    return drop.withColumn("weight", F.try_divide("importance", F.nullif(total, F.lit(0.0))))
