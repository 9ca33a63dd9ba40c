"""Tune and fit the models of one target."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridflow.operators import sampling
from gridflow.operators.metrics import REGRESSION_METRICS, scores_long
from gridflow.operators.models import ModelSpec, fit_hurdle, fit_model, save_models
from gridflow.operators.tuning import cross_validate, grid_search
from gridflow.plans.config import Config
from gridflow.schema import col, complete
from gridflow.session import stored

ROW, PLACE = "_row", "_place"


@dataclass
class Training:
    """Numbered, shuffled training rows of one target with their folds.

    `folds` carries the test fold of each row; `redrawn` the training rows per split when
    presences are redrawn.
    """

    rows: DataFrame
    folds: DataFrame
    redrawn: DataFrame | None


def prepare_training(
    train: DataFrame, target: str, config: Config, y: str = "y", positive: bool = False
) -> Training:
    """Rows with all predictors and the target, in random order, cut into folds."""
    wanted = [*config.predictors, target]
    rows = complete(train, wanted).withColumn(y, col(target).cast("double"))
    if positive:
        rows = rows.where(col(y) > 0)
    # the number of a row is written down with it, so that every later draw refers to it
    numbered = stored(rows.withColumn(ROW, F.monotonically_increasing_id()), "train")
    placed = sampling.with_random_index(numbered, [ROW], config.seed)
    placed = stored(placed.withColumnRenamed("idx", PLACE), "train")
    redrawn = None
    if config.stratify and config.upsample and not positive:
        folds, redrawn = sampling.upsampled_folds(placed.drop("_n"), y, config.cv, PLACE, config.seed)
        redrawn = stored(redrawn, "redrawn")
    elif config.stratify or positive:
        folds = sampling.zero_stratified_kfold(placed.drop("_n"), y, config.cv, PLACE)
    else:
        # the place is the position already: folds follow without numbering again
        folds = sampling.contiguous_folds(placed, config.cv, PLACE, "_n").drop("_n")
    folds = stored(folds, "folds")
    return Training(folds, folds, redrawn)


class Tuner:
    """Grid search, fit and cross-validation of one target's models."""

    def __init__(self, train: DataFrame, target: str, config: Config, regions: str | None = None):
        self.spark: SparkSession = train.sparkSession
        self.target, self.config, self.regions = target, config, regions
        self.all = prepare_training(train, target, config)
        self.present = (
            prepare_training(train, target, config, positive=True) if config.two_phase else self.all
        )

    def _spec(self, model: str, task: str) -> ModelSpec:
        return ModelSpec(model, task, {}, seed=self.config.seed, bags=self.config.knn_bags)

    def _search(self, model: str, task: str, data: Training, log: str) -> ModelSpec:
        c = self.config
        best, _ = grid_search(
            self._spec(model, task), c.grid(model, task), data.folds, c.cv, c.predictors, "y", ROW,
            log, data.redrawn, self.regions, c.parallelism, c.scoring if task == "reg" else None,
        )
        return best

    def _fit(self, spec: ModelSpec, rows: DataFrame, weight: str | None = None):
        return fit_model(spec, rows, self.config.predictors, "y", ROW, weight, self.regions)

    def _scores(self, model: str, part: str, fit, data: Training) -> DataFrame:
        clf = part == "clf"
        folds = cross_validate(
            data.folds, self.config.cv, fit, "y", clf, data.redrawn, self.config.parallelism
        )
        metrics = ["balanced_accuracy"] if clf else REGRESSION_METRICS
        return scores_long(folds, model, self.target, metrics).withColumn("part", F.lit(part))

    def train(self, model: str, log: str = "no") -> DataFrame:
        """Fit, save and score one model; returns its scores.

        With two phases the regressor sees presences only, and the classifier and the
        combined model are fitted as well.
        """
        c = self.config
        reg = self._search(model, "reg", self.present, log)
        fitted = {(model, self.target, "reg"): self._fit(reg, self.present.rows)}
        scores = self._scores(model, "reg", lambda d, w: self._fit(reg, d, w), self.present)
        specs = {"reg": reg}
        if c.two_phase:
            clf = self._search(model, "clf", self.all, "no")
            specs["clf"] = clf

            def hurdle(rows, weight=None):
                return fit_hurdle(
                    clf, reg, rows, c.predictors, "y", ROW, 0.5, weight, self.regions
                )

            fitted[model, self.target, "clf"] = self._fit(clf, self.all.rows)
            fitted[model, self.target, "zir"] = hurdle(self.all.rows)
            scores = scores.unionByName(
                self._scores(model, "clf", lambda d, w: self._fit(clf, d, w), self.all)
            ).unionByName(self._scores(model, "zir", hurdle, self.all))
        if model in ("xgb", "gbt"):
            self._add_bags(fitted, model)
        save_models(fitted, c.path)
        write_scores(scores, c.path)
        write_parameters(self.spark, model, self.target, specs, c.path)
        return read_scores(self.spark, c.path).where(
            (F.col("model") == model) & (F.col("target") == self.target)
        )

    def _add_bags(self, fitted: dict, model: str) -> None:
        """Bootstrap copies of boosted models, which become their interval members."""
        for (name, target, part), m in fitted.items():
            rows = self.present.rows if part == "reg" else self.all.rows
            parts = [m.classifier, m.regressor] if part == "zir" else [m]
            for p in parts:
                if p is not None:
                    p.fit_bags(rows, self.config.predictors, "y", ROW, self.config.interval_bags)


def write_scores(scores: DataFrame, path: str) -> None:
    """One folder per model and target; a rerun replaces it."""
    stored_scores = stored(scores, "scores")
    rows = stored_scores.select("model", "target").distinct().collect()
    for r in rows:
        part = stored_scores.where((F.col("model") == r[0]) & (F.col("target") == r[1]))
        folder = f"{path}/scoring/model={r[0]}/target={r[1]}"
        part.drop("model", "target").coalesce(1).write.mode("overwrite").parquet(folder)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/scoring")


def write_parameters(spark, model: str, target: str, specs: dict[str, ModelSpec], path: str) -> None:
    rows = [
        (part, name, str(value))
        for part, spec in specs.items()
        for name, value in [*sorted(spec.params.items()), ("log", spec.log)]
    ]
    table = spark.createDataFrame(rows, "part string, name string, value string")
    folder = f"{path}/parameters/model={model}/target={target}"
    table.coalesce(1).write.mode("overwrite").parquet(folder)


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/parameters")


def summarise_parameters(params: DataFrame, model: str) -> DataFrame:
    """One row per target with a column `<part>_<name>` per tuned parameter."""
    rows = params.where(F.col("model") == model)
    named = rows.withColumn("column", F.concat_ws("_", "part", "name"))
    # a few dozen names per model
    names = sorted(r[0] for r in named.select("column").distinct().collect())
    return named.groupBy("target").pivot("column", names).agg(F.first("value"))
