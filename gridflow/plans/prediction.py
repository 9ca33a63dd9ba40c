"""Predict one target's field with every model and with the ensemble."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridflow.functions.columns import presence_label
from gridflow.operators.ensemble import (
    INTERVAL,
    inverse_shares,
    predict_hurdle_interval,
    predict_with_interval,
    with_interval,
)
from gridflow.operators.metrics import REGRESSION_METRICS, scores_long, youden_threshold
from gridflow.operators.models import Hurdle, Voting, fit_model, load_models, save_models
from gridflow.operators.tuning import cross_validate
from gridflow.plans.config import Config
from gridflow.plans.training import ROW, Training, prepare_training, read_scores, write_scores
from gridflow.schema import keys_of
from gridflow.session import stored


def _entry(part: str, mean, prefix: str) -> list:
    return [F.lit(part), mean, *[F.col(f"{prefix}{c}") for c in INTERVAL]]


class Predictor:
    """Writes the predictions table: keys, mean, ci95_LL, ci95_UL by model, target, part."""

    def __init__(
        self, train: DataFrame, target: str, grid: DataFrame, config: Config,
        regions: str | None = None,
    ):
        self.spark: SparkSession = train.sparkSession
        self.target, self.config, self.grid, self.regions = target, config, grid, regions
        self.training: Training = prepare_training(train, target, config)
        self.part = "zir" if config.two_phase else "reg"

    @property
    def path(self) -> str:
        return f"{self.config.path}/predictions"

    def _load(self, part: str) -> list:
        keys = [(m, self.target, part) for m in self.config.models]
        return list(load_models(self.spark, self.config.path, keys).values())

    def errors(self) -> list[float]:
        """Mean absolute cross-validation error of each model."""
        scores = read_scores(self.spark, self.config.path).where(
            (F.col("target") == self.target)
            & (F.col("part") == self.part)
            & (F.col("metric") == "MAE")
        )
        mae = scores.groupBy("model").agg(F.abs(F.avg("value")).alias("mae"))
        found = {r["model"]: r["mae"] for r in mae.collect()}
        return [found[m] for m in self.config.models]

    def optimal_threshold(self, classifier) -> float:
        """Presence probability with the best balance of hits and false alarms on the training rows."""
        rows = classifier.predict(self.training.rows, "_class")
        labelled = rows.withColumn("_present", presence_label(F.col("y")))
        return youden_threshold(labelled, "_class_proba", "_present").first()["threshold"]

    def phases(self, rows: DataFrame, model: str, fitted, prefix: str = "") -> tuple[DataFrame, list]:
        """Two-phase model: its columns added to the rows, and the entries to write."""
        threshold = self.optimal_threshold(fitted.classifier)
        rows = predict_hurdle_interval(fitted, rows, threshold, f"{prefix}mean")
        renamed = [f"{p}{c}" for p in ("", "clf_", "reg_") for c in INTERVAL]
        rows = rows.withColumnsRenamed({c: f"{prefix}{c}" for c in renamed})
        parts = [_entry("zir", F.col(f"{prefix}mean"), prefix)]
        parts += [_entry(p, F.lit(None).cast("double"), f"{prefix}{p}_") for p in ("clf", "reg")]
        return rows, [[F.lit(model), F.lit(self.target), *p] for p in parts]

    def fields(self, rows: DataFrame, models: list, ensemble: Voting | None, prefix: str = "") -> tuple[DataFrame, list]:
        """One-phase models: predictions of every model and of the ensemble, and the entries to write.

        The ensemble votes over the predictions already in the row.
        """
        names = list(self.config.models)
        for name, fitted in zip(names, models):
            rows = predict_with_interval(fitted, rows, f"{prefix}{name}_mean")
            rows = rows.withColumnsRenamed({c: f"{prefix}{name}_{c}" for c in INTERVAL})
        means = [F.col(f"{prefix}{n}_mean") for n in names]
        if ensemble is not None:
            names.append("ens")
            rows = rows.withColumns({f"{prefix}ens_mean": ensemble.combine(means), "_ens": F.array(*means)})
            rows = with_interval(rows, "_ens")
            rows = rows.withColumnsRenamed({c: f"{prefix}ens_{c}" for c in INTERVAL})
        entries = [
            [F.lit(n), F.lit(self.target), *_entry("final", F.col(f"{prefix}{n}_mean"), f"{prefix}{n}_")] for n in names
        ]
        return rows, entries

    def predicted(self, rows: DataFrame, ensemble, prefix: str = "") -> tuple[DataFrame, list]:
        """Rows with the columns of all models of this target, and the entries to write."""
        models = self._load(self.part)
        if not self.config.two_phase:
            return self.fields(rows, models, ensemble, prefix)
        entries = []
        named = list(zip(self.config.models, models)) + ([("ens", ensemble)] if ensemble is not None else [])
        for model, fitted in named:
            rows, found = self.phases(rows, model, fitted, f"{prefix}{model}_")
            entries += found
        return rows, entries

    def ensemble(self):
        """Weighted vote of the models; weights are inverse errors."""
        weights = inverse_shares(self.errors())
        if not self.config.two_phase:
            return Voting(self._load("reg"), weights)
        clf = Voting(self._load("clf"), weights, "clf")
        return self._two_phase_vote(clf, weights, self.training.rows)

    def _two_phase_vote(self, clf: Voting, weights, rows: DataFrame, weight=None) -> Hurdle:
        """The regressors are fitted again on the rows the voting classifier calls present."""
        threshold = self.optimal_threshold(clf)
        called = clf.predict(rows, "_class").where(F.col("_class_proba") >= threshold)
        called = stored(called.drop("_class", "_class_proba"), "present")
        if called.isEmpty():
            return Hurdle(clf, None, threshold)
        regressors = [self._refit(m, called, weight) for m in self._load("reg")]
        return Hurdle(clf, Voting(regressors, weights), threshold)

    def _refit(self, fitted, rows: DataFrame, weight: str | None = None):
        return fit_model(
            fitted.spec, rows, self.config.predictors, "y", ROW, weight, self.regions
        )

    def _ensemble_fit(self, weights):
        def fit(rows, weight):
            if not self.config.two_phase:
                return Voting([self._refit(m, rows, weight) for m in self._load("reg")], weights)
            clf = Voting([self._refit(m, rows, weight) for m in self._load("clf")], weights, "clf")
            return self._two_phase_vote(clf, weights, rows, weight)

        return fit

    def make_prediction(self) -> DataFrame:
        """Predict with each model, then with the ensemble; returns the predictions table."""
        return predict_all([self])

    def score_ensemble(self, ensemble) -> None:
        """Save the ensemble and write its cross-validation scores."""
        save_models({("ens", self.target, self.part): ensemble}, self.config.path)
        fit = self._ensemble_fit(inverse_shares(self.errors()))
        folds = cross_validate(
            self.training.folds, self.config.cv, fit, "y", False, self.training.redrawn,
            self.config.parallelism,
        )
        scores = scores_long(folds, "ens", self.target, REGRESSION_METRICS)
        write_scores(scores.withColumn("part", F.lit(self.part)), self.config.path)


def predict_all(predictors: list[Predictor]) -> DataFrame:
    """Write the fields of all targets in one narrow pass over the grid that they share.

    The predictors have the same grid and settings, one target each. The grid is read once;
    every row gets the columns of all targets and models and is laid out as rows of the
    predictions table (keys, mean, ci95_LL, ci95_UL by model, target, part).
    """
    first = predictors[0]
    if not first.config.models:
        raise ValueError("an ensemble needs at least one model")
    ensembles = [p.ensemble() if len(p.config.models) > 1 else None for p in predictors]
    rows, entries = first.grid, []
    for i, (p, ensemble) in enumerate(zip(predictors, ensembles)):
        rows, found = p.predicted(rows, ensemble, f"_t{i}_")
        entries += found
    fields = ["model", "target", "part", "mean", *INTERVAL]
    structs = [F.struct(*[c.alias(f) for f, c in zip(fields, e)]) for e in entries]
    table = rows.select(*keys_of(first.grid), F.inline(F.array(*structs)))
    writer = table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("model", "target", "part").parquet(first.path)
    for p, ensemble in zip(predictors, ensembles):
        if ensemble is not None:
            p.score_ensemble(ensemble)
    return first.spark.read.parquet(first.path)
