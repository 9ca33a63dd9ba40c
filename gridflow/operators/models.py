"""Regressors and classifiers: forests, boosted trees, bagged neighbours, hurdle, voting.

Every fitted model offers

* ``predict(df, out)``: adds `out`, and for classifiers also `<out>_proba`;
* ``members(df, out, threshold)``: adds the array of member predictions per row, on the
  original scale for regressors and as 0/1 for classifiers;
* ``save(path)`` / ``load_model(spark, path)``.
"""

from __future__ import annotations

import json
import math
import sys
import warnings
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridflow.functions import kernels, trees
from gridflow.functions.columns import log_forward, log_inverse, presence_label
from gridflow.functions.rows import row_mean
from gridflow.identity import with_row_number
from gridflow.operators.neighbours import ROW, bagged_search, dealt, with_answers
from gridflow.operators.sampling import bag_features, bag_weights, prefix_sum
from gridflow.schema import col, complete, require
from gridflow.session import BROADCAST_BYTES, fits_broadcast, in_threads, scratch_path, stored

cloudpickle.register_pickle_by_value(trees)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_TREE_DEPTH = 30
MAX_CATEGORIES = 1000
#: Parameters each learner reads, and those it accepts without effect.
KNOWN = {
    "rf": {"n_estimators", "max_depth", "min_samples_leaf", "max_samples", "max_features", "bootstrap"},
    "xgb": {"n_estimators", "max_depth", "learning_rate", "subsample", "colsample_bytree", "gamma"},
    "knn": {"max_samples", "max_features", "n_neighbors", "p", "weights"},
}
WITHOUT_EFFECT = {
    "rf": {"n_jobs", "verbose"},
    "xgb": {"n_jobs", "verbosity", "reg_alpha", "reg_lambda"},
    "knn": {"n_jobs", "leaf_size"},
}
GBT_BAGS = 160
LABEL = "_label"
VECTOR = "_features"


@dataclass(frozen=True)
class ModelSpec:
    """What to fit. `kind` is rf, xgb or knn; `task` is reg or clf."""

    kind: str
    task: str = "reg"
    params: dict = field(default_factory=dict)
    log: bool = False
    seed: int = 0
    bags: int = 30

    def with_params(self, params: dict, log: bool | None = None) -> ModelSpec:
        merged = {**self.params, **params}
        log = self.log if log is None else log
        return ModelSpec(self.kind, self.task, merged, log, self.seed, self.bags)


# --- feature preparation ----------------------------------------------------------------


@dataclass(frozen=True)
class Preprocessor:
    """Standardised numeric predictors and one 0/1 column per known category.

    An unknown category gives zeros in all of them.
    """

    stats: dict[str, list[float]]
    categories: dict[str, list[str]]

    def columns(self) -> dict[str, Column]:
        out = {}
        for name, (mean, sd) in self.stats.items():
            centred = col(name).cast("double") - F.lit(mean)
            out[f"_x{len(out)}"] = centred / F.lit(sd if sd > 0 else 1.0)
        for name, values in self.categories.items():
            for v in values:
                is_v = F.coalesce(col(name) == F.lit(v), F.lit(False))
                out[f"_x{len(out)}"] = is_v.cast("double")
        return out

    @property
    def names(self) -> list[str]:
        n = len(self.stats) + sum(len(v) for v in self.categories.values())
        return [f"_x{i}" for i in range(n)]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns())

    def assemble(self, df: DataFrame) -> DataFrame:
        """Adds the feature vector; rows with a missing feature keep an invalid vector slot."""
        assembler = VectorAssembler(inputCols=self.names, outputCol=VECTOR, handleInvalid="keep")
        return assembler.transform(self.transform(df)).drop(*self.names)


def scaler(df: DataFrame, columns: list[str]) -> dict[str, list[float]]:
    """Mean and population standard deviation per column: one aggregation."""
    aggs = []
    for c in columns:
        aggs += [F.avg(col(c)).alias(f"m_{c}"), F.stddev_pop(col(c)).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    return {c: [float(row[f"m_{c}"]), float(row[f"s_{c}"])] for c in columns}


def one_hot(df: DataFrame, name: str, most: int = MAX_CATEGORIES) -> list[str]:
    """The categories of a column, in order; refuses columns with more than `most` values."""
    values = df.where(col(name).isNotNull()).select(col(name)).distinct()
    found = sorted(r[0] for r in values.limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"{name!r} has more than {most} values")
    return found


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table with each column replaced by its standardised value."""
    stats = scaler(df, columns)
    return df.withColumns(
        {c: (col(c) - F.lit(m)) / F.lit(s if s > 0 else 1.0) for c, (m, s) in stats.items()}
    )


def fit_preprocessor(
    df: DataFrame, features: list[str], regions: str | None = None, most: int = MAX_CATEGORIES
) -> Preprocessor:
    require(df, features)
    numeric = [f for f in features if f != regions]
    categories = {regions: one_hot(df, regions, most)} if regions else {}
    return Preprocessor(scaler(df, numeric), categories)


# --- fitted models ----------------------------------------------------------------------


def _inverse(c: Column, spec: ModelSpec) -> Column:
    return log_inverse(c) if spec.log else c


def _write_json(spark: SparkSession, path: str, content: dict) -> None:
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def own_scale(members: Column, spec: ModelSpec, threshold: float) -> Column:
    """Raw members as predictions: classes for a classifier, values on the scale of the target."""
    if spec.task == "clf":
        return F.transform(members, lambda v: (v > F.lit(threshold)).cast("double"))
    return F.transform(members, log_inverse) if spec.log else members


@dataclass
class Forest:
    """Random forest; its members are the trees."""

    spec: ModelSpec
    prep: Preprocessor
    model: object
    _compiled: trees.Trees | None = None

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return _tree_prediction(self.model, self.spec, self.prep.assemble(df), out).drop(VECTOR)

    def compiled(self, spark: SparkSession) -> trees.Trees:
        """The trees as arrays, each weighing one over their number: the size of the model."""
        if self._compiled is None:
            if self.spec.task == "clf":  # class shares of leaves are only in the stored form
                nodes = _stored_nodes(spark, self.model)
            else:
                nodes, _ = trees.from_text(self.model.toDebugString)
            self._compiled = trees.from_nodes(nodes, [1.0 / len(nodes)] * len(nodes))
        return self._compiled

    def raw_members(self, df: DataFrame, out: str) -> DataFrame:
        """One walk per batch through all trees, which are broadcast as the model is.

        Values on the scale of the fit, class shares for classifiers; null where a feature is missing.
        """
        shared = df.sparkSession.sparkContext.broadcast(self.compiled(df.sparkSession))
        return _with_walk(df, self.prep, out, lambda x: trees.values(shared.value, x))

    def members(self, df: DataFrame, out: str = "members", threshold: float = 0.5) -> DataFrame:
        return self.raw_members(df, out).withColumn(out, own_scale(F.col(out), self.spec, threshold))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        _save_parts(spark, path, "forest", self.spec, self.prep)
        self.model.write().overwrite().save(f"{path}/model")


@dataclass
class Boosted:
    """Boosted trees; for intervals, copies fitted on bootstrap bags are the members."""

    spec: ModelSpec
    prep: Preprocessor
    model: object
    bagged: list = field(default_factory=list)
    _compiled: tuple | None = None

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return _tree_prediction(self.model, self.spec, self.prep.assemble(df), out).drop(VECTOR)

    def fit_bags(
        self, df: DataFrame, features, label, ident: str, n: int = GBT_BAGS, parallelism: int = 4
    ) -> Boosted:
        """Copies of the model fitted on `n` bootstrap bags.

        The rows are assembled and written once, with an array of their draws in all bags; each fit reads that table.
        """
        rows = _labelled(df, label, self.spec)
        rows = bag_weights(complete(rows, features), ident, n, 1.0, self.spec.seed)
        rows = stored(self.prep.assemble(rows).select(VECTOR, LABEL, "_bags"), "bags")

        def fit(b):
            drawn = rows.select(VECTOR, LABEL, F.get("_bags", F.lit(b)).alias("weight")).where(F.col("weight") > 0)
            return fit_boosted(self.spec, drawn, 1, len(self.prep.names), "weight")

        self.bagged = in_threads([lambda b=b: fit(b) for b in range(n)], parallelism)
        self._compiled = None
        return self

    def compiled(self) -> tuple[trees.Trees, np.ndarray]:
        """The trees of all bags as arrays with their weights, and the first tree of each bag."""
        if self._compiled is None:
            nodes, weights, first = [], [], []
            for m in self.bagged:
                first.append(len(nodes))
                found = trees.from_text(m.toDebugString)
                nodes, weights = nodes + found[0], weights + found[1]
            self._compiled = trees.from_nodes(nodes, weights), np.array(first, np.int64)
        return self._compiled

    def members(self, df: DataFrame, out: str = "members", threshold: float = 0.5) -> DataFrame:
        """One walk per batch through the trees of all bags, which are broadcast as the models are."""
        if not self.bagged:
            raise ValueError("a boosted model has no members before fit_bags: its interval would have no width")
        shared = df.sparkSession.sparkContext.broadcast(self.compiled())
        rows = _with_walk(df, self.prep, out, lambda x: trees.sums(*shared.value[:1], x, shared.value[1]))
        spec, raw = self.spec, F.col(out)
        if spec.task == "clf":
            return rows.withColumn(out, own_scale(F.transform(raw, lambda v: 1.0 / (1.0 + F.exp(-2.0 * v))), spec, threshold))
        return rows.withColumn(out, F.transform(own_scale(raw, spec, threshold), lambda v: F.greatest(v, F.lit(0.0))))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        _save_parts(spark, path, "boosted", self.spec, self.prep, {"bags": len(self.bagged)})
        self.model.write().overwrite().save(f"{path}/model")
        for i, m in enumerate(self.bagged):
            m.write().overwrite().save(f"{path}/bag-{i}")


def _with_walk(df: DataFrame, prep: Preprocessor, out: str, walk) -> DataFrame:
    """Adds the array `walk(features)` of each row; null where a feature is missing."""
    width = len(prep.names)

    @F.arrow_udf("array<double>")
    def walked(x: pa.Array) -> pa.Array:
        found = walk(kernels.matrix(x, width))
        return kernels.ragged(found, np.ones(found.shape, dtype=bool), pa.float64())

    columns = list(prep.columns().values())
    whole = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) for c in columns])
    point = F.array(*[F.coalesce(c, F.lit(0.0)) for c in columns])
    return df.withColumn(out, F.when(whole, walked(point)))


def _stored_nodes(spark: SparkSession, model) -> list[list[tuple]]:
    """Nodes of a classifier's trees with the share of class 1 as value, from the model as Spark writes it."""
    path = scratch_path(spark, "forest")
    model.write().save(path)
    node = F.col("nodeData")
    stats = node["impurityStats"]
    share = F.get(stats, F.lit(1)) / F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", node["id"].alias("id"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"), F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("cut"),
        node["split"]["numCategories"].alias("kinds"), F.coalesce(share, F.lit(0.0)).alias("value"),
    )
    found: dict[int, list] = {}
    for r in rows.orderBy("treeID", "id").collect():
        if r.left >= 0 and r.kinds != -1:
            raise ValueError("not a question about a number")
        leaf = r.left < 0
        found.setdefault(r.treeID, []).append((-1 if leaf else r.feature, 0.0 if leaf else r.cut, max(r.left, 0), max(r.right, 0), r.value))
    return [found[k] for k in sorted(found)]


def _tree_prediction(model, spec: ModelSpec, rows: DataFrame, out: str) -> DataFrame:
    """Adds `out`; classifiers also `<out>_proba`. Null where a feature is missing."""
    model = model.copy().setPredictionCol("_p")
    # a missing feature is NaN in the vector; a tree would still send it down one side
    whole = ~F.exists(vector_to_array(F.col(VECTOR)), lambda v: F.isnan(v))
    if spec.task == "clf":
        model.setProbabilityCol("_prob").setRawPredictionCol("_raw")
        share = vector_to_array(F.col("_prob"))
        rows = model.transform(rows).withColumns(
            {
                out: F.when(whole, F.col("_p")),
                f"{out}_proba": F.when(whole, F.coalesce(F.get(share, F.lit(1)), F.lit(0.0))),
            }
        )
        return rows.drop("_p", "_prob", "_raw")
    value = _inverse(F.col("_p"), spec)
    if spec.kind == "xgb":
        value = F.greatest(value, F.lit(0.0))
    return model.transform(rows).withColumn(out, F.when(whole, value)).drop("_p")


@dataclass
class BaggedNeighbours:
    """k-nearest-neighbour models on bootstrap bags of rows and subsets of features.

    `table` holds (_row, y, _bags, features): `_bags` says how often each bag drew the row, and
    a row drawn twice counts twice.
    """

    spec: ModelSpec
    prep: Preprocessor
    table: DataFrame
    subsets: list[list[str]]
    k: int
    p: float
    weights: str
    limit: int = BROADCAST_BYTES

    def raw_members(self, df: DataFrame, out: str) -> DataFrame:
        """The answer of every bag; one search serves all bags, whatever the size of the table."""
        names = self.prep.names
        places = [[names.index(f) for f in subset] for subset in self.subsets]
        row_bytes = 8 * (len(names) + 3) + 4 * len(places)
        if fits_broadcast(self.table, row_bytes, self.limit):
            return self._broadcast_members(self.prep.transform(df), places, out).drop(*names)
        # a row number says whose answer is whose; only numbers and features take part in the search
        rows = with_row_number(df, ROW)
        asked = complete(self.prep.transform(rows).select(ROW, *names), names)
        answers = bagged_search(asked, self.table, names, places, self.k, self.p, self.weights, out)
        return with_answers(rows, answers, out).drop(ROW)

    def _broadcast_members(self, rows: DataFrame, places: list[list[int]], out: str) -> DataFrame:
        names = self.prep.names
        local = self.table.select("_row", "y", "_bags", *names).toPandas().sort_values("_row", kind="stable")
        base = (
            local[names].to_numpy(dtype=np.float64), local["y"].to_numpy(dtype=np.float64),
            np.array(local["_bags"].tolist(), dtype=np.int64).reshape(-1, len(places)),
        )
        shared = rows.sparkSession.sparkContext.broadcast(base)
        k, p, weights, width = self.k, self.p, self.weights, len(names)

        @F.arrow_udf("array<double>")
        def members(x: pa.Array) -> pa.Array:
            q = kernels.matrix(x, width)
            points, y, drawn = shared.value
            answers = np.empty((len(q), len(places)))
            for b, place in enumerate(places):
                copies = np.repeat(np.arange(len(y)), drawn[:, b])
                position, distance = kernels.nearest(q[:, place], points[copies][:, place], k, p)
                answers[:, b] = kernels.neighbour_mean(distance, y[copies][position] if len(copies) else distance, weights)
            return kernels.ragged(answers, np.ones(answers.shape, dtype=bool), pa.float64())

        whole = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
        point = F.array(*[F.coalesce(F.col(n), F.lit(0.0)) for n in names])
        return dealt(rows, len(local)).withColumn(out, F.when(whole, members(point)))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        rows = self.raw_members(df, "_members")
        mean = row_mean(F.col("_members"))
        if self.spec.task == "clf":
            found = {f"{out}_proba": mean, out: (mean > F.lit(0.5)).cast("double")}
            return rows.withColumns(found).drop("_members")
        return rows.withColumn(out, _inverse(mean, self.spec)).drop("_members")

    def members(self, df: DataFrame, out: str = "members", threshold: float = 0.5) -> DataFrame:
        return self.raw_members(df, out).withColumn(out, own_scale(F.col(out), self.spec, threshold))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        own = {"subsets": self.subsets, "k": self.k, "p": self.p, "weights": self.weights}
        _save_parts(spark, path, "neighbours", self.spec, self.prep, own)
        self.table.write.mode("overwrite").parquet(f"{path}/table")


@dataclass
class Hurdle:
    """Two-phase regressor for zero-heavy targets.

    The classifier decides presence; the regressor, fitted on the rows whose predicted
    probability reached `threshold`, gives the amount. Absent rows are predicted as zero.
    """

    classifier: object
    regressor: object
    threshold: float = 0.5

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        rows = self.classifier.predict(df, "_class")
        known = F.col("_class").isNotNull()
        if self.regressor is None:
            value = F.lit(0.0)
        else:
            rows = self.regressor.predict(rows, "_amount")
            value = F.when(F.col("_class") == 1, F.col("_amount")).otherwise(F.lit(0.0))
        return rows.withColumn(out, F.when(known, value)).drop("_class", "_class_proba", "_amount")

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        parts = {"type": "hurdle", "threshold": self.threshold, "empty": self.regressor is None}
        self.classifier.save(f"{path}/clf")
        if self.regressor is not None:
            self.regressor.save(f"{path}/reg")
        _write_json(spark, f"{path}/about", parts)


@dataclass
class Voting:
    """Weighted mean of several models: of predictions, or of class probabilities."""

    models: list
    weights: list[float]
    task: str = "reg"
    pool_members: bool = False

    def combine(self, columns: list[Column]) -> Column:
        """Weighted mean of one column per model."""
        total = sum(self.weights)
        weighted = [c * F.lit(w / total) for c, w in zip(columns, self.weights)]
        return reduce(lambda a, b: a + b, weighted)

    def _each(self, df: DataFrame) -> DataFrame:
        for i, m in enumerate(self.models):
            df = m.predict(df, f"_v{i}")
        return df

    def _drop(self, df: DataFrame) -> DataFrame:
        names = [f"_v{i}" for i in range(len(self.models))]
        return df.drop(*names, *[f"{n}_proba" for n in names])

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        rows = self._each(df)
        if self.task == "clf":
            share = self.combine([F.col(f"_v{i}_proba") for i in range(len(self.models))])
            rows = rows.withColumns({f"{out}_proba": share, out: (share > 0.5).cast("double")})
        else:
            rows = rows.withColumn(out, self.combine([F.col(f"_v{i}") for i in range(len(self.models))]))
        return self._drop(rows)

    def members(self, df: DataFrame, out: str = "members", threshold: float = 0.5) -> DataFrame:
        """The models themselves are the members; with `pool_members` all of their members."""
        if self.pool_members:
            for i, m in enumerate(self.models):
                df = m.members(df, f"_v{i}", threshold)
            parts = F.array(*[F.col(f"_v{i}") for i in range(len(self.models))])
            return self._drop(df.withColumn(out, F.flatten(parts)))
        rows = self._each(df)
        if self.task == "clf":
            parts = [(F.col(f"_v{i}_proba") > threshold).cast("double") for i in range(len(self.models))]
        else:
            parts = [F.col(f"_v{i}") for i in range(len(self.models))]
        return self._drop(rows.withColumn(out, F.array(*parts)))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        for i, m in enumerate(self.models):
            m.save(f"{path}/part-{i}")
        about = {"type": "voting", "weights": self.weights, "task": self.task, "pool": self.pool_members}
        _write_json(spark, f"{path}/about", {**about, "n": len(self.models)})


# --- fitting ----------------------------------------------------------------------------


def _subset_strategy(value, n_features: int, default: str) -> str:
    """Features tried per split: a count, a share, or a named rule."""
    if value is None:
        return default
    if isinstance(value, str):
        return {"sqrt": "sqrt", "log2": "log2", "auto": "auto"}[value]
    if isinstance(value, int):  # a count: 1 is one feature
        return str(value) if value < n_features else "all"
    return "all" if value >= 1.0 else str(float(value))


def used_spec(spec: ModelSpec) -> ModelSpec:
    """The spec that is really fitted and reported: Spark's trees stop at MAX_TREE_DEPTH."""
    depth = spec.params.get("max_depth")
    if depth is None or spec.kind == "knn" or int(depth) <= MAX_TREE_DEPTH:
        return spec
    warnings.warn(f"tree depth {depth} becomes {MAX_TREE_DEPTH}, the largest Spark allows")
    return spec.with_params({"max_depth": MAX_TREE_DEPTH})


def _depth(value, default: int) -> int:
    return default if value is None else int(value)


def is_count(value) -> bool:
    """Whole numbers count rows or features, so 1 is one of them; 1.0 is all."""
    return isinstance(value, int) and not isinstance(value, bool)


def check_parameters(kind: str, params: dict) -> None:
    """Refuse names that the learner would not read, so that two candidates never are the same fit."""
    kind = "xgb" if kind == "gbt" else kind
    named = {k.removeprefix("estimator__") if kind == "knn" else k for k in params}
    unknown = sorted(named - KNOWN[kind] - WITHOUT_EFFECT[kind])
    if unknown:
        raise ValueError(f"{kind} has no parameters {unknown}")


def _share(value, n: int, default: float) -> float:
    if value is None:
        return default
    return min(1.0, value / n) if is_count(value) else float(value)


def _smallest_leaf(value, n: int) -> int:
    """Least rows per leaf. A leaf share above one half cannot be split: the tree is a stump."""
    if value is None:
        return 1
    return max(1, math.ceil(value * n)) if isinstance(value, float) else int(value)


def fit_forest(spec: ModelSpec, rows: DataFrame, n: int, width: int, weight: str | None):
    p = spec.params
    kind = RandomForestRegressor if spec.task == "reg" else RandomForestClassifier
    learner = kind(
        featuresCol=VECTOR,
        labelCol=LABEL,
        numTrees=int(p.get("n_estimators", 100)),
        maxDepth=_depth(p.get("max_depth"), MAX_TREE_DEPTH),
        minInstancesPerNode=_smallest_leaf(p.get("min_samples_leaf"), n),
        subsamplingRate=_share(p.get("max_samples"), n, 1.0),
        featureSubsetStrategy=_subset_strategy(
            p.get("max_features"), width, "all" if spec.task == "reg" else "sqrt"
        ),
        bootstrap=bool(p.get("bootstrap", True)),
        seed=spec.seed,
        maxMemoryInMB=512,
    )
    if weight:
        learner.setWeightCol(weight)
    return learner.fit(rows)


def fit_boosted(spec: ModelSpec, rows: DataFrame, n: int, width: int, weight: str | None):
    """Squared-error boosting; predictions are cut at zero (no Tweedie loss in Spark)."""
    p = spec.params
    ignored = [k for k in ("reg_alpha", "reg_lambda") if p.get(k)]
    if ignored:
        warnings.warn(f"no Spark setting for {ignored}")
    kind = GBTRegressor if spec.task == "reg" else GBTClassifier
    learner = kind(
        featuresCol=VECTOR,
        labelCol=LABEL,
        maxIter=int(p.get("n_estimators", 100)),
        maxDepth=_depth(p.get("max_depth"), 6),
        stepSize=float(p.get("learning_rate", 0.3)),
        subsamplingRate=float(p.get("subsample", 1.0)),
        featureSubsetStrategy=_subset_strategy(p.get("colsample_bytree"), width, "all"),
        minInfoGain=float(p.get("gamma", 0.0)),
        seed=spec.seed,
        maxMemoryInMB=512,
    )
    if weight:
        learner.setWeightCol(weight)
    return learner.fit(rows)


def fit_neighbours(
    spec: ModelSpec, rows: DataFrame, prep: Preprocessor, ident: str, weight: str | None
) -> BaggedNeighbours:
    """`bags=0` in the spec keeps all rows and features in a single bag."""
    p = spec.params
    rows = prep.transform(rows).select(
        col(ident).cast("bigint").alias("_row"),
        F.col(LABEL).cast("double").alias("y"),
        (col(weight) if weight else F.lit(1)).cast("bigint").alias("_w"),
        *prep.names,
    )
    rows = complete(rows, prep.names)
    if spec.bags:
        if weight:
            # a row drawn w times is w rows to draw from; copies get their own numbers
            rows = prefix_sum(rows, "_row", ["_w"])
            copies = F.explode(F.sequence(F.col("_w_cum") - F.col("_w"), F.col("_w_cum") - 1))
            rows = rows.where(F.col("_w") > 0).withColumn("_row", copies).drop("_w_cum")
        n_bags = spec.bags
        share = p.get("max_samples", 1.0)
        if is_count(share):
            share = share / max(1, rows.count())
        table = bag_weights(rows.drop("_w"), "_row", n_bags, float(share), spec.seed)
        width = p.get("max_features", 1.0)
        width = width / len(prep.names) if is_count(width) else float(width)
        subsets = bag_features(n_bags, prep.names, min(1.0, width), spec.seed)
    else:
        table = rows.withColumn("_bags", F.array(F.col("_w").cast("int"))).drop("_w")
        subsets = [prep.names]

    def setting(name, default):
        return p.get(f"estimator__{name}", p.get(name, default))

    return BaggedNeighbours(
        spec,
        prep,
        stored(table, "neighbours"),
        subsets,
        int(setting("n_neighbors", 5)),
        float(setting("p", 2)),
        setting("weights", "uniform"),
    )


def fit_model(
    spec: ModelSpec,
    df: DataFrame,
    features: list[str],
    label: str,
    ident: str,
    weight: str | None = None,
    regions: str | None = None,
    prep: Preprocessor | None = None,
):
    """Fit one model. Classifiers predict `label != 0`; `weight` counts repeated rows."""
    if spec.kind not in ("rf", "xgb", "gbt", "knn"):
        raise ValueError(f"unknown model {spec.kind!r}; use rf, xgb or knn")
    check_parameters(spec.kind, spec.params)
    spec = used_spec(spec)
    rows = _labelled(df, label, spec)
    prep = prep or fit_preprocessor(rows, features, regions)
    if spec.kind == "knn":
        return fit_neighbours(spec, rows, prep, ident, weight)
    assembled = prep.assemble(complete(rows, features))
    assembled = assembled.select(VECTOR, LABEL, *([weight] if weight else []))
    n = assembled.count() if _needs_count(spec) else 1
    width = len(prep.names)
    if spec.kind == "rf":
        return Forest(spec, prep, fit_forest(spec, assembled, n, width, weight))
    return Boosted(spec, prep, fit_boosted(spec, assembled, n, width, weight))


def _labelled(df: DataFrame, label: str, spec: ModelSpec) -> DataFrame:
    """Rows with a label, as the fit sees it: presence for a classifier, the log where the spec asks for it."""
    y = presence_label(col(label)).cast("double") if spec.task == "clf" else col(label).cast("double")
    if spec.log and spec.task == "reg":
        y = log_forward(y)
    return df.where(col(label).isNotNull()).withColumn(LABEL, y)


def _needs_count(spec: ModelSpec) -> bool:
    leaf, samples = spec.params.get("min_samples_leaf"), spec.params.get("max_samples")
    return isinstance(leaf, float) or is_count(samples)


def fit_hurdle(
    classifier: ModelSpec,
    regressor: ModelSpec,
    df: DataFrame,
    features: list[str],
    label: str,
    ident: str,
    threshold: float = 0.5,
    weight: str | None = None,
    regions: str | None = None,
) -> Hurdle:
    """The regressor sees the rows called present, with their observed value, zeros included."""
    clf = fit_model(classifier, df, features, label, ident, weight, regions)
    return hurdle_of(clf, regressor, df, features, label, ident, threshold, weight, regions)


def hurdle_of(
    clf, regressor: ModelSpec, df, features, label, ident, threshold=0.5, weight=None, regions=None
) -> Hurdle:
    called = clf.predict(df, "_class").where(F.col("_class_proba") >= threshold)
    called = stored(called.drop("_class", "_class_proba"), "present")
    if called.isEmpty():
        warnings.warn("no training row reaches the threshold: every prediction will be zero")
        return Hurdle(clf, None, threshold)
    reg = fit_model(regressor, called, features, label, ident, weight, regions)
    return Hurdle(clf, reg, threshold)


# --- persistence ------------------------------------------------------------------------


def _save_parts(spark, path, kind, spec: ModelSpec, prep: Preprocessor, extra: dict = {}) -> None:
    about = {"type": kind, "spec": asdict(spec), "prep": asdict(prep), **extra}
    _write_json(spark, f"{path}/about", about)


def load_model(spark: SparkSession, path: str):
    about = _read_json(spark, f"{path}/about")
    kind = about["type"]
    if kind == "hurdle":
        reg = None if about["empty"] else load_model(spark, f"{path}/reg")
        return Hurdle(load_model(spark, f"{path}/clf"), reg, about["threshold"])
    if kind == "voting":
        models = [load_model(spark, f"{path}/part-{i}") for i in range(about["n"])]
        return Voting(models, about["weights"], about["task"], about["pool"])
    spec, prep = ModelSpec(**about["spec"]), Preprocessor(**about["prep"])
    if kind == "neighbours":
        table = spark.read.parquet(f"{path}/table")
        return BaggedNeighbours(
            spec, prep, table, about["subsets"], about["k"], about["p"], about["weights"]
        )
    regression = spec.task == "reg"
    if kind == "forest":
        reader = RandomForestRegressionModel if regression else RandomForestClassificationModel
        return Forest(spec, prep, reader.load(f"{path}/model"))
    reader = GBTRegressionModel if regression else GBTClassificationModel
    bags = [reader.load(f"{path}/bag-{i}") for i in range(about["bags"])]
    return Boosted(spec, prep, reader.load(f"{path}/model"), bags)


def model_path(root: str, model: str, target: str, part: str) -> str:
    return f"{root}/model/{model}/{target.replace(' ', '_')}_{part}"


def save_models(models: dict[tuple[str, str, str], object], root: str) -> None:
    """Save models keyed by (model, target, part) with part reg, clf or zir."""
    for (model, target, part), fitted in models.items():
        fitted.save(model_path(root, model, target, part))


def load_models(
    spark: SparkSession, root: str, keys: list[tuple[str, str, str]]
) -> dict[tuple[str, str, str], object]:
    return {key: load_model(spark, model_path(root, *key)) for key in keys}
