import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridflow.operators import applicability as A, ensemble as E, models as M, tuning as T
from gridflow.operators import sampling as S

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = np.maximum(0.0, 3 * x[:, 0] + x[:, 1] + 0.1 * rng.normal(size=300))
    rows = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    return df.persist()


def spec(kind, task="reg", **kw):
    params = {"rf": {"n_estimators": 6, "max_depth": 5}, "xgb": {"n_estimators": 4, "max_depth": 3},
              "knn": {"estimator__n_neighbors": 3}}[kind]
    return M.ModelSpec(kind, task, params, seed=1, bags=kw.pop("bags", 3), **kw)


def fit(s, data):
    model = M.fit_model(s, data, FEATURES, "y", "id")
    return model.fit_bags(data, FEATURES, "y", "id", 3) if s.kind == "xgb" else model


@pytest.mark.parametrize("kind", ["rf", "xgb", "knn"])
@pytest.mark.parametrize("log", [False, True])
def test_regressors(data, kind, log):
    model = fit(spec(kind, log=log), data)
    rows = E.predict_interval(model, model.predict(model.members(data), "p")).toPandas()
    assert 1 - ((rows.y - rows.p) ** 2).sum() / ((rows.y - rows.y.mean()) ** 2).sum() > 0.5
    assert (rows.ci95_LL <= rows.ci95_UL).all() and set(data.columns) <= set(rows.columns)
    members = np.array(rows.members.tolist())
    if kind != "xgb":
        back = np.expm1(np.log1p(members).mean(axis=1)) if log else members.mean(axis=1)
        assert np.allclose(back, rows.p)
    assert np.allclose(np.quantile(members, 0.975, axis=1), rows.ci95_UL)


@pytest.mark.parametrize("kind", ["rf", "xgb", "knn"])
def test_classifiers(data, kind):
    model = fit(spec(kind, "clf"), data)
    rows = model.predict(model.members(data, threshold=0.4), "p").toPandas()
    assert ((rows.y > 0) == (rows.p == 1)).mean() > 0.8
    assert rows.p_proba.between(0, 1).all()
    assert set(np.unique(np.array(rows.members.tolist()))) <= {0.0, 1.0}


def test_missing_feature_gives_null(spark, data):
    q = spark.createDataFrame([(1, None, 0.0, 0.0)], "id long, a double, b double, c double")
    for kind in ("rf", "xgb", "knn"):
        model = fit(spec(kind), data)
        assert model.predict(q).first()["prediction"] is None


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_neighbours_beyond_broadcast(data, weights):
    s = spec("knn").with_params({"estimator__weights": weights, "max_features": 0.7, "max_samples": 0.5})
    model = fit(s, data)
    near = {r["id"]: r["p"] for r in model.predict(data, "p").collect()}
    model.limit = 0
    far = {r["id"]: r["p"] for r in model.predict(data, "p").collect()}
    assert all(math.isclose(near[i], far[i], rel_tol=1e-9, abs_tol=1e-12) for i in near)


def test_preprocessor(spark):
    df = spark.createDataFrame([(1.0, "x"), (3.0, "y"), (5.0, None)], "v double, r string")
    prep = M.fit_preprocessor(df, ["v", "r"], regions="r")
    rows = prep.transform(df).select(*prep.names).collect()
    sd = math.sqrt(8 / 3)
    assert [tuple(r) for r in rows] == [(-2 / sd, 1.0, 0.0), (0.0, 0.0, 1.0), (2 / sd, 0.0, 0.0)]


def test_save_and_load(spark, data):
    root = tempfile.mkdtemp()
    models = {("rf", "E. x", "reg"): fit(spec("rf"), data), ("knn", "E. x", "reg"): fit(spec("knn"), data)}
    models["xgb", "E. x", "reg"] = fit(spec("xgb"), data).fit_bags(data, FEATURES, "y", "id", 2)
    models["ens", "E. x", "reg"] = M.Voting([models["rf", "E. x", "reg"], models["knn", "E. x", "reg"]], [0.3, 0.7])
    models["rf", "E. x", "zir"] = M.fit_hurdle(spec("rf", "clf"), spec("rf"), data, FEATURES, "y", "id")
    M.save_models(models, root)
    loaded = M.load_models(spark, root, list(models))
    for key, model in models.items():
        a = [r["p"] for r in model.predict(data, "p").orderBy("id").collect()]
        b = [r["p"] for r in loaded[key].predict(data, "p").orderBy("id").collect()]
        assert a == b
    assert len(loaded["xgb", "E. x", "reg"].members(data).first()["members"]) == 2


def test_hurdle(data):
    hurdle = M.fit_hurdle(spec("rf", "clf"), spec("rf"), data, FEATURES, "y", "id", 0.6)
    rows = E.predict_hurdle_interval(hurdle, hurdle.predict(data, "mean"), 0.6).toPandas()
    assert (rows["mean"] == 0).any() and (rows["mean"] > 0).any()
    assert (rows.loc[rows.clf_ci95_UL < 0.6, "ci95_UL"] == 0).all()
    never = M.hurdle_of(fit(spec("rf", "clf"), data), spec("rf"), data, FEATURES, "y", "id", 1.1)
    assert never.predict(data, "p").where("p <> 0").isEmpty()


def test_hurdle_interval_fixture(spark):
    clf = spark.createDataFrame([(1, 0.0, 1.0)], "k int, ci95_LL double, ci95_UL double")
    reg = spark.createDataFrame([(1, 2.0, 9.0)], "k int, ci95_LL double, ci95_UL double")
    assert tuple(E.hurdle_interval(clf, reg, 0.6, ["k"]).first()) == (1, 0.0, 9.0)


def test_inverse_weights(spark):
    df = spark.createDataFrame([("t", "a", 1.0), ("t", "b", 2.0), ("t", "c", 4.0)], "target string, model string, mae double")
    got = [r["weight"] for r in E.inverse_weights(df).orderBy("model").collect()]
    assert np.allclose(got, [4 / 7, 2 / 7, 1 / 7]) and np.allclose(E.inverse_shares([1, 2, 4]), got)


def test_member_weights_and_weighted_interval(data):
    model = fit(spec("rf"), data)
    weights = E.loss_weights(model, data, "y")
    assert len(weights) == 6 and math.isclose(sum(weights), 1.0)
    rows = E.predict_interval(model, data, weights=weights).toPandas()
    assert (rows.ci95_LL <= rows.ci95_UL).all()


def test_cross_validation_and_grid(data):
    folds = S.zero_stratified_kfold(data, "y", 3, "id").persist()
    scores = T.cross_validate(folds, 3, lambda d, w: M.fit_model(spec("rf"), d, FEATURES, "y", "id", w), "y")
    rows = scores.toPandas()
    assert sorted(rows.fold) == [0, 1, 2] and (rows.R2 > 0.3).all()
    best, table = T.grid_search(spec("rf"), {"max_depth": [1, 6]}, folds, 3, FEATURES, "y", "id", log="both")
    assert len(table) == 4 and best.params["max_depth"] == 6
    assert max(t["score"] for t in table) == next(t["score"] for t in table if t["params"] == best.params and t["log"] == best.log)
    bad, table = T.grid_search(spec("rf"), {"max_depth": [-1, 3]}, folds, 3, FEATURES, "y", "id")
    assert bad.params["max_depth"] == 3 and min(t["score"] for t in table) == T.FAILED


def test_upsampled_cross_validation(data):
    tests, training = S.upsampled_folds(data, "y", 2, "id", 3)
    fitter = lambda d, w: M.fit_model(spec("knn", "clf"), d, FEATURES, "y", "id", w)
    scores = T.cross_validate(tests, 2, fitter, "y", True, training).toPandas()
    assert len(scores) == 2 and (scores.balanced_accuracy > 0.6).all()


def test_train_intervals(data):
    folds = S.kfold(data, 2, "id")
    rows = T.train_intervals(folds, 2, lambda d, w: M.fit_model(spec("rf"), d, FEATURES, "y", "id", w))
    assert rows.count() == 300 and rows.where("ci95_LL > ci95_UL or ci95_LL is null").isEmpty()


def test_permutation_importance(data):
    model = fit(spec("rf"), data)
    rows = T.permutation_importance(model, data, "y", FEATURES, "id", 3, 5).toPandas().set_index("feature")
    assert rows.weight.idxmax() == "a" and math.isclose(rows.weight.sum(), 1.0)
    shuffled = T.permuted(data, ["a"], "id", 2, 5).toPandas()
    for _, part in shuffled.groupby("repeat"):
        assert sorted(part["_p_a"]) == sorted(part["a"]) and (part["_p_a"] != part["a"]).mean() > 0.9


def test_applicability_fixture(spark):
    train = spark.createDataFrame([(0, 0.0, 1.0), (1, 1.0, 1.0), (2, 3.0, 1.0)], "id long, x double, y double")
    test = spark.createDataFrame([(0, 4.0), (1, 5.0), (2, 6.0), (3, None)], "id long, x double")
    for limit in (A.BROADCAST_BYTES, 0):
        got = A.area_of_applicability(test, train, ["x"], "id", "id", {"x": 2.0}, "y", return_all=True, limit=limit)
        rows = got.orderBy("id").collect()
        assert [r["di"] for r in rows] == [0.5, 1.0, 1.5, None]
        assert [r["aoa"] for r in rows] == [0, 1, 1, None] and rows[0]["cutpoint"] == 1.0
        assert [r["lpd"] for r in rows] == [2, 1, 1, None]


def test_cut_rules(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 10]], "di double")
    assert A.cutpoint(df, rule="tukey", scale="standard", cap=False) == 4 + 1.5 * 2
    assert A.cutpoint(df, rule="mad", cap=False) == 3 + 3 * 1
    assert A.cutpoint(df, rule=0.5, scale="standard", cap=False) == 3.0
    assert A.cutpoint(df, rule="mad") == 10.0


def test_applicability_other_folds(spark):
    rows = [(0, 0.0, 0), (1, 1.0, 0), (2, 3.0, 1)]
    train = spark.createDataFrame(rows, "id long, x double, fold int")
    di, mean = A.train_dissimilarity(train, ["x"], "id", "fold")
    assert mean == (3 + 2 + 3 + 2) / 4
    assert [r["di"] for r in di.orderBy("id").collect()] == [3 / 2.5, 2 / 2.5, 2 / 2.5]
