"""Compiled trees, bags as arrays, one search for all bags, stored folds, row numbers of files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridflow import identity
from gridflow.functions import kernels, trees
from gridflow.operators import models as M
from gridflow.operators import neighbours as N
from gridflow.operators import sampling as S
from gridflow.operators import tuning as T

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    rows = [(k, *map(float, rng.integers(0, 9, 3)), ["n", "s", "e"][k % 3], float(max(0.0, rng.normal(2)))) for k in range(240)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, zone string, y double")
    path = str(tmp_path_factory.mktemp("data") / "rows")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def spec(kind, task="reg", log=False, **params):
    base = {"rf": {"n_estimators": 7, "max_depth": 6}, "xgb": {"n_estimators": 5, "max_depth": 3}, "knn": {"estimator__n_neighbors": 3}}[kind]
    return M.ModelSpec(kind, task, {**base, **params}, log, seed=4, bags=30)


@pytest.mark.parametrize("task", ["reg", "clf"])
@pytest.mark.parametrize("log", [False, True])
def test_boosted_members_equal_the_bags_own_predictions(data, task, log):
    model = M.fit_model(spec("xgb", task, log), data, FEATURES, "y", "id").fit_bags(data, FEATURES, "y", "id", 4)
    got = {r.id: r.m for r in model.members(data, "m", 0.4).select("id", "m").collect()}
    for b, bag in enumerate(model.bagged):
        out = M.Boosted(model.spec, model.prep, bag).predict(data, "p")
        for r in out.collect():
            want = float(r.p_proba > 0.4) if task == "clf" else r.p
            assert abs(got[r.id][b] - want) < 1e-9


@pytest.mark.parametrize("task", ["reg", "clf"])
def test_forest_members_average_to_its_prediction(data, task):
    model = M.fit_model(spec("rf", task), data, FEATURES, "y", "id", regions="zone")
    for r in model.predict(model.raw_members(data, "m"), "p").collect():
        assert abs(np.mean(r.m) - (r.p_proba if task == "clf" else r.p)) < 1e-9


def test_a_tree_of_one_leaf_and_a_wide_batch():
    one = trees.from_nodes([[(-1, 0.0, 0, 0, 2.5)], [(1, 0.5, 1, 2, 0.0), (-1, 0.0, 0, 0, 1.0), (-1, 0.0, 0, 0, 3.0)]], [1.0, 0.5])
    x = np.array([[0.0, 0.5], [9.0, 0.6]])
    assert trees.values(one, x).tolist() == [[2.5, 1.0], [2.5, 3.0]]
    assert trees.sums(one, x, np.array([0, 1])).tolist() == [[2.5, 0.5], [2.5, 1.5]]
    with pytest.raises(ValueError, match="about a number"):
        trees.from_text("model\n  Tree 0 (weight 1.0):\n    If (feature 3 in {0.0,1.0})\n")


@pytest.mark.parametrize("kind,task,log", [("rf", "reg", False), ("rf", "clf", False), ("xgb", "reg", True), ("xgb", "clf", False)])
def test_importance_by_affected_trees_equals_whole_predictions(data, monkeypatch, kind, task, log):
    regions = "zone" if kind == "rf" else None
    features = [*FEATURES, *([regions] if regions else [])]
    model = M.fit_model(spec(kind, task, log), data, features, "y", "id", regions=regions)
    rows = data.withColumn("y", (F.col("y") > 0).cast("double")) if task == "clf" else data
    quick = {r.feature: r for r in T.permutation_importance(model, rows, "y", features, "id", 3, 5).collect()}
    monkeypatch.setattr(T, "Forest", str)
    monkeypatch.setattr(T, "Boosted", str)
    plain = {r.feature: r for r in T.permutation_importance(model, rows, "y", features, "id", 3, 5).collect()}
    assert set(quick) == set(plain) == set(features)
    for f in features:
        assert quick[f].importance == pytest.approx(plain[f].importance, abs=1e-9)
        assert quick[f].weight == pytest.approx(plain[f].weight, abs=1e-7)


@pytest.mark.parametrize("rows,draws", [(1, 5), (1024, 1024), (1025, 3), (5000, 2500)])
def test_draws_add_up_in_every_bag(rows, draws):
    counts = kernels.bag_counts(np.arange(rows), rows, draws, 20, 7)
    assert counts.sum(axis=0).tolist() == [draws] * 20
    assert (kernels.bag_counts(np.arange(rows)[::-1], rows, draws, 20, 7)[::-1] == counts).all()
    assert rows < 100 or not (kernels.bag_counts(np.arange(rows), rows, draws, 20, 8) == counts).all()


def test_draws_are_multinomial():
    """Means and variances over bags and rows, and independence of far blocks."""
    counts = kernels.bag_counts(np.arange(3000), 3000, 3000, 400, 1)
    assert abs(counts.mean() - 1) < 1e-12 and abs(counts.var() - (1 - 1 / 3000)) < 0.02
    first, last = counts[:1000].sum(axis=0), counts[2000:].sum(axis=0)
    assert abs(first.mean() - 1000) < 5 and abs(np.corrcoef(first, last)[0, 1] + 0.5) < 0.15


def test_bags_of_text_ids_read_one_table(spark, data):
    named = data.withColumn("id", F.concat(F.lit("row "), F.col("id")))
    rows = S.bag_weights(named, "id", 12, 0.5, 3)
    again = {r.id: r._bags for r in S.bag_weights(named.repartition(7), "id", 12, 0.5, 3).collect()}
    assert {r.id: r._bags for r in rows.collect()} == again
    assert np.array(list(again.values())).sum(axis=0).tolist() == [120] * 12
    assert len(again) == 240
    with pytest.raises(ValueError, match="must be a number"):
        S.kfold(named, 3, "id")


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_one_search_for_all_bags(data, monkeypatch, weights):
    """Thirty bags on subsets of features: boxes answer as the broadcast table does."""
    model = M.fit_model(spec("knn", max_samples=0.4, max_features=0.7, weights=weights), data, FEATURES, "y", "id")
    assert len(model.subsets) == 30
    asked = data.withColumn("wide", F.lit("x" * 50)).unionByName(data.limit(1).withColumns({"a": F.lit(None).cast("double"), "wide": F.lit("n"), "id": F.lit(-1).cast("long")}))
    small = {r.id: r.m for r in model.raw_members(asked, "m").collect()}
    monkeypatch.setattr(N, "BLOCK_ROWS", 40)
    model.limit = 0
    boxed = {r.id: r.m for r in model.raw_members(asked, "m").collect()}
    assert set(boxed) == set(small) and boxed[-1] is None and small[-1] is None
    for k in small:
        if k >= 0:
            assert np.allclose(small[k], boxed[k], atol=1e-12)


def test_search_moves_numbers_and_features_only(data, monkeypatch):
    """Of a file table nothing is written but row numbers and features, and no other column is shuffled."""
    made = []
    keep = N.stored
    monkeypatch.setattr(N, "stored", lambda df, name="table": made.append(df.columns) or keep(df, name))
    wide = data.withColumn("wide", F.lit("x"))
    found = N.knn_join(wide, wide, FEATURES, 2, "id", "id", exclude_self=True, limit=0)
    assert found.count() == 2 * data.count()
    assert made and not any("wide" in columns or "zone" in columns for columns in made)
    plan = N.with_neighbours(wide, wide, N.Space(FEATURES), 2, "id", "id", limit=0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_row_numbers_of_files(spark, data):
    one = identity.numbered_by_file(data, "_n")
    assert {(r.id, r._n) for r in one.collect()} == {(r.id, r._n) for r in one.repartition(9).collect()}
    assert one.select("_n").distinct().count() == 240
    some = identity.numbered_by_file(data.where("id % 7 = 0").withColumn("more", F.lit(1)), "_n")
    assert {r.id: r._n for r in some.collect()} == {r.id: r._n for r in one.where("id % 7 = 0").collect()}
    assert identity.numbered_by_file(data.unionByName(data), "_n") is None
    assert identity.numbered_by_file(data.join(data.select(F.col("id").alias("i")), F.col("id") == F.col("i")), "_n") is None
    assert identity.numbered_by_file(spark.range(3).withColumn("_metadata", F.lit(1)), "_n") is None
    assert identity.with_row_number(data.unionByName(data), "_n").select("_n").distinct().count() == 480
    assert identity.numbered_by_file(data.where("false"), "_n").count() == 0


def test_folds_are_read_by_folder(spark, data):
    folds, _ = T.fold_store(S.kfold(data, 3, "id"), None)
    plan = folds.where("fold = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan and "Window" not in plan
    assert folds.count() == 240


@pytest.mark.parametrize("metric", ["cosine", "correlation", "canberra", "chebyshev", 1.0, 3.0])
def test_named_distances_in_both_plans(spark, monkeypatch, metric):
    """Nearest rows and counts within a radius against all pairs; zero rows, constant rows, repeats."""
    rng = np.random.default_rng(8)
    points = np.round(rng.normal(size=(90, 3)), 1)
    points[:3], points[3:6], points[6] = 0.0, 2.0, points[7]
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(points)], "id long, a double, b double, c double")

    def unit(v):
        size = np.sqrt((v * v).sum(axis=1))
        return np.c_[v / np.where(size == 0, 1, size)[:, None], size == 0]

    def distances():
        gap = np.abs(points[:, None] - points[None])
        if metric in ("cosine", "correlation"):
            u = unit(points - (points.mean(axis=1, keepdims=True) if metric == "correlation" else 0))
            return ((u[:, None] - u[None]) ** 2).sum(axis=2) / 2
        if metric == "canberra":
            whole = np.abs(points[:, None]) + np.abs(points[None])
            return (gap / np.where(whole == 0, 1, whole)).sum(axis=2)
        return gap.max(axis=2) if metric == "chebyshev" else (gap**metric).sum(axis=2) ** (1 / metric)

    d = distances()
    if metric == "cosine":
        assert d[10, 11] == pytest.approx(1 - points[10] @ points[11] / np.linalg.norm(points[10]) / np.linalg.norm(points[11]))
        assert d[0, 1] == 0 and d[0, 10] == 1
    monkeypatch.setattr(N, "BLOCK_ROWS", 12)
    np.fill_diagonal(away := d.copy(), np.inf)
    for limit in (1 << 20, 0):
        got = {(r.id, r["rank"]): r.distance for r in N.knn_join(df, df, FEATURES, 4, "id", "id", metric, True, limit=limit).collect()}
        for k in range(90):
            assert np.allclose([got[k, r] for r in (1, 2, 3, 4)], np.sort(away[k])[:4], atol=1e-7)
        radius = float(np.quantile(d, 0.3)) + 1e-6
        near = N.with_count_within(df, df, N.Space(FEATURES, metric), radius, "id", "n", limit)
        assert {r.id: r.n for r in near.collect()} == {k: int((d[k] < radius).sum()) for k in range(90)}
    with pytest.raises(ValueError, match="unknown metric"):
        N.Space(FEATURES, "hamming").p


@pytest.mark.parametrize("p", [1.0, 2.0])
@pytest.mark.parametrize("exclude", [None, "fold"])
def test_sums_beyond_the_bound(spark, monkeypatch, p, exclude):
    """Sums over pairs without all pairs in a shuffle; repeats, null features, null folds."""
    rng = np.random.default_rng(5)
    rows = [(*map(float, rng.integers(0, 4, 2)), None if k % 11 == 0 else int(k % 3)) for k in range(70)] + [(None, 1.0, 1), (2.5, -1e6, None)]
    df = spark.createDataFrame(rows, "a double, b double, fold int").repartition(4)
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    total = positive = pairs = 0
    for a in rows:
        for b in rows:
            if None in (a[0], b[0]) or (exclude and a[2] is not None and a[2] == b[2]):
                continue
            d = (abs(a[0] - b[0]) ** p + abs(a[1] - b[1]) ** p) ** (1 / p)
            total, positive, pairs = total + d, positive + (d > 0), pairs + 1
    got = N.distance_sums(df, df, N.Space(["a", "b"], p, exclude), 0)
    assert got[0] == pytest.approx(total, rel=1e-12) and got[1:] == (positive, pairs)
    assert N.distance_sums(df.limit(0), df, N.Space(["a", "b"], p, exclude), 0) == (0.0, 0, 0)


def test_training_rows_without_a_scale(spark):
    from gridflow.operators.applicability import area_of_applicability

    df = spark.createDataFrame([(k, 1.0) for k in range(5)], "id long, a double")
    for limit in (1 << 20, 0):
        with pytest.raises(ValueError, match="no scale"):
            area_of_applicability(df, df, ["a"], "id", "id", limit=limit).count()
        with pytest.raises(ValueError, match="no complete training rows"):
            area_of_applicability(df, df.limit(0), ["a"], "id", "id", limit=limit)
    spread = df.withColumn("b", F.col("id") * 1.0)
    out = area_of_applicability(spread, spread, ["a", "b"], "id", "id", metric="cosine")
    assert out.where("aoa in (0, 1)").count() == 5
