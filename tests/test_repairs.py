"""Cases in which rows were once lost, merged or confused."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridflow.operators import community, joins, models, prepare, sampling, tuning
from gridflow.sources import readers, writers


@pytest.mark.parametrize("n", [1, 60, 61, 100])
def test_any_number_of_grids(spark, n):
    frames = {
        f"v{i}": spark.range(5).where(F.col("id") != i % 7).select(F.col("id").cast("double").alias("lat"), F.lit(float(i)).alias(f"v{i}"))
        for i in range(n)
    }
    got = joins.align_env(frames, ["lat"])
    missing = {i % 7 for i in range(n)}
    assert sorted(r["lat"] for r in got.collect()) == [float(k) for k in range(5) if k not in missing]
    assert len(got.columns) == n + 1


def test_null_groups_keep_their_rows(spark):
    df = spark.range(12).select(
        "id", F.when(F.col("id") < 4, F.lit(None)).otherwise(F.lit("g")).alias("g"), (F.col("id") % 3).cast("double").alias("y")
    )
    for folded in (sampling.kfold(df, 3, "id", by=["g"]), sampling.zero_stratified_kfold(df, "y", 3, "id", by=["g"])):
        assert folded.count() == 12
        assert folded.where("g is null").select("fold").distinct().count() >= 2
    up = sampling.upsample(df, "y", "id", ratio=2, seed=1, by=["g"])
    sizes = {(r["g"], r["p"]): r["count"] for r in up.groupBy("g", (F.col("y") > 0).alias("p")).count().collect()}
    assert sizes[None, False] == 2 * sizes[None, True] and sizes["g", False] == 2 * sizes["g", True]
    rows, training = sampling.upsampled_folds(df, "y", 2, "id", seed=1, by=["g"])
    assert rows.count() == 12 and training.where("g is null").count() > 0


def test_traits_by_name(spark):
    one = spark.createDataFrame([("a", 2.0), ("b", 3.0)], "Target string, t double")
    twice = one.unionByName(spark.createDataFrame([("a", 5.0)] * 3, "Target string, t double"))
    assert community.trait_values(one, ["a", "b"], "t") == {"a": 2.0, "b": 3.0}
    with pytest.raises(ValueError, match="more than one"):
        community.trait_values(twice, ["a", "b"], "t")
    with pytest.raises(ValueError, match="no 't'"):
        community.trait_values(one, ["a", "c"], "t")
    long = spark.createDataFrame([(1.0, "a", 4.0), (1.0, "b", None)], "lat double, target string, value double")
    assert sorted(r["value"] or 0 for r in community.scale_by_trait_long(long, one, "t").collect()) == [0, 8.0]
    with pytest.raises(Exception, match="more than one"):
        community.scale_by_trait_long(long, twice, "t").collect()
    with pytest.raises(Exception, match="no 't'"):
        community.scale_by_trait_long(long, one.where("Target = 'b'"), "t").collect()


def test_dense_grid(spark):
    df = spark.createDataFrame([(1.0, 10.0, 1, 5.0), (2.0, 20.0, 3, None)], "lat double, depth double, time int, v double")
    got = prepare.densify(df)
    assert got.count() == 8 and got.where("v is not null").count() == 1
    assert prepare.densify(df.limit(0)).count() == 0


def test_attributes_of_folders(spark, tmp_path):
    df = spark.createDataFrame([("t", 1.0, 1, 2.0)], "target string, lat double, time int, v double")
    writers.write_field(df, str(tmp_path / "f"), {"v": {"units": "1"}}, author="me", description="what")
    found = writers.read_attributes(spark, str(tmp_path / "f"))
    assert found["time"]["units"] == "months" and found["v"]["units"] == "1"
    assert found["target"]["table"]["creator_name"] == "me" and found["target"]["table"]["description"] == "what"
    assert readers.read_table(spark, str(tmp_path / "f"), ["target", "lat", "v"]).count() == 1


def test_own_exports_can_be_read(spark, tmp_path):
    df = spark.createDataFrame([(1.5, 2, 3.25), (float("nan"), 1, None)], "lat double, time int, v double")
    writers.write_csv(df, str(tmp_path / "export"))
    back = readers.read_env(spark, str(tmp_path / "export"), ["v"], ["lat", "time"], format="csv")
    assert sorted(back.collect(), key=lambda r: r["time"])[1] == (1.5, 2, 3.25)
    with pytest.raises(ValueError, match="format"):
        readers.read_table(spark, "x", ["a"], format="xml")


def test_parameters_are_read_or_refused(spark):
    df = spark.range(40).select("id", (F.col("id") % 4).cast("double").alias("a"), (F.col("id") % 4).cast("double").alias("y"))
    with pytest.raises(ValueError, match="n_estimator"):
        models.fit_model(models.ModelSpec("rf", "reg", {"n_estimator": 3}), df, ["a"], "y", "id")
    with pytest.warns(UserWarning, match="becomes 30"):
        fitted = models.fit_model(models.ModelSpec("rf", "reg", {"n_estimators": 2, "max_depth": 75}), df, ["a"], "y", "id")
    assert fitted.spec.params["max_depth"] == 30
    assert models._share(1, 40, 1.0) == 1 / 40 and models._share(1.0, 40, 1.0) == 1.0
    boosted = models.fit_model(models.ModelSpec("xgb", "reg", {"n_estimators": 1, "reg_alpha": 0.1}), df, ["a"], "y", "id")
    with pytest.raises(ValueError, match="fit_bags"):
        boosted.members(df)
    with pytest.raises(ValueError, match="more than 2"):
        models.one_hot(df, "a", 2)


def test_equal_candidates_are_fitted_once(spark):
    df = spark.range(60).select("id", (F.col("id") % 4).cast("double").alias("a"), (F.col("id") % 4).cast("double").alias("y"))
    folds = sampling.kfold(df, 2, "id")
    spec = models.ModelSpec("rf", "reg", {"n_estimators": 2})
    best, table = tuning.grid_search(spec, {"max_depth": [2, 51, 75]}, folds, 2, ["a"], "y", "id", scoring="RMSE")
    assert [t["params"]["max_depth"] for t in table] == [2, 30] and all(t["score"] <= 0 for t in table)
    with pytest.raises(ValueError, match="unknown score"):
        tuning.grid_search(spec, {}, folds, 2, ["a"], "y", "id", scoring="F1")


def test_neighbours_of_rows_that_differ_in_nulls_only(spark):
    """Row identity is a number: rows with nulls in different places don't share an answer."""
    known = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 5.0, 5.0, 9.0)], "id long, a double, b double, y double")
    asked = spark.createDataFrame(
        [(7, None, 3.0, "t"), (7, 3.0, None, "t"), (7, 0.1, 0.1, None), (7, 0.1, 0.1, "t"), (7, 5.0, 4.0, None)],
        "id long, a double, b double, note string",
    )
    for limit in (models.BROADCAST_BYTES, 0):
        model = models.fit_model(models.ModelSpec("knn", "reg", {"n_neighbors": 1}, bags=0), known, ["a", "b"], "y", "id")
        model.limit = limit
        got = sorted((r["p"] is None, r["p"] or 0) for r in model.predict(asked, "p").collect())
        assert got == [(False, 1.0), (False, 1.0), (False, 9.0), (True, 0), (True, 0)]


def test_redrawn_rows_beyond_the_first_thousand_partitions(spark):
    """Row numbers of late partitions are large; copies of drawn rows are numbered without products."""
    rows = spark.range(30).select(
        (F.col("id") + (1100 << 33)).alias("id"), F.col("id").cast("double").alias("a"), F.col("id").cast("double").alias("y"),
        (F.col("id") % 3).alias("weight"),
    )
    spec = models.ModelSpec("knn", "reg", {"n_neighbors": 1, "max_samples": 1.0}, seed=1, bags=2)
    for limit in (models.BROADCAST_BYTES, 0):
        model = models.fit_model(spec, rows, ["a"], "y", "id", weight="weight")
        model.limit = limit
        p = [r["p"] for r in model.predict(rows, "p").collect()]
        assert len(p) == 30 and not any(v is None or np.isnan(v) for v in p)


def test_pseudo_zeros_from_a_large_mask(spark):
    """The bound on hashes, applied before numbering, chooses the same cells as numbering them all."""
    mask = spark.range(6000).select(F.col("id").cast("double").alias("lat"), (F.col("id") % 2).alias("mask"))
    obs = spark.createDataFrame([(0.5, 7.0)], "lat double, y double")
    got = sampling.add_pseudo_zeros(obs, mask, obs.agg(F.count("*") * 100).scalar(), ["y"], 3)
    assert got.count() == 101 and got.where("y = 0 and lat % 2 = 1").count() == 0
    every = sampling.with_random_index(mask.where("mask = 0").select("lat"), ["lat"], 3).where("idx < 100")
    assert {r["lat"] for r in got.where("y = 0").collect()} == {r["lat"] for r in every.collect()}
    assert sampling.add_pseudo_zeros(obs, mask, 5000, ["y"], 3).count() == 3001
