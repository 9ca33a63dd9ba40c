import math
import tempfile

import pytest
from pyspark.sql import functions as F

from gridflow.operators import regrid as RG
from gridflow.operators.sampling import example_data
from gridflow.plans.config import Config
from gridflow.plans.post import Post
from gridflow.plans.prediction import Predictor
from gridflow.plans.preparation import (
    environment_table, nutrient_field, resampled_observations, surface_field, training_table,
)
from gridflow.plans.training import Tuner, read_scores
from gridflow.schema import KEYS

TARGET = "Emiliania huxleyi"


def settings(root, classifier):
    grids = {
        "rf_param_grid": {"reg_param_grid": {"n_estimators": [5], "max_depth": [4]},
                          "clf_param_grid": {"n_estimators": [5], "max_depth": [4]}},
        "knn_param_grid": {"reg_param_grid": {"max_samples": [0.5], "max_features": [0.7], "estimator__n_neighbors": [3]},
                           "clf_param_grid": {"max_samples": [0.5], "max_features": [0.7], "estimator__n_neighbors": [3]}},
    }
    return Config.of({
        "root": root, "path_out": "out", "run_name": "run", "predictors": ["feature_1", "feature_2", "feature_3"],
        "seed": 1, "cv": 2, "stratify": classifier, "upsample": False, "n_threads": 2,
        "ensemble_config": {"classifier": classifier, "regressor": True, "m1": "rf", "m2": "knn"},
        "param_grid": grids, "knn_bagging_estimators": 3,
    })


@pytest.mark.parametrize("two_phase", [False, True])
def test_whole_run(spark, two_phase):
    config = settings(tempfile.mkdtemp(), two_phase)
    train, grid = example_data(spark, TARGET, 200, 3)
    train, grid = train.persist(), grid.persist()
    tuner = Tuner(train, TARGET, config)
    for model in config.models:
        tuner.train(model, log="yes")
    table = Predictor(train, TARGET, grid, config).make_prediction()
    final = "zir" if two_phase else "final"
    rows = table.where(F.col("part") == final)
    assert rows.groupBy("model").count().where("count <> 60").isEmpty()
    assert {r[0] for r in rows.select("model").distinct().collect()} == {"rf", "knn", "ens"}
    assert rows.where("ci95_LL > ci95_UL or mean < 0 or mean is null").isEmpty()
    part = "zir" if two_phase else "reg"
    scored = read_scores(spark, config.path).where(F.col("part") == part)
    assert scored.where("metric = 'R2'").groupBy("model").count().count() == 3

    traits = spark.createDataFrame([(TARGET, 0.5)], "Target string, `pg poc` double")
    post = Post(spark, config, [TARGET], traits)
    report = post.performance()
    assert report.count() == 3 and report.where("MAE <= 0 or rMAE is null").isEmpty()
    assert "reg_max_depth" in post.parameters("rf").columns
    before = post.d.agg(F.sum(f"`{TARGET}`")).first()[0]
    post.estimate_carbon("pg poc").total()
    assert math.isclose(post.d.agg(F.sum("total")).first()[0], before / 2, rel_tol=1e-9)
    joined = post.merge_env(grid).d
    assert joined.count() == 60 and "feature_1" in joined.columns
    post.process_resampled_runs()  # one target has no spread, so this comes after the complete rows
    obs = post.merge_obs(train.limit(5), "check")
    assert obs.count() == 5
    post.export_field("field", author="a", description="d")
    post.export_csv("field")
    totals = post.integrated_totals([TARGET, "absent"], monthly=False)
    assert {r["variable"] for r in totals.collect()} >= {TARGET, "total", "mean"}
    if not two_phase:
        aoa = post.estimate_applicability(train, grid, repeats=2, return_all=True)
        assert aoa.count() == 60 and aoa.where(F.col(f"`{TARGET}_di`").isNull()).isEmpty()


def test_preparation(spark):
    raw = spark.range(400).select(
        (F.col("id") % 7 + 0.5).cast("double").alias("Latitude"), (F.col("id") % 5 + 0.5).cast("double").alias("Longitude"),
        F.lit(3.0).alias("Depth"), F.lit("05/03/2010").alias("Date"),
        F.when(F.col("id") % 10 == 0, "Diff").otherwise("14C").alias("Method"),
        (F.col("id") % 50 + 1).cast("double").alias("v"),
        F.when(F.col("id") % 3 != 0, 0.1).alias("sd"), F.lit("A").alias("region"), F.lit(100.0).alias("cells"))
    cells = resampled_observations(raw, "v", "sd", "region", exclude_methods=["Diff"], ratio=("cells", 3.5), upper=1000, resamples=4)
    assert cells.count() == 35 and cells.where("time <> 3 or depth <> 0").isEmpty()
    assert cells.agg(F.max(F.abs(F.col("sample_1") - F.col("v")))).first()[0] < 20
    env = spark.range(40).select(*[F.lit(0.0).alias(k) if k in ("depth",) else F.col("id").cast("double").alias(k) for k in ["lat", "lon", "depth"]],
                                 F.lit(3).alias("time"), F.col("id").cast("double").alias("t"))
    table = training_table(cells, env, ["t"])
    assert table.count() == 5 and "sample_4" in table.columns


def test_environment(spark):
    grid = RG.Grid(RG.Axis(-87.5, 5.0, 36), RG.Axis(-177.5, 5.0, 72))
    column = spark.range(36 * 72).select(
        (F.floor(F.col("id") / 72) * 5 - 87.5).alias("lat"), (F.col("id") % 72 * 5 - 177.5).alias("lon"), F.lit(1).alias("time"))
    profile = column.withColumn("depth", F.explode(F.array(F.lit(0.0), F.lit(10.0), F.lit(300.0)))).withColumn("no3", F.lit(4.0))
    no3 = nutrient_field(profile, "no3", grid, [0.0, 5.0, 10.0])
    stats = no3.agg(F.min("no3"), F.max("no3"), F.count("*")).first()
    assert math.isclose(stats[0], 4.0) and math.isclose(stats[1], 4.0) and stats[2] == 180 * 360 * 3
    chl = surface_field(column.withColumn("chl", F.lit(2.0)), "chl", grid, [0.0, 5.0, 10.0], fill_gaps=True)
    merged = environment_table({"no3": no3, "chl": chl}, None)
    assert merged.where("abs(chl - 2.0) > 1e-9 and abs(chl - 0.2) > 1e-9").isEmpty() and merged.count() > 100000
