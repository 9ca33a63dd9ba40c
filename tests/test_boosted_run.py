import tempfile

from pyspark.sql import functions as F

from gridflow.operators.sampling import example_data
from gridflow.plans.config import Config
from gridflow.plans.prediction import Predictor
from gridflow.plans.training import Tuner


def test_one_boosted_model_with_upsampled_folds(spark):
    """A single two-phase model: no ensemble, bagged copies as interval members."""
    settings = {
        "root": tempfile.mkdtemp(), "path_out": "out", "run_name": "run", "predictors": ["feature_1", "feature_2"],
        "seed": 1, "cv": 2, "stratify": True, "upsample": True, "n_threads": 2, "interval_bags": 2,
        "ensemble_config": {"classifier": True, "regressor": True, "m1": "xgb"},
        "param_grid": {"xgb_param_grid": {"reg_param_grid": {"n_estimators": [2], "max_depth": [2]},
                                          "clf_param_grid": {"n_estimators": [2], "max_depth": [2]}}},
    }
    config = Config.of(settings)
    train, grid = example_data(spark, "t", 150, 2)
    train, grid = train.persist(), grid.persist()
    scores = Tuner(train, "t", config).train("xgb", "both")
    assert {r[0] for r in scores.select("part").distinct().collect()} == {"reg", "clf", "zir"}
    table = Predictor(train, "t", grid, config).make_prediction()
    assert {tuple(r) for r in table.select("model", "part").distinct().collect()} == {("xgb", p) for p in ("zir", "clf", "reg")}
    assert table.where("part = 'zir' and (mean is null or mean < 0 or ci95_LL > ci95_UL)").isEmpty()
