import math

from pyspark.sql import functions as F

from gridflow.operators import metrics as M, sampling as S


def by_id(df, name="fold"):
    return [r[name] for r in df.orderBy("id").collect()]


def test_kfold_fixture(spark):
    df = spark.range(7)
    assert by_id(S.kfold(df, 3, "id")) == [0, 0, 0, 1, 1, 2, 2]


def test_zero_stratified_fixture(spark):
    rows = list(enumerate([1, 0, 1, 1, 0, 1, 1]))
    df = spark.createDataFrame([(i, float(v)) for i, v in rows], "id long, y double")
    got = by_id(S.zero_stratified_kfold(df, "y", 3, "id"))
    assert [got[i] for i in (0, 2, 3, 5, 6)] == [0, 0, 1, 1, 2]
    assert [got[i] for i in (1, 4)] == [0, 2]


def test_zero_stratified_equals_plain_without_zeros(spark):
    df = spark.range(23).withColumn("y", F.lit(1.0))
    assert by_id(S.zero_stratified_kfold(df, "y", 4, "id")) == by_id(S.kfold(df, 4, "id"))


def test_folds_are_balanced_per_class_and_group(spark):
    df = spark.range(1000).withColumn("y", F.when(F.col("id") % 3 == 0, 0.0).otherwise(2.0))
    df = df.withColumn("target", F.when(F.col("id") < 700, "a").otherwise("b"))
    folds = S.zero_stratified_kfold(df, "y", 7, "id", by=["target"])
    sizes = folds.groupBy("target", "y", "fold").count()
    spread = sizes.groupBy("target", "y").agg((F.max("count") - F.min("count")).alias("d"))
    assert max(r["d"] for r in spread.collect()) <= 1
    assert folds.count() == 1000 and folds.select("id").distinct().count() == 1000


def test_index_is_dense_with_skewed_groups(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50))
    got = S.with_index(df, "id", by=["g"]).groupBy("g").agg(
        F.count("*").alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi"),
        F.count_distinct("idx").alias("d"), F.max("_n").alias("size"))
    for r in got.collect():
        assert r["lo"] == 0 and r["hi"] == r["n"] - 1 and r["d"] == r["n"] == r["size"]


def test_random_index_same_for_any_partitioning(spark):
    pick = lambda n: by_id(S.with_random_index(spark.range(999, numPartitions=n), ["id"], 3), "idx")
    one = pick(1)
    assert one == pick(16) and sorted(one) == list(range(999)) and one != list(range(999))


def test_prefix_sum_and_quantiles(spark):
    df = spark.range(1, 1001).withColumn("v", F.col("id") * 2)
    got = S.prefix_sum(df, "id", ["v"]).orderBy("id").collect()
    assert [r["v_cum"] for r in got] == [i * (i + 1) for i in range(1, 1001)]
    down = S.prefix_sum(df, "id", ["v"], descending=True).where("id = 1000").collect()
    assert down[0]["v_cum"] == 2000
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("x"))
    exact = hot.agg(F.percentile("x", [0.1, 0.5, 0.9, 0.0025]).alias("q")).first()["q"]
    assert S.exact_quantiles(hot, "x", [0.1, 0.5, 0.9, 0.0025]) == exact


def test_upsample_counts(spark):
    df = spark.range(10).withColumn("y", F.when(F.col("id") < 3, 5.0).otherwise(0.0))
    up = S.upsample(df, "y", "id", ratio=10, seed=1)
    assert up.where("y = 0").count() == 30 and up.where("y > 0").count() == 3


def test_upsampled_folds_counts(spark):
    df = spark.range(15).withColumn("y", F.when(F.col("id") % 5 < 2, 0.0).otherwise(1.0))
    tests, training = S.upsampled_folds(df, "y", 3, "id", seed=4)
    assert tests.groupBy("id").count().where("count <> 1").count() == 0
    held = {r["id"]: r["fold"] for r in tests.collect()}
    sums = training.groupBy("split", (F.col("y") > 0).alias("p")).agg(F.sum("weight").alias("w")).collect()
    weights = {(r["split"], r["p"]): r["w"] for r in sums}
    for split in range(3):
        zeros = sum(1 for i, f in held.items() if f != split and i % 5 < 2)
        assert weights[split, False] == weights[split, True] == zeros
    assert all(held[r["id"]] != r["split"] for r in training.collect())


def test_bags(spark):
    bags = S.make_bags(spark.range(100), "id", 4, 0.5, 9)
    got = {r["bag"]: r["w"] for r in bags.groupBy("bag").agg(F.sum("weight").alias("w")).collect()}
    assert got == {0: 50, 1: 50, 2: 50, 3: 50}
    subsets = S.bag_features(4, ["a", "b", "c", "d"], 0.5, 9)
    assert all(len(s) == 2 == len(set(s)) for s in subsets)


def test_resample_normal(spark):
    df = spark.range(2000).select("id", F.lit(5.0).alias("v"), F.lit(1.0).alias("se"))
    wide = S.resample_normal(df, "v", "se", 3, 11, ["id"])
    stats = wide.agg(F.avg("sample_1"), F.stddev("sample_2"), F.min("sample_3"), F.corr("sample_1", "sample_2")).first()
    assert abs(stats[0] - 5) < 0.1 and abs(stats[1] - 1) < 0.1 and stats[2] >= 0 and abs(stats[3]) < 0.1
    long = S.resample_normal(df, "v", "se", 3, 11, ["id"], long=True)
    pair = long.where("target = 'sample_2'").join(wide, "id").where("abs(value - sample_2) > 1e-12")
    assert long.count() == 6000 and pair.count() == 0


def test_pseudo_zeros(spark):
    mask = spark.range(100).select(
        (F.col("id") % 10).cast("double").alias("lat"), F.floor(F.col("id") / 10).cast("double").alias("lon"),
        (F.col("id") % 3 == 0).cast("int").alias("mask"))
    obs = spark.createDataFrame([(1.0, 2.0, 9.0)], "lat double, lon double, y double")
    out = S.add_pseudo_zeros(obs, mask, 17, ["y"], 5)
    assert out.count() == 18 and out.where("y = 0").distinct().count() == 17
    bad = out.where("y = 0").join(mask.where("mask = 1"), ["lat", "lon"])
    assert bad.count() == 0


def test_example_data(spark):
    train, predict = S.example_data(spark, "Emiliania huxleyi", 1000, 3)
    y = F.col("`Emiliania huxleyi`")
    counts = train.agg(F.count_if(y > 0).alias("p"), F.count_if(y == 0).alias("z"), F.min(y).alias("m")).first()
    assert counts["z"] == int(0.5 * counts["p"]) and counts["m"] >= 0 and predict.count() == 300
    keys = ["lat", "lon", "depth", "time"]
    assert train.select(*keys).distinct().count() == train.count()
    assert train.where("time < 1 or time > 12 or lat < -90 or lat > 90 or lon > 180 or depth > 200").count() == 0


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "y double, p double")
    r = M.regression_metrics(df, "y", "p", relative=True).first()
    assert math.isclose(r["R2"], 1 - 1.25 / (14 / 3)) and math.isclose(r["MAE"], 0.5)
    assert math.isclose(r["RMSE"], math.sqrt(1.25 / 3)) and math.isclose(r["rMAE"], 0.5 / (7 / 3))


def test_balanced_accuracy(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (1, 1), (0, 0), (0, 1)], "y int, p int")
    assert M.balanced_accuracy(df, "y", "p").first()[0] == (0.75 + 0.5) / 2


def test_youden_fixture(spark):
    rows = [(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 1), (0.4, 0), (0.2, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    assert M.youden_threshold(df, "s", "y").first()["threshold"] == 0.6
    none = spark.createDataFrame([(0.9, 0), (0.1, 1)], "s double, y int")
    assert M.youden_threshold(none, "s", "y").first()["threshold"] == math.inf


def test_performance_summary(spark):
    folds = spark.createDataFrame([(0, 0.5, 1.0, 2.0), (1, 0.7, 3.0, 4.0)], "fold int, R2 double, MAE double, RMSE double")
    scores = M.scores_long(folds, "rf", "t")
    assert scores.where("metric = 'MAE' and value > 0").count() == 0
    means = spark.createDataFrame([("t", 4.0)], "target string, mean_field double")
    r = M.summarise_performance(scores, means).first()
    assert math.isclose(r["R2"], 0.6) and (r["MAE"], r["RMSE"], r["rMAE"], r["rRMSE"]) == (2.0, 3.0, 0.5, 0.75)
