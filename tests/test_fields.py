import math
import tempfile

import pytest
from pyspark.sql import functions as F, types as T

from gridflow.operators import community as CM, integrate as IN, joins as J, prepare as PR, regrid as RG
from gridflow.schema import KEYS, grid_schema
from gridflow.sources import readers, writers


def grid(spark, dims):
    axes = {"lat": [-0.5, 0.5], "lon": [0.0, 1.0, 2.0], "depth": [5.0, 15.0], "time": [1, 2]}
    df = spark.range(1).select(F.lit(2.0).alias("v"))
    for d in dims:
        df = df.withColumn(d, F.explode(F.array(*[F.lit(x) for x in axes[d]])))
    return df


@pytest.mark.parametrize("dims,total", [
    (["lat", "lon", "depth", "time"], 5934568315325.336),
    (["lat", "lon"], 148364207883.1334),
    (["lat", "depth"], 356074098919520.1),
    (["time"], 4.0),
])
def test_integration_goldens(spark, dims, total):
    got = IN.integrate_total(grid(spark, dims), "v", depth_w=10).first()["total"]
    assert math.isclose(got, total, rel_tol=1e-12)


def test_integration_rates_and_options(spark):
    df = grid(spark, KEYS)
    rate = IN.integrate_total(df, "v", depth_w=10, rate=True).first()["total"]
    assert math.isclose(rate, 175811586341513.06, rel_tol=1e-12)
    monthly = IN.integrate_total(df, "v", depth_w=10, rate=True, monthly=True).orderBy("time").collect()
    assert [r["time"] for r in monthly] == [1, 2]
    for r, want in zip(monthly, [91985808887542.7, 83825777453970.38]):
        assert math.isclose(r["total"], want, rel_tol=1e-12)
    full = IN.integrate_total(df, "v", depth_w=10).first()["total"]
    half = IN.integrate_total(df, "v", depth_w=10, subset_depth=5).first()["total"]
    mean = IN.integrate_total(df, "v", depth_w=10, time_reduce="mean").first()["total"]
    assert math.isclose(half, full / 2) and math.isclose(mean, full / 2)
    dated = df.withColumn("time", F.make_date(F.lit(2001), F.col("time"), F.lit(15)))
    assert math.isclose(IN.integrate_total(dated, "v", depth_w=10, rate=True).first()["total"], rate)
    with pytest.raises(ValueError):
        IN.integrate_total(df, "absent")
    totals, missing = IN.integrated_totals(CM.total(df, ["v"]), ["v", "w"], depth_w=10)
    assert missing == ["w"] and {r["variable"] for r in totals.collect()} == {"v", "total"}


def test_traits_by_name(spark):
    traits = spark.createDataFrame([("E. huxleyi", 0.5), ("C. pelagicus", 2.0), ("F. profunda", 3.0)], "Target string, poc double")
    names = ["C. pelagicus", "E. huxleyi", "F. profunda"]
    df = spark.createDataFrame([(1.0, 4.0, 10.0, 1.0)], ["lat", *names])
    assert tuple(CM.scale_by_trait(df, traits, "poc", names).first()) == (1.0, 8.0, 5.0, 3.0)
    with pytest.raises(ValueError):
        CM.scale_by_trait(df.withColumn("x", F.lit(1.0)), traits, "poc", [*names, "x"])
    with pytest.raises(ValueError):
        CM.sum_groups(df, {"E. huxleyi": "F. profunda"})
    groups = {n: ("a" if n[0] == "C" else "b") for n in names}
    row = CM.total(CM.sum_groups(df, groups), names).first()
    assert row["total"] == row["a"] + row["b"] == 15.0


def test_seasonal_gaps_fixture(spark):
    df = spark.createDataFrame([(0.0, 1, 10.0), (0.0, 2, 8.0), (0.0, 4, 5.0), (1.0, 1, None)], "lat double, time int, v double")
    rows = PR.fill_seasonal_gaps(df, "v", periods=4).orderBy("lat", "time").collect()
    assert [r["v"] for r in rows] == [10.0, 8.0, 1.0, 5.0, None, None, None, None]


def test_impute_uses_region_then_global(spark):
    df = spark.createDataFrame([(1, 10.0, 1.0, "a"), (2, 10.0, None, "a"), (3, 10.0, 3.0, "b"), (4, 10.0, None, "c"), (5, 10.0, None, None)],
                               "id int, v double, sd double, region string")
    rows = PR.impute_sd(df, "v", "sd", "region").orderBy("id").collect()
    assert [r["sd"] for r in rows] == [1.0, 1.0, 3.0, 2.0, 2.0]


def test_filters(spark):
    df = spark.createDataFrame([(1, "Diff", 4.0, 1.0), (2, None, 1.0, 0.0), (3, "x", 1.0, None), (4, "x", 3.0, 1.0)],
                               "id int, m string, a double, b double")
    assert [r["id"] for r in PR.exclude(df, "m", ["Diff"]).orderBy("id").collect()] == [2, 3, 4]
    assert [r["id"] for r in PR.drop_ratio_above(df, F.col("a"), F.col("b"), 3.5).orderBy("id").collect()] == [3, 4]
    assert PR.drop_missing(df).count() == 2 and PR.drop_missing(df, ["m"]).count() == 3


def test_depth_interpolation_fixture(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0), (0.0, 10.0, 20.0), (0.0, 30.0, 0.0)], "lat double, depth double, v double")
    got = {r["depth"]: r["v"] for r in RG.interp_depth(df, "v", [5.0, 20.0, 25.0, 35.0]).collect()}
    assert got == {5.0: 15.0, 20.0: 10.0, 25.0: 5.0}


def test_depth_interpolation_of_a_long_profile(spark):
    """Many points in one profile give the same as the points around each level."""
    df = spark.range(5000).select(F.lit(1.0).alias("lat"), (F.col("id") * 0.05).alias("depth"), F.sin(F.col("id") / 300).alias("v"))
    got = {r["depth"]: r["v"] for r in RG.interp_depth(df, "v", [0.0, 12.34, 100.0, 249.95, 260.0]).collect()}
    assert sorted(got) == [0.0, 12.34, 100.0, 249.95]
    for level, v in got.items():
        i = level / 0.05
        low = math.floor(i)
        want = math.sin(low / 300) + (i - low) * (math.sin((low + 1) / 300) - math.sin(low / 300))
        assert math.isclose(v, want, abs_tol=1e-9)


def constant(spark, g, value=3.0):
    return spark.range(g.lat.n * g.lon.n).select(
        (F.floor(F.col("id") / g.lon.n) * g.lat.step + g.lat.start).alias("lat"),
        (F.col("id") % g.lon.n * g.lon.step + g.lon.start).alias("lon"), F.lit(value).alias("v"))


@pytest.mark.parametrize("step", [0.5, 2.5, 7.2])
def test_regrid_of_a_constant(spark, step):
    g = RG.Grid(RG.Axis(-90 + step / 2, step, round(180 / step)), RG.Axis(-180 + step / 2, step, round(360 / step)))
    out = RG.regrid_conservative(constant(spark, g), "v", g)
    low, high, n = out.agg(F.min("v"), F.max("v"), F.count("v")).first()
    assert math.isclose(low, 3.0) and math.isclose(high, 3.0) and n == 180 * 360


def test_regrid_keeps_the_area_integral(spark):
    g = RG.Grid(RG.Axis(-89.0, 2.0, 90), RG.Axis(-179.0, 2.0, 180))
    field = constant(spark, g).withColumn("v", F.abs(F.hash("lat", "lon")) % 1000 / 10.0)
    out = RG.regrid_conservative(field, "v", g)
    # the target's last row of cells ends at 89.5: its missing strip is compared separately
    source = field.agg(F.sum(F.col("v") * RG.grid_area(g, F.col("lat")))).first()[0]
    target = out.agg(F.sum(F.col("v") * RG.grid_area(RG.ONE_DEGREE, F.col("lat")))).first()[0]
    top = field.where("lat = 89").agg(F.avg("v")).first()[0]
    strip = (1 - math.sin(math.radians(89.5))) * 2 * math.pi * top
    assert math.isclose(source, target + strip, rel_tol=1e-9)


def test_regrid_missing_share(spark):
    g = RG.Grid(RG.Axis(-89.75, 0.5, 360), RG.Axis(-179.75, 0.5, 720))
    whole = constant(spark, g)
    holed = whole.withColumn("v", F.when((F.col("lon") == 10.25) | (F.col("lat") == 5.25), None).otherwise(F.col("v")))
    loose = RG.regrid_conservative(holed, "v", g).where("v is null").count()
    strict = RG.regrid_conservative(holed, "v", g, skipna=False).where("v is null").count()
    assert loose == 0 and strict == 180 + 360 - 1


def test_bilinear_of_a_linear_field(spark):
    g = RG.Grid(RG.Axis(-88.0, 4.0, 45), RG.Axis(-178.0, 4.0, 90))
    out = RG.regrid_bilinear(constant(spark, g).withColumn("v", F.col("lat") * 2 + 1), "v", g).where("v is not null")
    assert out.where(F.abs(F.col("v") - (F.col("lat") * 2 + 1)) > 1e-9).isEmpty()
    assert out.count() == (88 + 88 + 1) * 360


def test_densify(spark):
    df = spark.createDataFrame([(0.0, 1, 5.0), (1.0, 2, 6.0)], "lat double, time int, v double")
    rows = PR.densify(df).orderBy("lat", "time").collect()
    assert [tuple(r) for r in rows] == [(0.0, 1, 5.0), (0.0, 2, None), (1.0, 1, None), (1.0, 2, 6.0)]


def test_same_answer_for_one_and_many_partitions(spark):
    df = spark.range(3000).select((F.col("id") % 10).cast("double").alias("lat"), (F.col("id") % 7).cast("double").alias("depth"),
                                  (F.col("id") % 12 + 1).cast("int").alias("time"), F.col("id").cast("double").alias("v"))
    one, many = df.coalesce(1), df.repartition(16)
    for f in (lambda d: PR.grid_mean(d, ["lat", "depth", "time"]), lambda d: PR.fill_seasonal_gaps(PR.grid_mean(d, ["lat", "time"], ["v"]), "v"),
              lambda d: IN.integrate_totals(d, ["v"], monthly=True, magnitude_conversion=1e-16)):
        a, b = ([tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in f(d).collect()] for d in (one, many))
        assert sorted(a, key=str) == sorted(b, key=str)


def test_sources_and_sinks(spark):
    root = tempfile.mkdtemp()
    with open(f"{root}/raw.csv", "w") as f:
        f.write("Latitude,Longitude,Value\n1.5,2.5,3.0\n4.5,5.5,NaN\n")
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in ("lat", "lon", "v")])
    rows = readers.read_observations(spark, f"{root}/raw.csv", schema).orderBy("lat").collect()
    assert [tuple(r) for r in rows] == [(1.5, 2.5, 3.0), (4.5, 5.5, None)]
    with pytest.raises(Exception):
        readers.read_observations(spark, f"{root}/raw.csv", schema, by_name=True).collect()
    df = grid(spark, KEYS).withColumn("name", F.lit("x"))
    writers.write_field(df, f"{root}/field", {"v": {"units": "mol"}}, author="A", description="D")
    back = spark.read.parquet(f"{root}/field")
    assert back.count() == df.count()
    meta = {f.name: f.metadata for f in back.schema.fields}
    assert meta["v"]["units"] == "mol" and meta["lat"]["units"] == "degrees_north"
    with pytest.raises(ValueError):
        readers.read_env(spark, f"{root}/field", ["absent"])
    writers.write_csv(df, f"{root}/field.csv")
    assert readers.read_env(spark, f"{root}/field.csv", ["v"]).schema == grid_schema(["v"])
    with open(f"{root}/traits.csv", "w") as f:
        f.write("Target,pg poc,pg pic\nEmiliania huxleyi,0.5,1\n")
    assert tuple(readers.read_traits(spark, f"{root}/traits.csv", ["pg pic"]).first()) == ("Emiliania huxleyi", 1.0)
    with pytest.raises(ValueError):
        readers.select_statistic(spark.createDataFrame([("ens", "t")], "model string, target string"), "ens", "median")


def test_residuals_without_prediction(spark):
    obs = spark.createDataFrame([(1.0, 5.0), (2.0, 6.0)], "lat double, t double")
    pred = spark.createDataFrame([(1.0, 4.0)], "lat double, t double")
    rows = J.residuals(pred, obs, ["t"], ["lat"]).orderBy("lat").collect()
    assert [tuple(r) for r in rows] == [(1.0, 5.0, 4.0, 1.0), (2.0, 6.0, None, None)]
