import math

from pyspark.sql import functions as F

from gridflow.functions import columns as C, hashing as H, rows as R


def values(df, name="v"):
    return [r[name] for r in df.collect()]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_bins(spark):
    df = frame(spark, [(0.0,), (5.0,), (5.1,), (205.0,), (206.0,)], "x double")
    got = values(df.select(C.bin_left(F.col("x"), 0, 5, 41).alias("v")))
    assert got == [None, 0.0, 5.0, 200.0, None]
    assert values(df.select(C.bin_left(F.col("x"), 0, 5, 41, True).alias("v")))[0] == 0.0
    lat = frame(spark, [(-90.0,), (-89.5,), (90.0,)], "x double")
    assert values(lat.select(C.bin_left(F.col("x"), -90, 1, 180).alias("v"))) == [None, -90.0, 89.0]


def test_species_and_ids(spark):
    df = frame(spark, [("emiliania huxleyi",), ("Other",), ("a  b c",), (None,)], "x string")
    got = values(df.select(C.abbreviate_species(F.col("x")).alias("v")))
    assert got == ["E. huxleyi", "Other", "A. b c", None]
    assert values(df.select(C.target_id(F.col("x")).alias("v")))[0] == "emiliania_huxleyi"


def test_dates(spark):
    df = frame(spark, [("03/02/2010", 0), ("28/12/1999", 45)], "d string, n int")
    assert values(df.select(C.month_of(F.col("d"), "dd/MM/yyyy").alias("v"))) == [2, 12]
    assert values(df.select(C.year_of(F.col("d"), "dd/MM/yyyy").alias("v"))) == [2010, 1999]
    assert values(df.select(C.month_from_days(F.col("n")).alias("v"))) == [1, 2]
    months = frame(spark, [(m,) for m in range(1, 13)], "m int")
    assert sum(values(months.select(C.days_in_month(F.col("m")).alias("v")))) == 365.25


def test_presence(spark):
    df = frame(spark, [(0.0,), (2.0,), (None,)], "y double")
    assert values(df.select(C.presence_label(F.col("y")).alias("v"))) == [0, 1, None]


def test_totals_and_groups(spark):
    df = frame(spark, [(0.0, 0.0), (None, None), (1.0, None)], "a double, b double")
    cols = [F.col("a"), F.col("b")]
    total, log = R.total_and_log(cols)
    got = df.select(total.alias("t"), log.alias("l"), R.sum_or_null(cols).alias("g")).collect()
    assert [r["t"] for r in got] == [0.0, 0.0, 1.0]
    assert got[0]["l"] == -math.inf and got[2]["l"] == 0.0
    assert [r["g"] for r in got] == [0.0, None, 1.0]


def test_shannon_and_cwm(spark):
    df = frame(spark, [(1.0, 1.0, 2.0), (0.0, 0.0, 0.0)], "a double, b double, c double")
    cols = [F.col(c) for c in "abc"]
    natural = values(df.select(R.shannon(cols).alias("v")))
    assert math.isclose(natural[0], 1.0397207708, rel_tol=1e-9) and natural[1] is None
    assert math.isclose(values(df.select(R.shannon(cols, 2).alias("v")))[0], 1.5)
    assert values(df.select(R.weighted_mean(list(zip(cols, [10, 2, 3]))).alias("v"))) == [4.5, None]


def test_row_statistics(spark):
    df = frame(spark, [([4.0, None, 1.0, 3.0, 2.0],), ([None],)], "m array<double>")
    m = F.col("m")
    low, high = R.row_quantiles(m, [0.025, 0.975])
    got = df.select(
        R.row_mean(m).alias("mean"), R.row_stddev(m).alias("sd"), low.alias("l"), high.alias("h")
    ).collect()
    assert got[0]["mean"] == 2.5 and math.isclose(got[0]["sd"], 1.2909944487, rel_tol=1e-9)
    assert math.isclose(got[0]["l"], 1.075) and math.isclose(got[0]["h"], 3.925)
    assert list(got[1]) == [None, None, None, None]


def test_weighted_quantile(spark):
    df = frame(spark, [([3.0, 1.0, 2.0], [1.0, 1.0, 2.0])], "v array<double>, w array<double>")
    for q, want in [(0.025, 1.0), (0.5, 2.0), (0.975, 3.0)]:
        expr = R.weighted_quantile(F.col("v"), F.col("w"), q).alias("v")
        assert values(df.select(expr)) == [want]


def test_hashed_draws_do_not_depend_on_partitioning(spark):
    draws = lambda n: {
        r["id"]: (r["u"], r["z"])
        for r in spark.range(20000, numPartitions=n)
        .select("id", H.hash_uniform([F.col("id")], 7).alias("u"), H.hash_normal([F.col("id")], 7).alias("z"))
        .collect()
    }
    one, many = draws(1), draws(16)
    assert one == many
    u = [a for a, _ in one.values()]
    z = [b for _, b in one.values()]
    assert 0 < min(u) and max(u) < 1 and abs(sum(u) / len(u) - 0.5) < 0.01
    assert abs(sum(z) / len(z)) < 0.03
    assert abs(sum(x * x for x in z) / len(z) - 1) < 0.05
