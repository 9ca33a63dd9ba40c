import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, connect

SMALL = "/root/testdata/sf0.001"
ROWS_ONLY = sorted(set(entry.queries()) - set(entry.oracle_sql()))


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 12


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    message, _, _ = compare(spark, con, name, SMALL)
    assert message is None


@pytest.mark.parametrize("name", [n for n in ROWS_ONLY if not n.startswith("op") and n != "pipeline"])
def test_rows_only(spark, name):
    """Queries without SQL: rows, and finite numbers in them."""
    df = entry.queries()[name](spark, SMALL)
    numbers = [c for c, kind in df.dtypes if kind in ("double", "float")]
    rows = df.agg(F.count("*").alias("n"), *[F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(f"odd_{c}") for c in numbers]).first()
    assert rows.n > 0 and not any(rows[f"odd_{c}"] for c in numbers)


PLANS = [
    "monthly_total", "join_obs_env", "align_environment", "residuals", "impute_sd", "seasonal_gaps", "dense_grid",
    "to_wide_complete", "resample_statistics", "interpolate_depth", "regrid_conservative", "regrid_bilinear",
    "voted_mean", "group_statistic", "zero_stratified_folds_by_target", "nearest_neighbours",
]


@pytest.mark.parametrize("name", PLANS)
def test_no_product_in_the_plan(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
