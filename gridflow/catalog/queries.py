"""One query per operator, on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from gridflow.catalog import views as V
from gridflow.functions import columns as C, rows as R
from gridflow.operators import applicability as AP
from gridflow.operators import community as CM
from gridflow.operators import ensemble as EN
from gridflow.operators import integrate as IN
from gridflow.operators import joins as J
from gridflow.operators import metrics as ME
from gridflow.operators import models as MO
from gridflow.operators import neighbours as NE
from gridflow.operators import prepare as PR
from gridflow.operators import regrid as RG
from gridflow.operators import sampling as SA
from gridflow.operators import tuning as TU
from gridflow.plans.config import Config
from gridflow.plans.prediction import Predictor, predict_all
from gridflow.plans.training import read_parameters, summarise_parameters, write_parameters, write_scores
from gridflow.schema import KEYS
from gridflow.session import scratch_path
from gridflow.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DEPTHS = [float(d) for d in range(0, 201, 5)]
COARSE = RG.Grid(RG.Axis(-90.0, 2.0, 90), RG.Axis(-180.0, 2.0, 180))
FLAGS = ["A", "N", "R"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def wide(spark, sf):
    return CM.to_wide(V.community_long(spark, sf), V.TARGETS)


# --- volumetric integration -------------------------------------------------------------


@query
def monthly_total(spark, sf):
    cells = V.cells(spark, sf)
    out = IN.integrate_totals(cells, ["quantity"], monthly=True, magnitude_conversion=1e-12)
    return V.rounded(out, 4, "total")


@query
def integrate_all_targets(spark, sf):
    out, _ = IN.integrated_totals(V.cells(spark, sf), ["quantity", "price", "absent"],
                                  magnitude_conversion=1e-15)
    return V.rounded(out, 4, "total")


@query
def integrate_rate(spark, sf):
    out = IN.integrate_total(V.cells(spark, sf), "quantity", rate=True, molar_mass=12.01,
                             magnitude_conversion=1e-15)
    return V.rounded(out, 4, "total")


@query
def integrate_rate_monthly(spark, sf):
    out = IN.integrate_total(V.cells(spark, sf), "quantity", rate=True, monthly=True,
                             vol_conversion=1e3, magnitude_conversion=1e-17)
    return V.rounded(out, 4, "total")


@query
def integrate_upper_depth(spark, sf):
    out = IN.integrate_total(V.cells(spark, sf), "quantity", subset_depth=15,
                             magnitude_conversion=1e-13)
    return V.rounded(out, 4, "total")


@query
def integrate_zonal(spark, sf):
    cells = PR.grid_mean(V.obs(spark, sf), ["lat", "depth"], ["quantity"])
    return V.rounded(IN.integrate_total(cells, "quantity", magnitude_conversion=1e-15), 4, "total")


@query
def integrate_mean_over_time(spark, sf):
    out = IN.integrate_total(V.cells(spark, sf), "quantity", time_reduce="mean",
                             magnitude_conversion=1e-13)
    return V.rounded(out, 4, "total")


@query
def cell_volume(spark, sf):
    cells = IN.with_volume(V.cells(spark, sf).select(*KEYS), dlat=1, dlon=1, depth_w=5)
    return cells.withColumn("volume", F.round(F.col("volume") * 1e-9, 4))


# --- scans and reshaping ----------------------------------------------------------------


@query
def fields_of_statistic(spark, sf):
    rows = readers.select_statistic(V.predictions(spark, sf), "ens", "ci95_UL")
    return PR.drop_missing(CM.to_wide(rows, FLAGS))


@query
def fields_from_stored_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    writers.write_predictions(V.predictions(spark, sf), path, files_per_target=2)
    return readers.load_fields(spark, path, "ens", "ci95_UL", FLAGS)


@query
def field_write_and_read(spark, sf):
    path = scratch_path(spark, "field")
    cells = V.cells(spark, sf)
    writers.write_field(cells, path, {"quantity": {"units": "1"}}, description="quantity per cell")
    return V.rounded(readers.read_env(spark, path, ["quantity"]), 6, "quantity")


@query
def monthly_files(spark, sf):
    path = scratch_path(spark, "months")
    PR.grid_mean(V.obs(spark, sf), KEYS, ["quantity"]).write.partitionBy("time").parquet(path)
    months = readers.read_monthly(
        spark, {m: f"{path}/time={m}" for m in range(1, 13)}, "quantity"
    )
    return V.rounded(months, 6, "quantity")


@query
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "csv") + ".csv"
    writers.write_csv(V.cells(spark, sf), path)
    return V.rounded(readers.read_env(spark, path, ["quantity", "price"]), 6, "quantity", "price")


@query
def to_wide(spark, sf):
    return wide(spark, sf)


@query
def to_wide_complete(spark, sf):
    return PR.drop_missing(wide(spark, sf))


@query
def to_long(spark, sf):
    return CM.to_long(wide(spark, sf), V.TARGETS)


@query
def distinct_targets(spark, sf):
    return CM.targets_of(V.community_long(spark, sf))


# --- projections and filters ------------------------------------------------------------


@query
def select_predictors(spark, sf):
    return PR.select_predictors(V.obs(spark, sf), ["quantity", "discount"])


def _joined(spark, sf):
    return J.join_obs_env(
        V.obs(spark, sf).select(*KEYS, "quantity"), V.env(spark, sf), ["temperature", "nitrate"]
    )


@query
def join_obs_env(spark, sf):
    return V.rounded(_joined(spark, sf), 6, "quantity", "temperature", "nitrate")


@query
def drop_missing_subset(spark, sf):
    rows = PR.drop_missing(_joined(spark, sf), ["temperature"])
    return V.rounded(rows, 6, "quantity", "temperature", "nitrate")


@query
def drop_missing_any(spark, sf):
    return PR.drop_missing(V.measured(spark, sf)).select("id", "region", "method", "cells")


@query
def exclude_methods(spark, sf):
    return PR.exclude(V.measured(spark, sf), "method", ["P"]).select("id", "method", "value")


@query
def drop_ratio_above(spark, sf):
    rows = PR.drop_ratio_above(V.measured(spark, sf), F.col("value"), F.col("cells"), 3500.0)
    return rows.select("id", "value", "cells")


@query
def upper_bound(spark, sf):
    return PR.at_most(V.measured(spark, sf), "value", 250000.0).select("id", "value")


@query
def presence_rows(spark, sf):
    return PR.keep_present(V.obs(spark, sf), "discount").select(*KEYS, "discount")


@query
def presence_label(spark, sf):
    rows = V.measured(spark, sf)
    return rows.select("id", C.presence_label(F.col("cells")).alias("present"))


@query
def depth_subset(spark, sf):
    return PR.subset_depth(V.obs(spark, sf), 15).select(*KEYS, "price")


@query
def renamed_coordinates(spark, sf):
    raw = V.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("latitude"), F.col("l_suppkey").alias("longitude"),
        F.col("l_linenumber").alias("Depth"), "l_quantity", "l_tax",
    )
    names = {"latitude": "lat", "longitude": "lon", "Depth": "depth"}
    return PR.normalise_coords(raw, names, drop=["l_tax"])


@query
def colour_index(spark, sf):
    index = C.band_difference(F.col("temperature"), F.col("nitrate")).alias("index")
    return V.rounded(V.env(spark, sf).select(*KEYS, index), 6, "index")


@query
def mask_incomplete(spark, sf):
    rows = V.measured(spark, sf).select("id", "value", "sd", "cells")
    return V.rounded(PR.mask_incomplete(rows, ["value", "sd", "cells"]), 4, "sd")


@query
def sentinel_to_null(spark, sf):
    rows = V.obs(spark, sf)
    return rows.select(*KEYS, C.sentinel_to_null(F.col("discount"), 0.0).alias("discount"),
                       C.sentinel_to_null(F.col("flag"), "N").alias("flag"))


@query
def fill_missing(spark, sf):
    return V.measured(spark, sf).select("id", "cells", "method").na.fill({"cells": 0.0, "method": "none"})


@query
def replicate_depth(spark, sf):
    surface = PR.grid_mean(V.obs(spark, sf), ["lat", "time"], ["quantity"])
    return V.rounded(PR.replicate_depth(surface, DEPTHS), 6, "quantity")


@query
def species_names(spark, sf):
    parts = V.table(spark, sf, "part")
    return parts.select("p_partkey", C.abbreviate_species(F.col("p_name")).alias("short"),
                        C.target_id(F.col("p_name")).alias("target"))


@query
def months_of_dates(spark, sf):
    rows = V.table(spark, sf, "orders")
    text = F.date_format("o_orderdate", "dd/MM/yyyy")
    days = F.datediff(F.to_date("o_orderdate"), F.lit("0001-01-01").cast("date"))
    return rows.select(
        "o_orderkey",
        C.month_of(text, "dd/MM/yyyy").alias("month"),
        C.year_of(text, "dd/MM/yyyy").alias("year"),
        C.month_from_days(days).alias("month_from_days"),
    )


@query
def log_transforms(spark, sf):
    rows = V.measured(spark, sf)
    logged = rows.select("id", C.log_forward(F.col("value")).alias("log"),
                         C.log10_plus_one(F.col("value")).alias("log10"))
    back = logged.withColumn("back", C.log_inverse(F.col("log")))
    return V.rounded(back, 6, "log", "log10").withColumn("back", F.round("back", 3))


# --- joins ------------------------------------------------------------------------------


@query
def join_env_complete(spark, sf):
    environment = V.env(spark, sf).withColumn("FID", F.when(F.col("nitrate") > 0.05, "").otherwise("X"))
    out = J.join_env(V.cells(spark, sf), environment)
    return V.rounded(out, 6, "quantity", "price", "temperature", "nitrate")


@query
def align_environment(spark, sf):
    rows = V.obs(spark, sf)
    late = PR.grid_mean(rows.where(F.col("tax") > 0.03), KEYS, ["price"])
    parts = {
        "temperature": V.env(spark, sf).select(*KEYS, "temperature"),
        "nitrate": V.env(spark, sf).select(*KEYS, "nitrate"),
        "price": late,
    }
    return V.rounded(J.align_env(parts), 6, "temperature", "nitrate", "price")


@query
def residuals(spark, sf):
    modelled = V.env(spark, sf).withColumnRenamed("temperature", "discount").drop("nitrate")
    out = J.residuals(modelled, V.obs(spark, sf), ["discount"])
    return V.rounded(out, 6, "discount_mod", "discount_resid")


@query
def group_statistic(spark, sf):
    rows = V.measured(spark, sf).select("id", "value", "method")
    out = PR.with_group_stat(rows, ["method"], {"mean_value": F.avg("value")})
    return V.rounded(out, 4, "mean_value")


@query
def trait_join(spark, sf):
    out = CM.scale_by_trait_long(V.community_long(spark, sf), V.traits(spark, sf), "pg pic")
    return V.rounded(out, 4, "value")


# --- aggregations -----------------------------------------------------------------------


@query
def grid_mean(spark, sf):
    return V.rounded(V.cells(spark, sf), 6, "quantity", "price")


@query
def impute_sd(spark, sf):
    rows = V.measured(spark, sf).select("id", "value", "sd", "region")
    return V.rounded(PR.impute_sd(rows, "value", "sd", "region"), 4, "sd")


@query
def standard_error(spark, sf):
    rows = PR.with_standard_error(V.measured(spark, sf).select("id", "sd"), "sd", 3, "se")
    return V.rounded(rows, 4, "sd", "se")


@query
def seasonal_gaps(spark, sf):
    cells = PR.grid_mean(V.obs(spark, sf), ["lat", "lon", "time"], ["quantity"])
    return V.rounded(PR.fill_seasonal_gaps(cells, "quantity"), 6, "quantity")


@query
def count_valid(spark, sf):
    return PR.count_valid(V.measured(spark, sf), ["sd", "cells"], ["region"])


@query
def mean_over_depth_and_time(spark, sf):
    return V.rounded(PR.mean_over(V.cells(spark, sf), ["depth", "time"], ["quantity"]), 6, "quantity")


@query
def field_sum(spark, sf):
    return V.rounded(PR.field_sum(wide(spark, sf), V.TARGETS), 2, *V.TARGETS)


@query
def performance_summary(spark, sf):
    folds = V.obs(spark, sf).groupBy(
        F.col("flag").alias("model"), F.col("status").alias("target"), F.col("line").alias("fold")
    ).agg(F.avg("discount").alias("R2"), (-F.avg("tax")).alias("MAE"), (-F.avg("quantity")).alias("RMSE"))
    scores = folds.unpivot(["model", "target", "fold"], ["R2", "MAE", "RMSE"], "metric", "value")
    fields = CM.to_wide(
        V.obs(spark, sf).groupBy(*KEYS, F.col("status").alias("target")).agg(F.avg("price").alias("value")),
        ["F", "O"],
    )
    means = ME.field_means(fields, ["F", "O"])
    out = ME.summarise_performance(scores, means)
    return V.rounded(out, 8, "R2", "RMSE", "MAE", "rRMSE", "rMAE")


@query
def regression_metrics(spark, sf):
    rows = V.obs(spark, sf).withColumn("pred", F.col("quantity") + (F.col("discount") - 0.05) * 100)
    out = ME.regression_metrics(rows, "quantity", "pred", ["line"], relative=True)
    return V.rounded(out, 6, "R2", "MAE", "RMSE", "rMAE", "rRMSE")


@query
def balanced_accuracy(spark, sf):
    rows = V.scored(spark, sf).withColumn("pred", (F.col("score") > 0.5).cast("int"))
    return V.rounded(ME.balanced_accuracy(rows, "quality", "pred", ["toxic"]), 8, "balanced_accuracy")


# --- community metrics ------------------------------------------------------------------


@query
def carbon_by_trait(spark, sf):
    out = CM.scale_by_trait(wide(spark, sf), V.traits(spark, sf), "pg poc", V.TARGETS)
    return V.rounded(out, 4, *V.TARGETS)


@query
def group_sums(spark, sf):
    groups = {"click": "browse", "view": "browse", "purchase": "act", "signup": "act"}
    return V.rounded(CM.sum_groups(wide(spark, sf), groups), 2, "browse", "act")


@query
def row_total(spark, sf):
    out = CM.total(wide(spark, sf), V.TARGETS)
    return V.rounded(out, 6, "total", "total_log")


@query
def weighted_trait_mean(spark, sf):
    complete = wide(spark, sf).na.fill(0.0)
    out = CM.cwm(complete, V.traits(spark, sf), "pg pic", V.TARGETS)
    return V.rounded(out, 6, "cwm pg pic")


@query
def shannon_diversity(spark, sf):
    out = CM.diversity(wide(spark, sf), V.TARGETS)
    two = out.withColumn("shannon_base_2", R.shannon([F.col(t) for t in V.TARGETS], 2))
    return V.rounded(two, 6, "shannon", "shannon_base_2")


@query
def resample_statistics(spark, sf):
    out = CM.resample_stats(wide(spark, sf), V.TARGETS)
    return V.rounded(out, 6, *CM.RESAMPLE_COLUMNS)


@query
def resample_statistics_long(spark, sf):
    return V.rounded(CM.resample_stats_long(V.community_long(spark, sf)), 6, *CM.RESAMPLE_COLUMNS)


@query
def row_quantile(spark, sf):
    values = F.array(*[F.col(t) for t in V.TARGETS])
    out = wide(spark, sf).withColumn("q", R.row_quantile(values, 0.4)).drop(*V.TARGETS)
    return V.rounded(out, 4, "q")


@query
def weighted_row_quantile(spark, sf):
    rows = wide(spark, sf).na.fill(0.0)
    values = F.array(*[F.col(t) for t in V.TARGETS])
    weights = F.array(*[F.lit(w) for w in (1.0, 2.0, 4.0, 8.0, 16.0)])
    return rows.select("lat", "lon", "time", R.weighted_quantile(values, weights, 0.3).alias("q"))


# --- binning, interpolation, regridding -------------------------------------------------


@query
def coordinate_bins(spark, sf):
    rows = V.table(spark, sf, "lineitem")
    price = F.col("l_extendedprice")
    bins = C.bin_coordinates(price % 180 - 90, price % 360 - 180, F.floor(price) % 206)
    counted = rows.select(*[c.alias(n) for n, c in bins.items()])
    return counted.groupBy("lat", "lon", "depth").agg(F.count("*").alias("n"))


@query
def interpolate_depth(spark, sf):
    out = RG.interp_depth(V.profile(spark, sf), "quantity", DEPTHS)
    return V.rounded(out, 6, "quantity")


@query
def regrid_conservative(spark, sf):
    return V.rounded(RG.regrid_conservative(V.coarse(spark, sf), "quantity", COARSE), 6, "quantity")


@query
def regrid_conservative_strict(spark, sf):
    out = RG.regrid_conservative(V.coarse(spark, sf), "quantity", COARSE, skipna=False)
    return V.rounded(out, 6, "quantity")


@query
def regrid_bilinear(spark, sf):
    return V.rounded(RG.regrid_bilinear(V.coarse(spark, sf), "quantity", COARSE), 6, "quantity")


@query
def dense_grid(spark, sf):
    return V.rounded(PR.densify(V.cells(spark, sf).drop("quantity")), 6, "price")


# --- folds and resampling ---------------------------------------------------------------


@query
def plain_folds(spark, sf):
    return SA.kfold(V.table(spark, sf, "orders").select("o_orderkey"), 7, "o_orderkey")


@query
def zero_stratified_folds(spark, sf):
    rows = V.scored(spark, sf).select("doc_id", F.col("quality").cast("double").alias("y"))
    return SA.zero_stratified_kfold(rows, "y", 5, "doc_id")


@query
def zero_stratified_folds_by_target(spark, sf):
    rows = V.measured(spark, sf).select("id", F.coalesce("cells", F.lit(0.0)).alias("y"),
                                        F.col("region").alias("target"))
    return SA.zero_stratified_kfold(rows, "y", 4, "id", by=["target"])


@query
def shuffled_order(spark, sf):
    return SA.shuffle(V.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 1)


@query
def shuffled_folds(spark, sf):
    return SA.shuffled_kfold(V.table(spark, sf, "orders").select("o_orderkey"), 7, ["o_orderkey"], 1)


@query
def folds_with_null_group(spark, sf):
    """A null group is a group: none of its rows is lost."""
    rows = V.measured(spark, sf).select("id", "method")
    return SA.kfold(rows, 5, "id", by=["method"])


@query
def zero_stratified_folds_with_null_group(spark, sf):
    rows = V.measured(spark, sf).select("id", F.coalesce("cells", F.lit(0.0)).alias("y"), "method")
    return SA.zero_stratified_kfold(rows, "y", 4, "id", by=["method"])


@query
def upsampled_absences(spark, sf):
    rows = V.scored(spark, sf).select("doc_id", F.col("quality").cast("double").alias("y"))
    up = SA.upsample(rows, "y", "doc_id", ratio=10, seed=1)
    return up.groupBy("doc_id", "y").agg(F.count("*").alias("n"))


@query
def upsampled_fold_sizes(spark, sf):
    rows = V.scored(spark, sf).select("doc_id", (1.0 - F.col("quality")).alias("y"))
    _, training = SA.upsampled_folds(rows, "y", 3, "doc_id", seed=2)
    return training.select("split", "doc_id", "y", "weight")


@query
def resampled_targets(spark, sf):
    rows = PR.with_standard_error(V.measured(spark, sf), "sd", 3, "se").where(F.col("se").isNotNull())
    draws = SA.resample_normal(rows.select("id", "value", "se"), "value", "se", 5, 42, ["id"])
    return V.rounded(draws, 4, "value", "se", *[f"sample_{i}" for i in range(1, 6)])


@query
def resampled_targets_long(spark, sf):
    rows = PR.with_standard_error(V.measured(spark, sf), "sd", 3, "se").where(F.col("se").isNotNull())
    draws = SA.resample_normal(rows.select("id", "value", "se"), "value", "se", 50, 42, ["id"], long=True)
    stats = draws.groupBy("target").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    return V.rounded(stats, 2, "mean")


@query
def pseudo_absences(spark, sf):
    seen = V.cells(spark, sf).select(*KEYS, "quantity")
    dark = V.env(spark, sf).select(*KEYS, (F.col("temperature") > 0.05).cast("int").alias("mask"))
    n = seen.agg(F.floor(F.count("quantity") / 10)).scalar()
    return V.rounded(SA.add_pseudo_zeros(seen, dark, n, ["quantity"], 42), 6, "quantity")


@query
def bag_sizes(spark, sf):
    bags = SA.make_bags(V.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 4, 0.2, 1)
    return bags


@query
def bootstrap_bags(spark, sf):
    return SA.make_bags(V.vectors(spark, sf).select("id", "y"), "id", 3, 0.5, 1)


# --- feature preparation, weights, thresholds -------------------------------------------


@query
def standardised_features(spark, sf):
    rows = V.measured(spark, sf).select("id", "value", "sd")
    return V.rounded(MO.standardise(rows, ["value", "sd"]), 6, "value", "sd")


@query
def one_hot_regions(spark, sf):
    rows = V.measured(spark, sf).select("id", "value", "region")
    prep = MO.fit_preprocessor(rows, ["value", "region"], regions="region")
    out = prep.transform(rows).select("id", *prep.names)
    return V.rounded(out, 6, "_x0").withColumnsRenamed({n: f"x{i}" for i, n in enumerate(prep.names)})


def _errors(spark, sf):
    return V.obs(spark, sf).groupBy(F.col("flag").alias("model"), F.col("status").alias("target")).agg(
        F.avg("discount").alias("mae")
    )


@query
def inverse_error_weights(spark, sf):
    return V.rounded(EN.inverse_weights(_errors(spark, sf)), 8, "mae", "weight")


def _votes(spark, sf, name):
    return V.obs(spark, sf).groupBy(
        "lat", "lon", F.col("flag").alias("model"), F.col("status").alias("target")
    ).agg(F.avg("price").alias(name))


@query
def voted_mean(spark, sf):
    weights = EN.inverse_weights(_errors(spark, sf))
    out = EN.vote(_votes(spark, sf, "prediction"), weights, ["lat", "lon"])
    return V.rounded(out, 4, "prediction")


@query
def voted_class(spark, sf):
    weights = EN.inverse_weights(_errors(spark, sf))
    votes = _votes(spark, sf, "proba").withColumn("proba", F.col("proba") / 110000.0)
    return V.rounded(EN.vote_proba(votes, weights, ["lat", "lon"]), 9, "proba")


@query
def youden_threshold(spark, sf):
    return V.rounded(ME.youden_threshold(V.scored(spark, sf), "score", "quality"), 8, "threshold", "gain")


@query
def roc_curve(spark, sf):
    return V.rounded(ME.roc_curve(V.scored(spark, sf), "score", "quality"), 8, "threshold", "tpr", "fpr")


@query
def member_loss_weights(spark, sf):
    members = F.array("tax", "discount", F.col("quantity") / 100.0)
    rows = V.obs(spark, sf).select((F.col("price") / 100000.0).alias("y"), members.alias("members"))
    return V.rounded(EN.member_weights(rows, "y"), 8, "weight")


@query
def member_class_weights(spark, sf):
    members = F.array((F.col("score") > 0.3).cast("double"), (F.col("score") > 0.6).cast("double"))
    rows = V.scored(spark, sf).select("quality", members.alias("members"))
    return V.rounded(EN.member_weights(rows, "quality", classifier=True), 8, "weight")


@query
def two_phase_interval(spark, sf):
    def bounds(c):
        return V.obs(spark, sf).groupBy(*KEYS).agg(F.min(c).alias("ci95_LL"), F.max(c).alias("ci95_UL"))

    return EN.hurdle_interval(bounds("discount"), bounds("price"), 0.045)


@query
def cut_rules(spark, sf):
    di = V.table(spark, sf, "orders").select((F.col("o_totalprice") / 1000.0).alias("di"))
    rules = [("tukey", "as_coded"), ("tukey", "standard"), ("mad", "standard")]
    rows = [(rule, scale, AP.cutpoint(di, "di", rule, scale, cap=False)) for rule, scale in rules]
    rows.append(("0.9", "standard", AP.cutpoint(di, "di", 0.9, "standard", cap=False)))
    rows.append(("tukey", "capped", AP.cutpoint(di, "di", "tukey", "as_coded", cap=True)))
    return V.rounded(spark.createDataFrame(rows, "rule string, scale string, cut double"), 6, "cut")


# --- nearest neighbours and applicability -----------------------------------------------


@query
def nearest_neighbours(spark, sf):
    rows = V.vectors(spark, sf)
    out = NE.knn_join(rows, rows, V.FEATURES, 3, "id", "id", exclude_self=True)
    return V.rounded(out, 6, "distance")


@query
def nearest_neighbours_cityblock(spark, sf):
    rows = V.vectors(spark, sf)
    known, asked = rows.where(F.col("y") < 7), rows.where(F.col("y") >= 7)
    return V.rounded(NE.knn_join(asked, known, V.FEATURES, 2, "id", "id", p=1), 6, "distance")


@query
def nearest_neighbours_boxed(spark, sf):
    """The plan for bases beyond the broadcast bound."""
    rows = V.vectors(spark, sf)
    out = NE.knn_join(rows, rows, V.FEATURES, 3, "id", "id", exclude_self=True, limit=0)
    return V.rounded(out, 6, "distance")


def _named_metric(metric, limit):
    def run(spark, sf):
        rows = V.vectors(spark, sf)
        known, asked = rows.where(F.col("y") < 7), rows.where(F.col("y") >= 7)
        return V.rounded(NE.knn_join(asked, known, V.FEATURES, 2, "id", "id", p=metric, **limit), 6, "distance")

    return run


for _metric in ("cosine", "canberra"):
    QUERIES[f"nearest_neighbours_{_metric}"] = _named_metric(_metric, {})
    QUERIES[f"nearest_neighbours_{_metric}_boxed"] = _named_metric(_metric, {"limit": 0})


def _knn(spark, sf, task, weights, limit=None):
    rows = V.vectors(spark, sf)
    spec = MO.ModelSpec("knn", task, {"n_neighbors": 5, "weights": weights}, bags=0)
    prep = MO.Preprocessor({f: [0.0, 1.0] for f in V.FEATURES}, {})
    model = MO.fit_model(spec, rows.where(F.col("y") < 7), V.FEATURES, "y", "id", prep=prep)
    if limit is not None:
        model.limit = limit
    return model.predict(rows.where(F.col("y") >= 7), "p")


@query
def knn_regression(spark, sf):
    return V.rounded(_knn(spark, sf, "reg", "uniform").select("id", "p"), 6, "p")


@query
def knn_regression_boxed(spark, sf):
    return V.rounded(_knn(spark, sf, "reg", "uniform", limit=0).select("id", "p"), 6, "p")


@query
def knn_regression_by_distance(spark, sf):
    return V.rounded(_knn(spark, sf, "reg", "distance").select("id", "p"), 6, "p")


@query
def knn_classification(spark, sf):
    return V.rounded(_knn(spark, sf, "clf", "uniform").select("id", "p", "p_proba"), 6, "p_proba")


WEIGHTS = {f: float(i + 1) for i, f in enumerate(V.FEATURES)}


def _applicability(spark, sf, **options):
    rows = V.vectors(spark, sf)
    out = AP.area_of_applicability(
        rows.where(F.col("y") >= 7), rows.where(F.col("y") < 7), V.FEATURES, "id", "id",
        WEIGHTS, "y", return_all=True, **options,
    )
    return V.rounded(out.select("id", "aoa", "di", "lpd", "cutpoint"), 6, "di", "cutpoint")


@query
def applicability(spark, sf):
    return _applicability(spark, sf)


@query
def applicability_boxed(spark, sf):
    return _applicability(spark, sf, limit=0)


@query
def applicability_standard_cut(spark, sf):
    return _applicability(spark, sf, scale="standard", cap=False, drop_zeros=True)


@query
def applicability_by_fold(spark, sf):
    rows = V.vectors(spark, sf)
    known = SA.kfold(rows.where(F.col("y") < 7), 4, "id")
    out = AP.area_of_applicability(
        rows.where(F.col("y") >= 7), known, V.FEATURES, "id", "id", WEIGHTS, "y", fold_col="fold"
    )
    return V.rounded(out.select("id", "aoa", "di", "cutpoint"), 6, "di", "cutpoint")


# --- models -----------------------------------------------------------------------------

FOREST = {"n_estimators": 100, "max_depth": 5, "min_samples_leaf": 2, "max_samples": 0.8}
BOOSTED = {"n_estimators": 10, "max_depth": 4, "learning_rate": 0.1, "subsample": 0.8}
NEIGHBOURS = {"max_samples": 0.5, "max_features": 0.5, "estimator__n_neighbors": 3}
PARAMS = {"rf": FOREST, "xgb": BOOSTED, "knn": NEIGHBOURS}


def _spec(kind, task="reg", log=False):
    return MO.ModelSpec(kind, task, PARAMS[kind], log, seed=1, bags=3)


def _fit(spark, sf, kind, task="reg", log=False):
    rows = V.vectors(spark, sf)
    return MO.fit_model(_spec(kind, task, log), rows, V.FEATURES, "y", "id"), rows


def _register_models():
    names = {"rf": "forest", "xgb": "boosted", "knn": "bagged_neighbours"}
    for kind, name in names.items():
        def regress(spark, sf, kind=kind):
            model, rows = _fit(spark, sf, kind, log=True)
            return model.predict(rows, "mean").select("id", "y", "mean")

        def classify(spark, sf, kind=kind):
            model, rows = _fit(spark, sf, kind, "clf")
            return model.predict(rows, "present").select("id", "y", "present", "present_proba")

        QUERIES[f"{name}_regression"] = regress
        QUERIES[f"{name}_classification"] = classify


_register_models()


@query
def member_predictions(spark, sf):
    model, rows = _fit(spark, sf, "rf")
    return model.members(rows).select("id", F.posexplode("members").alias("member", "prediction"))


@query
def prediction_intervals(spark, sf):
    model, rows = _fit(spark, sf, "rf", log=True)
    return EN.predict_with_interval(model, rows, "mean").select("id", "mean", *EN.INTERVAL)


@query
def loss_weighted_intervals(spark, sf):
    model, rows = _fit(spark, sf, "rf")
    weights = EN.loss_weights(model, rows, "y")
    return EN.predict_interval(model, rows, weights=weights).select("id", *EN.INTERVAL)


@query
def boosted_bag_intervals(spark, sf):
    model, rows = _fit(spark, sf, "xgb")
    model.fit_bags(rows, V.FEATURES, "y", "id", n=3)
    return EN.predict_interval(model, rows).select("id", *EN.INTERVAL)


@query
def out_of_fold_intervals(spark, sf):
    folds = SA.zero_stratified_kfold(V.vectors(spark, sf), "y", 3, "id")
    out = TU.train_intervals(
        folds, 3, lambda d, w: MO.fit_model(_spec("rf"), d, V.FEATURES, "y", "id", w)
    )
    return out.select("id", "fold", *EN.INTERVAL)


@query
def cross_validated_scores(spark, sf):
    folds = SA.zero_stratified_kfold(V.vectors(spark, sf), "y", 3, "id")
    return TU.cross_validate(
        folds, 3, lambda d, w: MO.fit_model(_spec("rf"), d, V.FEATURES, "y", "id", w), "y"
    )


@query
def grid_search_scores(spark, sf):
    folds = SA.zero_stratified_kfold(V.vectors(spark, sf), "y", 3, "id")
    _, table = TU.grid_search(
        _spec("rf"), {"max_depth": [2, 4]}, folds, 3, V.FEATURES, "y", "id", log="both"
    )
    rows = [(t["params"]["max_depth"], t["log"], t["score"]) for t in table]
    return spark.createDataFrame(rows, "max_depth int, log boolean, score double")


@query
def two_phase_prediction(spark, sf):
    rows = V.vectors(spark, sf)
    hurdle = MO.fit_hurdle(_spec("rf", "clf"), _spec("rf"), rows, V.FEATURES, "y", "id", 0.6)
    out = EN.predict_hurdle_interval(hurdle, rows, 0.6)
    return out.select("id", "mean", *EN.INTERVAL)


@query
def voting_prediction(spark, sf):
    rows = V.vectors(spark, sf)
    models = [MO.fit_model(_spec(k), rows, V.FEATURES, "y", "id") for k in ("rf", "knn")]
    voting = MO.Voting(models, EN.inverse_shares([1.0, 2.0]))
    return EN.predict_interval(voting, voting.predict(rows, "mean")).select("id", "mean", *EN.INTERVAL)


@query
def permutation_importance(spark, sf):
    model, rows = _fit(spark, sf, "rf")
    return TU.permutation_importance(model, rows, "y", V.FEATURES, "id", repeats=10, seed=1)


# --- model runs with a closed form: one split on a 0/1 predictor gives group means -------

STUMP = {"rf": {"n_estimators": 1, "max_depth": 1, "bootstrap": False, "max_features": 1.0},
         "xgb": {"n_estimators": 1, "max_depth": 1}}


def _stump(kind="rf", task="reg"):
    return MO.ModelSpec(kind, task, STUMP[kind])


def _group_means(rows, kind="rf", task="reg", on="x", weight=None):
    return MO.fit_model(_stump(kind, task), rows, [on], "y", "id", weight)


@query
def forest_group_means(spark, sf):
    rows = V.grouped(spark, sf)
    return V.rounded(_group_means(rows).predict(rows, "p").select("id", "p"), 6, "p")


@query
def forest_group_shares(spark, sf):
    rows = V.grouped(spark, sf)
    return V.rounded(_group_means(rows, task="clf").predict(rows, "p").select("id", "p", "p_proba"), 6, "p_proba")


@query
def boosted_group_means(spark, sf):
    rows = V.grouped(spark, sf)
    return V.rounded(_group_means(rows, "xgb").predict(rows, "p").select("id", "p"), 6, "p")


@query
def boosted_group_shares(spark, sf):
    rows = V.grouped(spark, sf)
    return V.rounded(_group_means(rows, "xgb", "clf").predict(rows, "p").select("id", "p", "p_proba"), 6, "p_proba")


@query
def cross_validated_group_means(spark, sf):
    folds = SA.kfold(V.grouped(spark, sf), 3, "id")
    scores = TU.cross_validate(folds, 3, lambda d, w: _group_means(d, weight=w), "y")
    return V.rounded(scores, 6, "R2", "MAE", "RMSE")


@query
def out_of_fold_group_means(spark, sf):
    """Both bounds of a stump's interval are the group mean of the other folds."""
    folds = SA.kfold(V.grouped(spark, sf), 3, "id")
    out = TU.train_intervals(folds, 3, lambda d, w: _group_means(d, weight=w)).select("id", "fold", *EN.INTERVAL)
    return V.rounded(out, 6, *EN.INTERVAL)


@query
def boosted_members_agree(spark, sf):
    """Of boosted bags: rows whose members are the predictions of the bags' models, one by one."""
    model, rows = _fit(spark, sf, "xgb")
    model.fit_bags(rows, V.FEATURES, "y", "id", n=2)
    both = model.members(rows, "m")
    for i, bag in enumerate(model.bagged):
        both = MO.Boosted(model.spec, model.prep, bag).predict(both, f"p{i}")
    same = [F.count_if(F.abs(F.get("m", F.lit(i)) - F.col(f"p{i}")) < 1e-9).alias(f"same_{i}") for i in range(2)]
    return both.agg(F.count("*").alias("n"), *same)


@query
def bag_draw_sums(spark, sf):
    """Draws of every bag over all rows: floor(0.5 n) each, from one array per row."""
    rows = SA.bag_weights(V.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 8, 0.5, 3)
    each = rows.select(F.posexplode("_bags").alias("bag", "n"))
    return each.groupBy("bag").agg(F.sum("n").alias("draws"), F.count("*").alias("n_rows"))


@query
def grid_search_group_means(spark, sf):
    """Depth 0 predicts the mean, depth 1 the group means; errors are negated scores."""
    folds = SA.kfold(V.grouped(spark, sf), 3, "id")
    _, table = TU.grid_search(_stump(), {"max_depth": [0, 1]}, folds, 3, ["x"], "y", "id", scoring="MAE")
    rows = [(t["params"]["max_depth"], t["score"]) for t in table]
    return V.rounded(spark.createDataFrame(rows, "max_depth int, score double"), 6, "score")


@query
def two_phase_group_means(spark, sf):
    """Only the group whose share of presences reaches 0.6 has an amount."""
    rows = V.grouped(spark, sf)
    hurdle = MO.fit_hurdle(_stump(task="clf"), _stump(), rows, ["x"], "y", "id", 0.6)
    out = EN.predict_hurdle_interval(hurdle, rows, 0.6).select("id", "mean", *EN.INTERVAL)
    return V.rounded(out, 6, "mean", *EN.INTERVAL)


@query
def voting_group_means(spark, sf):
    rows = V.grouped(spark, sf)
    voting = MO.Voting([_group_means(rows), _group_means(rows, on="z")], EN.inverse_shares([1.0, 3.0]))
    out = EN.predict_with_interval(voting, rows, "mean").select("id", "mean", *EN.INTERVAL)
    return V.rounded(out, 6, "mean", *EN.INTERVAL)


@query
def permutation_importance_of_groups(spark, sf):
    rows = V.grouped(spark, sf)
    model = _group_means(rows)
    found = TU.permutation_importance(model, rows, "y", ["x"], "id", repeats=10, seed=1)
    return V.rounded(found, 6, "importance", "weight")


@query
def members_agree_with_predictions(spark, sf):
    """Of a full forest: rows whose prediction is the mean of the members and whose bounds are their quantiles."""
    model, rows = _fit(spark, sf, "rf")
    both = EN.predict_with_interval(model, model.predict(model.members(rows, "m"), "p"), "mean")
    mean = F.aggregate("m", F.lit(0.0), lambda a, b: a + b) / F.size("m")
    same = [F.abs(mean - F.col("p")) < 1e-9, F.abs(F.col("mean") - F.col("p")) < 1e-9]
    for name, q in zip(EN.INTERVAL, (0.025, 0.975)):
        place = (F.size("m") - 1) * q
        low = F.get(F.array_sort("m"), F.floor(place).cast("int"))
        high = F.get(F.array_sort("m"), F.ceil(place).cast("int"))
        same.append(F.abs(low + (high - low) * (place - F.floor(place)) - F.col(name)) < 1e-9)
    checks = [F.count_if(c).alias(f"same_{i}") for i, c in enumerate(same)]
    return both.agg(F.count("*").alias("n"), *checks)


# --- whole runs: what is written is read again ------------------------------------------


@query
def saved_model(spark, sf):
    rows, path = V.grouped(spark, sf), scratch_path(spark, "models")
    MO.save_models({("rf", "a target", "reg"): _group_means(rows)}, path)
    model = MO.load_models(spark, path, [("rf", "a target", "reg")])["rf", "a target", "reg"]
    return V.rounded(model.predict(rows, "p").select("id", "p"), 6, "p")


@query
def predicted_targets(spark, sf):
    """Two targets, one pass over the grid: means of the groups, intervals of a single member."""
    path = scratch_path(spark, "run")
    config = Config(path, ["x"], ["rf"], {}, cv=3)
    rows = V.grouped(spark, sf).withColumn("half", F.col("y") / 2)
    grid = rows.groupBy((F.col("id") % 180).cast("double").alias("lat"), "x").agg(F.count("*").alias("n")).drop("n")
    predictors = []
    for target in ("y", "half"):
        named = rows.withColumn("y", F.col(target))
        MO.save_models({("rf", target, "reg"): _group_means(named)}, path)
        predictors.append(Predictor(rows, target, grid, config))
    table = predict_all(predictors)
    # a grid cell stands for one of the two groups or for both
    fields = table.select("lat", "target", "model", "mean", *EN.INTERVAL)
    return V.rounded(fields, 6, "mean", *EN.INTERVAL)


@query
def predicted_two_phases(spark, sf):
    """Two two-phase models and their weighted ensemble, one pass over the grid, in all parts of the predictions table."""
    path = scratch_path(spark, "run")
    config = Config(path, ["x"], ["rf", "other"], {}, two_phase=True, cv=2)
    rows = V.grouped(spark, sf)
    grid = rows.groupBy((F.col("id") % 180).cast("double").alias("lat"), "x").agg(F.count("*").alias("n")).drop("n")
    for name, error in (("rf", 1.0), ("other", 3.0)):
        hurdle = MO.fit_hurdle(_stump(task="clf"), _stump(), rows, ["x"], "y", "id", 0.6)
        parts = {"zir": hurdle, "clf": hurdle.classifier, "reg": hurdle.regressor}
        MO.save_models({(name, "y", part): model for part, model in parts.items()}, path)
        known = spark.createDataFrame([(0, error, 0.5, error)], "fold int, MAE double, R2 double, RMSE double")
        write_scores(ME.scores_long(known, name, "y", ME.REGRESSION_METRICS).withColumn("part", F.lit("zir")), path)
    table = predict_all([Predictor(rows, "y", grid, config)])
    return V.rounded(table.select("lat", "model", "part", "mean", *EN.INTERVAL), 6, "mean", *EN.INTERVAL)


@query
def raw_observations(spark, sf):
    path = scratch_path(spark, "raw")
    rows = V.obs(spark, sf).select("lat", "lon", "depth", "time", "quantity", "flag")
    writers.write_csv(rows, path)
    schema = "Latitude double, Longitude double, Depth double, Month int, Value double, Flag string"
    return readers.read_observations(spark, path, StructType.fromDDL(schema))


@query
def written_traits(spark, sf):
    path = scratch_path(spark, "traits")
    writers.write_csv(V.traits(spark, sf), path)
    return readers.read_traits(spark, path, ["pg poc", "pg pic"], format="csv")


@query
def written_report(spark, sf):
    path = scratch_path(spark, "report")
    writers.write_report(V.rounded(EN.inverse_weights(_errors(spark, sf)), 8, "mae", "weight"), path)
    types = {"model": StringType(), "target": StringType()}
    return readers.read_table(spark, path, ["model", "target", "mae", "weight"], types, "csv")


@query
def written_applicability(spark, sf):
    path = scratch_path(spark, "aoa")
    cells = _applicability(spark, sf).withColumn("time", F.lit(1))
    writers.write_applicability(cells, path)
    return readers.read_table(spark, path, ["id", "aoa", "di", "lpd", "cutpoint"])


@query
def rewritten_predictions(spark, sf):
    """Predictions written twice: the second run replaces what it writes again."""
    path = scratch_path(spark, "predictions")
    first = V.predictions(spark, sf)
    writers.write_predictions(first.withColumns({c: F.col(c) + 1.0 for c in ("mean", *EN.INTERVAL)}), path)
    writers.write_predictions(first, path)
    return readers.load_fields(spark, path, "ens", "ci95_UL", FLAGS)


@query
def tuned_parameters(spark, sf):
    """The parameters of two targets' models as one row per target."""
    path = scratch_path(spark, "parameters")
    depths = V.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("t")).agg(
        (F.count("*") % 30).cast("int").alias("d")
    )
    for r in depths.collect():
        spec = MO.ModelSpec("rf", "reg", {"max_depth": r["d"], "n_estimators": 7})
        write_parameters(spark, "rf", r["t"], {"reg": spec}, path)
    return summarise_parameters(read_parameters(spark, path), "rf")
