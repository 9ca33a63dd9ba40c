"""Post-processing of predicted fields: metrics, joins, reports, applicability, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridflow.operators import community, integrate, joins
from gridflow.operators.applicability import area_of_applicability
from gridflow.operators.metrics import field_means, summarise_performance
from gridflow.operators.models import load_models
from gridflow.operators.tuning import permutation_importance
from gridflow.plans.config import Config
from gridflow.plans.training import read_parameters, read_scores, summarise_parameters
from gridflow.schema import col, complete, keys_of
from gridflow.session import stored
from gridflow.sources.readers import load_fields
from gridflow.sources.writers import write_applicability, write_csv, write_field, write_report


class Post:
    """Holds the wide field table `d` (keys, one column per target) and grows it step by step."""

    def __init__(
        self, spark: SparkSession, config: Config, targets: list[str], traits: DataFrame,
        statistic: str = "mean", model: str = "ens",
    ):
        self.spark, self.config, self.traits = spark, config, traits
        self.statistic, self.model = statistic, model
        self.d = load_fields(spark, f"{config.path}/predictions", model, statistic, targets)
        self.targets = targets
        self.posts = f"{config.path}/posts"

    def performance(self, models: list[str] | None = None) -> DataFrame:
        """R2, RMSE, MAE, rRMSE, rMAE per model and target, written as one report per model."""
        part = "zir" if self.config.two_phase else "reg"
        scores = read_scores(self.spark, self.config.path).where(F.col("part") == part)
        table = stored(summarise_performance(scores, field_means(self.d, self.targets)), "report")
        for name in models or [*self.config.models, "ens"]:
            rows = table.where(F.col("model") == name).drop("model")
            write_report(rows, f"{self.posts}/performance/{name}_performance")
        return table

    def parameters(self, model: str) -> DataFrame:
        table = summarise_parameters(read_parameters(self.spark, self.config.path), model)
        write_report(table, f"{self.posts}/parameters/{model}_parameters")
        return table

    def estimate_carbon(self, variable: str) -> Post:
        self.d = community.scale_by_trait(self.d, self.traits, variable, self.targets)
        return self

    def def_groups(self, mapping: dict[str, str]) -> Post:
        self.d = community.sum_groups(self.d, mapping)
        return self

    def cwm(self, variable: str) -> Post:
        self.d = community.cwm(self.d, self.traits, variable, self.targets)
        return self

    def diversity(self, base: float | None = None) -> Post:
        self.d = community.diversity(self.d, self.targets, base)
        return self

    def total(self) -> Post:
        self.d = community.total(self.d, self.targets)
        return self

    def process_resampled_runs(self) -> Post:
        self.d = community.resample_stats(self.d, self.targets)
        return self

    def merge_env(self, environment: DataFrame) -> Post:
        self.d = joins.join_env(self.d, environment, keys_of(self.d))
        return self

    def merge_obs(self, observations: DataFrame, name: str, targets: list[str] | None = None) -> DataFrame:
        out = joins.residuals(self.d, observations, targets or self.targets, keys_of(self.d))
        write_csv(out, f"{self.posts}/{name}_obs")
        return out

    def export_field(self, name: str, author: str | None = None, description: str | None = None) -> None:
        path = f"{self.posts}/{name}_{self.statistic}"
        write_field(self.d, path, author=author, description=description)

    def export_csv(self, name: str) -> None:
        write_csv(self.d, f"{self.posts}/{name}_{self.statistic}_csv")

    def integrated_totals(self, targets: list[str] | None = None, export: bool = True, **options) -> DataFrame:
        """Totals of all wanted columns; targets without a field are left out and reported."""
        totals, missing = integrate.integrated_totals(self.d, targets or self.targets, **options)
        if missing:
            print(f"no predictions for {missing}")
        if export:
            depth = options.get("subset_depth")
            suffix = (f"_depth_{depth}m" if depth else "") + (
                "_monthly_int" if options.get("monthly") else ""
            )
            name = f"{self.model}_integrated_totals_{self.statistic}{suffix}"
            write_report(totals, f"{self.posts}/integrated_totals/{name}")
        return totals

    def estimate_applicability(
        self, train: DataFrame, grid: DataFrame, targets: list[str] | None = None,
        drop_zeros: bool = False, repeats: int = 10, **options,
    ) -> DataFrame:
        """Applicability of each target's ensemble, weighted by permutation importance.

        Columns `<target>_aoa`, `_di`, `_cutpoint` (and `_lpd`) next to the grid keys.
        """
        targets = targets or self.targets
        features = self.config.predictors
        part = "zir" if self.config.two_phase else "reg"
        name = "ens" if len(self.config.models) > 1 else self.config.models[0]
        models = load_models(self.spark, self.config.path, [(name, t, part) for t in targets])
        keys = keys_of(grid)
        cells = stored(
            grid.select(*keys, *[col(f) for f in features]).withColumn(
                "_cell", F.monotonically_increasing_id()
            ),
            "grid",
        )
        # every target adds its columns in place: the grid is read once and never joined; sums over
        # its cells read the plain grid, so that no earlier target is worked out again
        out = cells
        for target in targets:
            known = complete(train, [*features, target])
            if drop_zeros:
                known = known.where(col(target) > 0)
            rows = known.select(*[col(f) for f in features], col(target).alias("_y"))
            rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "train")
            importance = permutation_importance(
                models[name, target, part], rows, "_y", features, "_row", repeats, self.config.seed
            )
            weights = {r["feature"]: r["importance"] for r in importance.collect()}
            out = area_of_applicability(
                out, rows, features, "_cell", "_row", weights, "_y", scan=cells, **options
            )
            wanted = [c for c in ("aoa", "di", "lpd", "cutpoint") if c in out.columns]
            out = out.withColumnsRenamed({c: f"{target}_{c}" for c in wanted})
        out = out.drop("_cell", *features)
        write_applicability(out, f"{self.posts}/aoa")
        return out
