"""Run settings."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    """Settings of one run; `of` reads the nested dictionary form.

    models: names in order (rf, xgb, knn). two_phase: classifier plus regressor.
    param_grid: {model: {"reg": {name: [values]}, "clf": {...}}}.
    """

    path: str
    predictors: list[str]
    models: list[str]
    param_grid: dict
    two_phase: bool = False
    cv: int = 3
    stratify: bool = False
    upsample: bool = False
    seed: int = 0
    knn_bags: int = 30
    interval_bags: int = 160
    parallelism: int = 4
    scoring: str | None = None
    extra: dict = field(default_factory=dict)

    @staticmethod
    def of(settings: dict) -> Config:
        ensemble = settings["ensemble_config"]
        if not ensemble["regressor"]:
            raise ValueError("a run needs a regressor; classifiers alone are not supported")
        names = sorted(k for k in ensemble if k[0] == "m" and k[1:].isdigit())
        grids = {
            model.removesuffix("_param_grid"): {
                part.removesuffix("_param_grid"): grid for part, grid in parts.items()
            }
            for model, parts in settings["param_grid"].items()
        }
        folders = [settings.get("root", ""), settings["path_out"], settings["run_name"]]
        return Config(
            path="/".join(f.strip("/") if i else f.rstrip("/") for i, f in enumerate(folders) if f),
            predictors=list(settings["predictors"]),
            models=[ensemble[n] for n in names],
            param_grid=grids,
            two_phase=bool(ensemble["classifier"]),
            cv=settings["cv"],
            stratify=bool(settings.get("stratify", False)),
            upsample=bool(settings.get("upsample", False)),
            seed=settings.get("seed", 0),
            knn_bags=settings.get("knn_bagging_estimators", 30),
            interval_bags=settings.get("interval_bags", 160),
            parallelism=settings.get("n_threads", 4),
            scoring=settings.get("scoring"),
        )

    def grid(self, model: str, part: str) -> dict:
        return self.param_grid.get(model, {}).get(part, {})
