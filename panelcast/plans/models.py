"""Registry of regressors on ``pyspark.ml``.

Boosted models of other libraries are represented by Spark's gradient-boosted
trees, extremely randomised trees by a forest that sees a third of the features at
each split.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Estimator
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression,
                                   LinearRegression, RandomForestRegressor)

SEED = 42
COLUMNS = {"featuresCol": "features", "labelCol": "label", "predictionCol": "prediction"}


def _boosted(**kw) -> Estimator:
    return GBTRegressor(**{"maxIter": 30, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, "minInstancesPerNode": 10,
                           "seed": SEED, **COLUMNS, **kw})


def _forest(**kw) -> Estimator:
    return RandomForestRegressor(**{"numTrees": 100, "maxDepth": 8, "minInstancesPerNode": 5, "seed": SEED, **COLUMNS, **kw})


def _ridge(**kw) -> Estimator:
    return LinearRegression(**{"regParam": 1.0, "elasticNetParam": 0.0, "solver": "normal", **COLUMNS, **kw})


def _lasso(**kw) -> Estimator:
    return LinearRegression(**{"regParam": 1.0, "elasticNetParam": 1.0, **COLUMNS, **kw})


def _poisson(**kw) -> Estimator:
    return GeneralizedLinearRegression(**{"family": "poisson", "link": "log", "regParam": 0.1, "maxIter": 50, **COLUMNS, **kw})


@dataclass(frozen=True)
class ModelSpec:
    factory: Callable[..., Estimator]
    supports_objective: bool = False
    supports_quantile: bool = False
    help: str = ""


MODEL_REGISTRY: dict[str, ModelSpec] = {
    "XGBoost": ModelSpec(_boosted, True, True, "gradient-boosted trees, the default"),
    "LightGBM": ModelSpec(lambda **kw: _boosted(**{"maxDepth": 5, "maxIter": 20, **kw}), True, True, "deeper, fewer boosted trees"),
    "HistGradientBoosting": ModelSpec(lambda **kw: _boosted(**{"subsamplingRate": 1.0, **kw}), True, True, "boosting without row sampling"),
    "GradientBoosting": ModelSpec(lambda **kw: _boosted(**{"maxDepth": 3, **kw}), help="shallow boosted trees"),
    "RandomForest": ModelSpec(_forest, help="random forest"),
    "ExtraTrees": ModelSpec(lambda **kw: _forest(**{"featureSubsetStrategy": "onethird", **kw}), help="strongly randomised forest"),
    "Ridge": ModelSpec(_ridge, help="linear reference"),
    # kept from the first version of the measles page
    "Lasso": ModelSpec(_lasso, help="sparse linear model"),
    "DecisionTree": ModelSpec(lambda **kw: DecisionTreeRegressor(**{"maxDepth": 10, "seed": SEED, **COLUMNS, **kw}), help="single tree"),
}
DEFAULT_MODEL = "XGBoost"
OBJECTIVES = ("squared_error", "poisson", "quantile")


def available_models() -> list[str]:
    return list(MODEL_REGISTRY)


def describe_model(name: str) -> str:
    return MODEL_REGISTRY[name].help if name in MODEL_REGISTRY else ""


def resolve_objective(name: str, objective: str) -> str:
    """Objective the model can honour; everything else is squared error."""
    spec = MODEL_REGISTRY.get(name)
    if spec is None or objective not in OBJECTIVES or not spec.supports_objective:
        return "squared_error"
    if objective == "quantile" and not spec.supports_quantile:
        return "squared_error"
    return objective


def make_model(name: str = DEFAULT_MODEL, objective: str = "squared_error", quantile: float | None = None,
               **overrides) -> Estimator:
    """Estimator of the registry.

    A count objective uses a Poisson regression with log link; a quantile objective
    fits the centre, the quantile itself comes from the residuals (``predict_quantiles``).
    """
    if name not in MODEL_REGISTRY:
        raise KeyError(f"unknown model {name!r}; available: {available_models()}")
    if resolve_objective(name, objective) == "poisson":
        return _poisson(**overrides)
    return MODEL_REGISTRY[name].factory(**overrides)


@dataclass
class ModelFactory:
    """Picklable ``() -> Estimator`` with a display name."""

    name: str = DEFAULT_MODEL
    objective: str = "squared_error"
    overrides: dict = field(default_factory=dict)

    def __call__(self) -> Estimator:
        return make_model(self.name, self.objective, **self.overrides)
