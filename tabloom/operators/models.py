"""Model catalogue: builders of Spark ML estimators with their parameters."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Estimator
from pyspark.ml import classification as mc
from pyspark.ml import regression as mr
from pyspark.ml.classification import OneVsRest
from pyspark.ml.clustering import KMeans

CLASSIFICATION = ("binary", "multiclass", "multilabel")
SUPERVISED = (*CLASSIFICATION, "regression", "forecasting")
MAX_TREE_DEPTH = 30
#: Depth of boosted trees where none is asked for.
BOOSTING_DEPTH = 5

# Hidden layer widths of the network presets.
PRESETS = {"small": (64,), "medium": (128, 64), "large": (256, 128, 64)}


@dataclass(frozen=True)
class Param:
    """A tunable value: default, range or options, and whether the range is logarithmic."""

    default: Any
    low: float | None = None
    high: float | None = None
    log: bool = False
    options: tuple = ()
    nullable: bool = False


@dataclass(frozen=True)
class Context:
    """What a builder may need to know about the train rows."""

    task_type: str
    rows: int
    classes: int = 0
    width: int = 0
    y_std: float = 1.0
    seed: int = 0


@dataclass(frozen=True)
class ModelSpec:
    name: str
    tasks: tuple[str, ...]
    family: str
    params: Mapping[str, Param] = field(default_factory=dict)
    build: Callable[[dict, Context], Estimator] | None = None
    handles_nan: bool = False
    has_proba: bool = False
    early_stopping: bool = False
    #: Whether `build` reads the number of rows or the spread of the target.
    row_stats: bool = False

    def defaults(self) -> dict[str, Any]:
        return {k: p.default for k, p in self.params.items()}


def _logistic(p, c):
    mix = {"l2": 0.0, "l1": 1.0, "elasticnet": 0.5}[p["penalty"]]
    out = mc.LogisticRegression(
        regParam=1.0 / (p["C"] * max(1, c.rows)), elasticNetParam=mix, maxIter=p["max_iter"],
        standardization=False,
    )
    return out.setWeightCol("weight") if p["class_weight"] == "balanced" else out


def _linear(p, c):
    return mr.LinearRegression(solver="normal", fitIntercept=p["fit_intercept"])


def _ridge(p, c):
    reg = p["alpha"] * c.y_std / max(1, c.rows)
    return mr.LinearRegression(
        solver="normal", regParam=reg, elasticNetParam=0.0, standardization=False,
        fitIntercept=p["fit_intercept"],
    )


def _lasso(p, c):
    return mr.LinearRegression(
        regParam=p["alpha"], elasticNetParam=1.0, standardization=False, maxIter=1000, tol=1e-9,
        fitIntercept=p["fit_intercept"],
    )


def _depth(value: int | None, default: int = MAX_TREE_DEPTH) -> int:
    """The depth of a tree, without one the default; Spark's trees end at 30, which is not exceeded in silence."""
    if value is None:
        return default
    if int(value) > MAX_TREE_DEPTH:
        raise ValueError(f"trees are at most {MAX_TREE_DEPTH} deep, not {value}")
    return int(value)


def _weighted(est, p):
    return est.setWeightCol("weight") if p.get("class_weight") == "balanced" else est


def _tree(p, c):
    common = dict(maxDepth=_depth(p["max_depth"]), minInstancesPerNode=p["min_samples_leaf"], seed=c.seed)
    if c.task_type in CLASSIFICATION:
        impurity = "gini" if p["criterion"] == "gini" else "entropy"
        return _weighted(mc.DecisionTreeClassifier(impurity=impurity, **common), p)
    return mr.DecisionTreeRegressor(**common)


def _forest(p, c):
    common = dict(
        numTrees=p["n_estimators"], maxDepth=_depth(p["max_depth"]),
        minInstancesPerNode=p["min_samples_leaf"], seed=c.seed,
    )
    if c.task_type in CLASSIFICATION:
        return _weighted(mc.RandomForestClassifier(**common), p)
    return mr.RandomForestRegressor(**common)


def _boosting(p, c):
    depth = _depth(p["max_depth"], default=BOOSTING_DEPTH)
    common = dict(stepSize=p["learning_rate"], maxDepth=depth, maxIter=p["max_iter"], seed=c.seed)
    stop = dict(validationIndicatorCol="validation", validationTol=1e-4)
    if c.task_type == "regression":
        return mr.GBTRegressor(**stop, **common)
    if c.classes <= 2:
        return mc.GBTClassifier(**stop, **common)
    return OneVsRest(classifier=mc.GBTClassifier(**common))


def _mlp(p, c):
    hidden = p["hidden"] or PRESETS[p["preset"]]
    return mc.MultilayerPerceptronClassifier(
        layers=[c.width, *hidden, max(2, c.classes)], maxIter=p["epochs"], seed=c.seed
    )


def _kmeans(p, c):
    return KMeans(k=p["n_clusters"], seed=c.seed)


_TREE = {
    "max_depth": Param(None, 2, 30, nullable=True), "min_samples_leaf": Param(1, 1, 50),
    "class_weight": Param(None, options=(None, "balanced")),
}
_FIT = {"fit_intercept": Param(True, options=(True, False))}
_CR = (*CLASSIFICATION, "regression")

MODELS: dict[str, ModelSpec] = {m.name: m for m in (
    ModelSpec("logistic_regression", CLASSIFICATION, "linear", {
        "C": Param(1.0, 1e-4, 100.0, True), "penalty": Param("l2", options=("l2", "l1", "elasticnet")),
        "class_weight": Param(None, options=(None, "balanced")), "max_iter": Param(1000, 100, 10000),
    }, _logistic, has_proba=True, row_stats=True),
    ModelSpec("linear_regression", ("regression",), "linear", dict(_FIT), _linear),
    ModelSpec("ridge", ("regression",), "linear", {"alpha": Param(1.0, 1e-4, 100.0, True), **_FIT}, _ridge,
              row_stats=True),
    ModelSpec("lasso", ("regression",), "linear", {"alpha": Param(0.1, 1e-4, 10.0, True), **_FIT}, _lasso),
    ModelSpec("decision_tree", _CR, "tree", {
        **_TREE, "criterion": Param("gini", options=("gini", "entropy", "log_loss"))}, _tree, has_proba=True),
    ModelSpec("random_forest", _CR, "tree", {"n_estimators": Param(300, 50, 2000), **_TREE}, _forest, has_proba=True),
    ModelSpec("hist_gradient_boosting", _CR, "tree", {
        "learning_rate": Param(0.1, 0.001, 0.5, True), "max_depth": Param(None, 2, 30, nullable=True),
        "max_iter": Param(200, 50, 2000)}, _boosting, handles_nan=True, has_proba=True, early_stopping=True),
    ModelSpec("mlp", CLASSIFICATION, "neural", {
        "preset": Param("medium", options=tuple(PRESETS)), "hidden": Param(None), "epochs": Param(100, 10, 500)},
        _mlp, has_proba=True),
    ModelSpec("kmeans", ("clustering",), "centroid", {
        "n_clusters": Param(8, 2, 50), "n_init": Param(10, 1, 50)}, _kmeans),
    ModelSpec("pca", ("dimensionality_reduction",), "linear", {
        "n_components": Param(None, 2, 500, nullable=True), "variance_target": Param(0.95, 0.8, 0.999)}),
    ModelSpec("isolation_forest", ("anomaly_detection",), "tree", {
        "n_estimators": Param(200, 50, 1000), "contamination": Param(0.05, 0.001, 0.5),
        "max_features": Param(1.0, 0.1, 1.0)}),
    ModelSpec("lof", ("anomaly_detection",), "density", {
        "n_neighbors": Param(20, 2, 100), "contamination": Param(0.05, 0.001, 0.5)}),
    ModelSpec("naive", ("forecasting",), "forecast"),
    ModelSpec("seasonal_naive", ("forecasting",), "forecast", {"period": Param(12, 2, 366)}),
    ModelSpec("lag_boosting", ("forecasting",), "forecast", {
        "lags": Param(12, 2, 100), "learning_rate": Param(0.1, 0.01, 0.5, True), "max_iter": Param(100, 10, 1000)}),
    ModelSpec("apriori", ("association",), "association", {
        "min_support": Param(0.1, 0.01, 1.0), "min_confidence": Param(0.3, 0.01, 1.0),
        "min_lift": Param(1.0, 0.5, 10.0), "max_len": Param(3, 2, 4)}),
)}


def spec_of(name: str, task_type: str) -> ModelSpec:
    spec = MODELS.get(name)
    if spec is None:
        raise ValueError(f"unknown model '{name}'")
    if task_type not in spec.tasks:
        raise ValueError(f"model '{name}' does not fit the task '{task_type}'")
    return spec


def draw(spec: ModelSpec, rng: random.Random, frozen: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """One random parameter set; `frozen` values are not drawn."""
    out = {}
    for name, p in spec.params.items():
        if frozen and name in frozen:
            out[name] = frozen[name]
        elif p.options:
            out[name] = rng.choice(p.options)
        elif p.low is None:
            out[name] = p.default
        elif p.nullable and rng.random() < 0.5:
            out[name] = None
        elif isinstance(p.default, float):
            low, high = (math.log(p.low), math.log(p.high)) if p.log else (p.low, p.high)
            value = rng.uniform(low, high)
            out[name] = math.exp(value) if p.log else value
        else:
            out[name] = rng.randint(int(p.low), int(p.high))
    return out
