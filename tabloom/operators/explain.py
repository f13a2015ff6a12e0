"""Explanations of fitted models."""

from __future__ import annotations

import statistics
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.hashing import unit_hash
from tabloom.functions.prefix import row_positions
from tabloom.functions.quantiles import exact_quantiles
from tabloom.operators import clusters as K
from tabloom.operators import metrics as M
from tabloom.operators.models import CLASSIFICATION
from tabloom.operators.profile import NUMERIC, type_of
from tabloom.operators.training import Trained, pca_parts

# Sizes of the explanations.
GRID_POINTS = 100
REPEATS = 3
GRADIENT_STEPS = 32
SPREAD = 0.85
SURROGATE_DEPTH = 4


def _coefficients(trained: Trained) -> np.ndarray:
    m = trained.model
    if hasattr(m, "coefficientMatrix") and len(trained.labels) > 2:
        return np.abs(m.coefficientMatrix.toArray()).mean(axis=0)
    return np.asarray(m.coefficients.toArray())


def explain_linear(trained: Trained, spark) -> DataFrame:
    """Coefficients by size; the odds ratio for a binary model."""
    import math

    binary = len(trained.labels) == 2
    rows = [
        (n, float(c), math.exp(min(float(c), 700.0)) if binary else None)
        for n, c in zip(trained.features.names, _coefficients(trained))
    ]
    rows.sort(key=lambda r: (-abs(r[1]), r[0]))
    return spark.createDataFrame(rows, "feature string, coefficient double, odds_ratio double")


def explain_linear_local(trained: Trained, df: DataFrame) -> DataFrame:
    """Contribution (coefficient x prepared value) of every feature, for all rows."""
    x = vector_to_array("features")
    return trained.vectors(df).select(trained.task.key, *[
        (x[i] * F.lit(float(c))).alias(n)
        for i, (n, c) in enumerate(zip(trained.features.names, _coefficients(trained)))
    ])


def explain_tree(trained: Trained, spark) -> DataFrame:
    """Built-in feature importances; for one-vs-rest, their mean over the classes."""
    models = getattr(trained.model, "models", [trained.model])
    values = np.mean([m.featureImportances.toArray() for m in models], axis=0)
    rows = sorted(zip(trained.features.names, map(float, values)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def _default_score(trained: Trained, df: DataFrame) -> float:
    scored = trained.predict(df).withColumn("truth", F.col(trained.task.target))
    if trained.task.task_type in CLASSIFICATION:
        return scored.agg(F.avg((F.col("truth") == F.col("prediction")).cast("double"))).first()[0]
    return M.regression_scores(scored).first()["r2"]


def shuffled(df: DataFrame, key: str, column: str, seed: int | str) -> DataFrame:
    """The table with one column permuted: rows in one hash order receive the values of the
    rows in another."""
    to = row_positions(df.withColumn("__h", unit_hash(key, seed=f"a{seed}")), "__h", out="__pos", uniform=True)
    donors = df.select(F.col(f"`{column}`").alias("__v"), unit_hash(key, seed=f"b{seed}").alias("__h"))
    given = row_positions(donors, "__h", out="__pos", uniform=True).select("__pos", "__v")
    return to.join(given, "__pos").withColumn(column, F.col("__v")).select(*df.columns)


def explain_permutation(
    trained: Trained, df: DataFrame, *, repeats: int = REPEATS, features: Sequence[str] | None = None
) -> DataFrame:
    """Score drop when one input column is shuffled: mean and std (population) over repeats.
    `spread` warns when the second importance is close to the first."""
    inputs = list(features or (*trained.features.numeric, *trained.features.categorical))
    df = df.select(trained.task.key, trained.task.target, *inputs).persist()
    base = _default_score(trained, df)
    rows = []
    for c in inputs:
        drops = [
            base - _default_score(trained, shuffled(df, trained.task.key, c, f"{c}:{r}")) for r in range(repeats)
        ]
        rows.append((c, float(np.mean(drops)), float(statistics.pstdev(drops))))
    df.unpersist()
    rows.sort(key=lambda r: (-r[1], r[0]))
    strength = np.sort(np.abs([r[1] for r in rows]))
    close = bool(np.sum([r[1] for r in rows]) > 0 and (strength[-2:-1] > SPREAD * strength[-1:]).any())
    return df.sparkSession.createDataFrame(
        [(*r, close) for r in rows], "feature string, importance double, std double, spread boolean"
    )


def _grid(df: DataFrame, column: str) -> list[float]:
    found = df.select(F.col(f"`{column}`").cast("double").alias("v")).na.drop().distinct()
    values = [r["v"] for r in found.limit(GRID_POINTS + 1).collect()]
    if len(values) <= GRID_POINTS:
        return sorted(values)
    low, high = exact_quantiles(df, [column], [0.05, 0.95])[column]
    return [float(v) for v in np.linspace(low, high, GRID_POINTS)]


def explain_pdp_ice(
    trained: Trained, df: DataFrame, *, features: Sequence[str] | None = None,
    curves_of: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Response over a grid of every numeric input (or of `features`): the average over all rows of
    `df` (partial dependence), and the curve of every row (individual expectations), or of the rows with a key
    of `curves_of`."""
    task = trained.task
    chosen = features or [n for n in trained.features.numeric if type_of(df, n) in NUMERIC]
    average, curves = None, None
    for c in chosen:
        grid = F.explode(F.expr(f"array({', '.join(f'{v!r}D' for v in _grid(df, c))})"))
        scored = trained.predict(df.withColumn("__g", grid).withColumn(c, F.col("__g")))
        response = f"p_{trained.labels[-1] if trained.labels else ''}"
        points = scored.select(
            F.lit(c).alias("feature"), task.key, F.col("__g").alias("grid"),
            F.col(response if response in scored.columns else "prediction").cast("double").alias("response"),
        )
        mean = points.groupBy("feature", "grid").agg(F.avg("response").alias("average"))
        average = mean if average is None else average.unionByName(mean)
        every = curves_of is None or curves_of is df
        own = points if every else points.join(curves_of.select(task.key).distinct(), task.key)
        curves = own if curves is None else curves.unionByName(own)
    return {"average": average, "ice": curves}


def _network(trained: Trained) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights out x in, bias) per layer of a fitted perceptron."""
    layers, flat, at, out = trained.model.getLayers(), trained.model.weights.toArray(), 0, []
    for width, height in zip(layers, layers[1:]):
        w = flat[at : at + width * height].reshape((height, width), order="F")
        at += width * height
        out.append((w, flat[at : at + height]))
        at += height
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    """Logistic function without overflow, by the identity with the hyperbolic tangent."""
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _class_gradient(layers, x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gradient of the probability of class `target` at each row of `x`.

    The network is a chain of maps; its Jacobian is multiplied out from the input on, so that
    after the last layer `jac[r]` holds d logits / d inputs of row r, and the softmax Jacobian
    row diag(p) - p p' picks the class."""
    jac, a = None, x
    for depth, (w, b) in enumerate(layers, 1):
        z = a @ w.T + b
        jac = np.broadcast_to(w, (len(x), *w.shape)) if jac is None else np.einsum("oh,rhi->roi", w, jac)
        if depth < len(layers):
            a = _sigmoid(z)
            jac = jac * (a - a * a)[:, :, None]
    p = _softmax(z)
    row = p[np.arange(len(x)), target, None] * (np.eye(p.shape[1])[target] - p)
    return np.einsum("ro,roi->ri", row, jac)


def _softmax(z: np.ndarray) -> np.ndarray:
    return 1.0 / np.exp(z[:, None, :] - z[:, :, None]).sum(axis=2)


def _most_likely(layers, x: np.ndarray) -> np.ndarray:
    for w, b in layers[:-1]:
        x = _sigmoid(x @ w.T + b)
    return (x @ layers[-1][0].T + layers[-1][1]).argmax(axis=1)


def integrated_gradients(
    trained: Trained, df: DataFrame, *, steps: int = GRADIENT_STEPS
) -> DataFrame:
    """Attribution of the predicted-class probability to every prepared feature: the mean gradient
    along the straight path from zero, at the midpoints of `steps` pieces, times the value."""
    layers, key, names = _network(trained), trained.task.key, trained.features.names
    kind = df.schema[key].dataType.simpleString()
    rows = trained.vectors(df).select(key, vector_to_array("features").alias("x"))
    shipped = df.sparkSession.sparkContext.broadcast(layers)
    path = (np.arange(steps) + 0.5) / steps

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shipped.value
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), len(names))
            mean = np.zeros_like(x)
            for at in range(0, len(x), 64):  # all steps of 64 rows are one stacked batch
                part = x[at : at + 64]
                stack = (path[:, None, None] * part).reshape(-1, part.shape[1])
                slopes = _class_gradient(net, stack, np.tile(_most_likely(net, part), steps))
                mean[at : at + 64] = slopes.reshape(steps, *part.shape).mean(axis=0)
            values = pd.DataFrame(mean * x, columns=names, index=pdf.index)
            yield pd.concat([pdf[[key]], values], axis=1)

    schema = ", ".join([f"`{key}` {kind}", *[f"`{n}` double" for n in names]])
    return rows.mapInPandas(run, schema)


def explain_ig(trained: Trained, df: DataFrame) -> DataFrame:
    """mean |attribution| and mean attribution per feature, over all rows."""
    from tabloom.operators.profile import rows_of

    names = trained.features.names
    stats = integrated_gradients(trained, df).agg(*[
        a for i, n in enumerate(names)
        for a in (F.avg(F.abs(f"`{n}`")).alias(f"a{i}"), F.avg(f"`{n}`").alias(f"m{i}"))
    ])
    return rows_of(stats, [
        F.struct(F.lit(n).alias("feature"), F.col(f"a{i}").alias("mean_abs"), F.col(f"m{i}").alias("mean"))
        for i, n in enumerate(names)
    ]).orderBy(F.desc("mean_abs"), "feature")


def explain_clusters(df: DataFrame, cluster: str, features: Sequence[str]) -> dict[str, DataFrame]:
    """Centroids, F ratios, personas, and importances of a shallow tree that predicts the
    cluster."""
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(
        df.select(F.col(cluster).cast("double").alias("label"), *[F.col(f"`{c}`").cast("double").alias(c) for c in features])
    )
    tree = DecisionTreeClassifier(maxDepth=SURROGATE_DEPTH).fit(rows)
    importances = [(c, float(v)) for c, v in zip(features, tree.featureImportances.toArray())]
    return {
        "centroids": K.centroid_table(df, cluster, features),
        "anova": K.anova_f(df, cluster, features),
        "personas": K.top_personas(df, cluster, features),
        "surrogate_tree": df.sparkSession.createDataFrame(importances, "feature string, importance double"),
    }


def explain_pca(trained: Trained, df: DataFrame) -> dict[str, DataFrame]:
    """Loadings, explained variance and reconstruction error per feature."""
    spark, names = df.sparkSession, trained.features.names
    pc = trained.model.stages[1].pc.toArray()
    loadings = [
        (f"PC{k + 1}", n, float(pc[j, k])) for k in range(pc.shape[1]) for j, n in enumerate(names)
    ]
    variance = [(f"PC{k + 1}", float(v)) for k, v in enumerate(trained.extra["explained"])]
    gaps = pca_parts(trained, df).select(
        F.posexplode(F.zip_with("x", "back", lambda a, b: (a - b) * (a - b))).alias("j", "e")
    )
    errors = gaps.groupBy("j").agg(F.avg("e").alias("mean_squared_error"))
    labels = F.array(*[F.lit(n) for n in names])
    return {
        "loadings": spark.createDataFrame(loadings, "pc string, feature string, loading double"),
        "variance_explained": spark.createDataFrame(variance, "pc string, explained double"),
        "reconstruction_error": errors.select(
            F.element_at(labels, F.col("j") + 1).alias("feature"), "mean_squared_error"),
    }


def explain_anomaly(df: DataFrame, flag: str, features: Sequence[str]) -> dict[str, DataFrame]:
    return {"per_feature_deviation": K.top_deviations(df, flag, features)}


def explain_model(trained: Trained, df: DataFrame) -> dict[str, DataFrame]:
    """The explanation tables of a model, by task and family."""
    spark, kind, family = df.sparkSession, trained.task.task_type, trained.spec.family
    numeric = list(trained.features.numeric)
    if kind == "clustering":
        return explain_clusters(trained.predict(df), "prediction", numeric)
    if kind == "dimensionality_reduction":
        return explain_pca(trained, df)
    if kind == "anomaly_detection":
        return explain_anomaly(trained.predict(df), "prediction", numeric)
    if family == "linear":
        return {"coefficients": explain_linear(trained, spark), "local": explain_linear_local(trained, df),
                **explain_pdp_ice(trained, df)}
    if family == "tree":
        return {"importances": explain_tree(trained, spark), **explain_pdp_ice(trained, df)}
    return {"integrated_gradients": explain_ig(trained, df), "permutation": explain_permutation(trained, df)}
