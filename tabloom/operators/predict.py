"""Predictions, intervals, nearest centroid, lag forecasts and test evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.neighbours import nearest_row, stacked
from tabloom.functions.quantiles import exact_quantiles
from tabloom.functions.scalar import normal_quantile
from tabloom.operators.metrics import CLASS_LIMIT
from tabloom.operators.timeseries import PERIOD, horizon, lag_features
from tabloom.operators.training import MetricPlan, Prepared, Trained, metric_plan, score_rows
from tabloom.session import cut

CUT_EVERY = 6
#: Numbers of one broadcast part of the centres (16 MB).
CENTER_VALUES = 2_000_000


def prediction_interval(
    df: DataFrame, prediction: str, residual_std: float, *, alpha: float = 0.05
) -> DataFrame:
    """Gaussian band around each prediction."""
    width = -normal_quantile(alpha / 2) * residual_std
    return df.withColumns({"lower": F.col(prediction) - width, "upper": F.col(prediction) + width})


def confidence_bands(
    points: DataFrame, residuals: DataFrame, point: str, residual: str, *, alpha: float = 0.05
) -> DataFrame:
    """Point plus the alpha/2 and 1 - alpha/2 residual quantiles; no residuals, no width."""
    low, high = exact_quantiles(residuals, [residual], [alpha / 2, 1 - alpha / 2])[residual]
    return points.withColumns({
        "lower": F.col(point) + F.lit(low or 0.0), "upper": F.col(point) + F.lit(high or 0.0),
    })


def nearest_centroid(df: DataFrame, centers: DataFrame, vector: str, *, cluster: str = "cluster") -> DataFrame:
    """Adds the cluster whose `center` is nearest, the smaller one of two. Centres are broadcast in parts of
    at most CENTER_VALUES numbers, and a row keeps the best of all parts, so any number of them will do."""
    context = df.sparkSession.sparkContext
    best, part, size, at = None, [], 0, 0

    def nearest_of(points: np.ndarray, start: int) -> Column:
        shared = context.broadcast(points)

        @F.pandas_udf("struct<d double, i long>")
        def run(vectors: pd.Series) -> pd.DataFrame:
            pick, d = nearest_row(stacked(vectors), shared.value)
            return pd.DataFrame({"d": d, "i": pick + start})

        return run(F.col(vector))

    numbered = centers.select(cluster, "center").orderBy(cluster)
    ids = []
    for r in numbered.toLocalIterator():
        ids.append((at + len(part), r[cluster]))
        part.append(r["center"])
        size += len(r["center"])
        if size >= CENTER_VALUES:
            here = nearest_of(np.asarray(part, float), at)
            best, at = here if best is None else F.least(best, here), at + len(part)
            part, size = [], 0
    if part:
        here = nearest_of(np.asarray(part, float), at)
        best = here if best is None else F.least(best, here)
    if best is None:
        raise ValueError("no centres")
    names = df.sparkSession.createDataFrame(ids, f"__i long, assigned {centers.schema[cluster].dataType.simpleString()}")
    names = F.broadcast(names) if len(ids) <= CLASS_LIMIT else names
    placed = df.withColumn("__best", best).withColumn("__i", F.col("__best.i"))
    return placed.join(names, "__i").select(*df.columns, "assigned")


def evaluate_test(trained: Trained, prepared: Prepared, plan: MetricPlan | None = None) -> DataFrame:
    """(metric, value) of a model on the held-out rows, by the run's own plan."""
    test = prepared.frame.filter(F.col("split") == "test").drop("split")
    plan = plan or metric_plan(prepared.frame, trained.task)
    values = score_rows(trained, test, plan)
    rows = [(m, None if values[m] is None else float(values[m])) for m in sorted(values)]
    return test.sparkSession.createDataFrame(rows, "metric string, value double")


@dataclass(frozen=True)
class LagForecaster:
    model: Any
    series: tuple[str, ...]
    lags: int

    def forecast(self, placed: DataFrame, steps: int) -> DataFrame:
        """Recursive forecast of every series: each step feeds its prediction back as the
        newest lag. One row per series is carried; lineage is cut every few steps."""
        recent = placed.filter(F.col("pos") >= F.col("n") - self.lags).groupBy(*self.series).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "y")), asc=False), lambda r: r["y"]).alias("h")
        )
        state = recent.filter(F.size("h") == self.lags).withColumn("out", F.expr("array()").cast("array<double>"))
        names = [f"y_lag_{k}" for k in range(1, self.lags + 1)]
        for step in range(horizon(steps)):
            wide = state.select("*", *[F.col("h")[k].alias(n) for k, n in enumerate(names)])
            vectors = VectorAssembler(inputCols=names, outputCol="features").transform(wide)
            scored = self.model.transform(vectors)
            state = scored.select(
                *self.series,
                F.concat(F.array("prediction"), F.slice("h", 1, self.lags - 1)).alias("h"),
                F.concat("out", F.array("prediction")).alias("out"),
            )
            if (step + 1) % CUT_EVERY == 0:
                state = cut(state)
        return state.select(*self.series, F.posexplode("out").alias("at", "forecast")).select(
            *self.series, (F.col("at") + 1).alias("step"), "forecast"
        )


def fit_lag_boosting(
    placed: DataFrame, series: Sequence[str], *, lags: int = PERIOD, learning_rate: float = 0.1,
    max_iter: int = 100, seed: int = 0,
) -> LagForecaster:
    """One boosted model over the lag features of all series. Up to `lags` lags, fewer where no
    series has three times as many rows. Series without enough rows for the lags neither train nor
    get a forecast; they do not lower the lags of the others."""
    longest = placed.agg(F.max("n")).first()[0]
    used = min(lags, (longest or 0) // 3)
    if used < 1:
        raise ValueError("lag boosting needs a series of three rows or more")
    names = [f"y_lag_{k}" for k in range(1, used + 1)]
    rows = lag_features(placed, series, lags=used).na.drop(subset=names)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    model = GBTRegressor(
        labelCol="y", stepSize=learning_rate, maxIter=max_iter, seed=seed
    ).fit(vectors.select("features", "y"))
    return LagForecaster(model, tuple(series), used)
