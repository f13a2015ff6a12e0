"""Findings drawn from column statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.profile import (
    CATEGORY_CAP, MINORITY_LIMIT, NUMERIC, SKEW_LIMIT, class_counts, rows_of, skew_expr, type_of,
    _present,
)
from tabloom.functions.scalar import to_number

# Limits of the advice.
MANY_FEATURES = 30
NEURAL_ROWS = 50_000


def data_advice(
    df: DataFrame, *, target: str | None = None, task_type: str | None = None,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """One row per finding: subject, finding and the statistic behind it."""
    features = list(features or [c for c in df.columns if c != target])
    text = [c for c in features if type_of(df, c) not in NUMERIC]
    aggs = [F.count("*").alias("rows")]
    aggs += [(F.count("*") - F.count(_present(df, c))).alias(f"m_{c}") for c in features]
    aggs += [F.countDistinct(_present(df, c)).alias(f"u_{c}") for c in text]
    if task_type == "regression" and target:
        aggs.append(skew_expr(to_number(f"`{target}`")).alias("skew"))
    stats = df.agg(*aggs)
    finding = lambda subject, name, value, hit: F.struct(
        F.lit(subject).alias("subject"), F.lit(name).alias("finding"),
        value.cast("double").alias("statistic"), hit.alias("hit"),
    )
    rows = [finding(c, "imputation needed", F.col(f"`m_{c}`"), F.col(f"`m_{c}`") > 0) for c in features]
    rows += [
        finding(c, "high cardinality", F.col(f"`u_{c}`"), F.col(f"`u_{c}`") > CATEGORY_CAP) for c in text
    ]
    rows.append(finding("table", "reduce dimensions", F.lit(len(features)), F.lit(len(features) > MANY_FEATURES)))
    rows.append(finding("table", "boosting before neural", F.col("rows"), F.col("rows") < NEURAL_ROWS))
    if task_type == "regression" and target:
        large = F.abs("skew") > SKEW_LIMIT
        rows.append(finding(target, "prefer MAE", F.col("skew"), large))
        rows.append(finding(target, "log transform", F.col("skew"), large))
    found = rows_of(stats, rows)
    if task_type in ("binary", "multiclass", "multilabel") and target:
        least = class_counts(df, target).agg(F.min("fraction").alias("f"))
        found = found.unionByName(least.select(
            F.lit(target).alias("subject"), F.lit("imbalanced metrics").alias("finding"),
            F.col("f").alias("statistic"), (F.col("f") < MINORITY_LIMIT).alias("hit"),
        ))
    return found.filter("hit").drop("hit")


def suggest_task(df: DataFrame, target: str) -> str:
    """forecasting, binary, multiclass or regression, from the type and the distinct values."""
    kind = type_of(df, target)
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return "forecasting"
    unique = df.agg(F.countDistinct(_present(df, target))).first()[0]
    if unique < 2:
        raise ValueError("the target needs at least two distinct values")
    if unique == 2:
        return "binary"
    if kind in NUMERIC and not (kind in ("byte", "short", "integer", "long") and unique <= CATEGORY_CAP):
        return "regression"
    return "multiclass"
