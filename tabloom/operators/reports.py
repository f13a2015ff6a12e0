"""Report bundles: named, lazily evaluated tables per task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators import profile as P


def base_report(df: DataFrame) -> dict[str, DataFrame]:
    """Shape, types, missing values, describe, correlations and categorical association."""
    numeric = P.numeric_columns(df)
    categorical = [c for c in df.columns if P.type_of(df, c) == "string"]
    out = {
        "shape": df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns")),
        "schema": P.schema_report(df),
        "missing": P.missing_counts(df),
    }
    if numeric:
        out["describe"] = P.describe_numeric(df, numeric)
    if len(numeric) > 1:
        out["pearson"] = P.corr_pearson(df, numeric)
        out["spearman"] = P.corr_spearman(df, numeric)
    if len(P._low_cardinality(df, categorical, P.CATEGORY_CAP)) > 1:
        out["cramers_v"] = P.cramers_v(df, categorical)
    return out


def long_report(
    tables: Mapping[str, DataFrame],
    parts: Mapping[str, tuple[str, str | None, str | None, str]],
) -> DataFrame:
    """Stack chosen columns of a bundle into (part, a, b, value)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")
    rows = [
        tables[name].select(
            F.lit(part).alias("part"), text(a).alias("a"), text(b).alias("b"),
            F.col(value).cast("double").alias("value"),
        )
        for part, (name, a, b, value) in parts.items()
        if name in tables
    ]
    return reduce(DataFrame.unionByName, rows)


def classification_report(
    df: DataFrame, target: str, features: Sequence[str]
) -> dict[str, DataFrame]:
    """Class counts, feature x class counts of low-cardinality features, chi-square."""
    low = P._low_cardinality(df, features, P.CATEGORY_CAP)
    categorical = [c for c in features if P.type_of(df, c) not in P.NUMERIC]
    out = {"class_counts": P.class_counts(df, target)}
    if low:
        cells = P._contingency(df, [(f, target) for f in low])
        out["feature_by_class"] = cells.select(
            F.col("left").alias("feature"), F.col("x").alias("value"),
            F.col("y").alias("class"), F.col("n").alias("count"),
        )
    if categorical:
        out["chi_square"] = P.chi_square(df, target, categorical)
    return out


def anomaly_report(df: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    return {
        "zscore": P.zscore_flags(df, columns),
        "iqr": P.iqr_flags(df, columns),
        "mahalanobis": P.mahalanobis(df, columns),
    }


def dimred_report(df: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    return {
        "correlation_groups": P.correlation_groups(df, columns),
        "vif": P.vif(df, columns),
    }


def clustering_report(df: DataFrame, key: str, columns: Sequence[str]) -> dict[str, DataFrame]:
    from tabloom.operators.clusters import hopkins

    rows = df.select(key, F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("vector"))
    return {
        "hopkins": hopkins(rows.filter(~F.exists("vector", lambda v: v.isNull())), key, "vector"),
        "scree": P.scree(df, columns), "components_for_90": P.components_for(df, columns),
    }


def eda_report(df: DataFrame, task) -> dict[str, DataFrame]:
    """Base views and the views of the task, as lazily evaluated tables."""
    from tabloom.operators import association, timeseries

    columns = [c for c in task.inputs(df) if c in P.numeric_columns(df)]
    kind = task.task_type
    if kind == "association":
        baskets = association.baskets_from_wide(df.select(task.key, *task.inputs(df)), task.inputs(df))
        long = baskets.select(F.col(task.key).alias("basket"), F.explode("items").alias("item"))
        return {"schema": P.schema_report(df), **association.association_report(long)}
    out = base_report(df)
    if kind in ("binary", "multiclass", "multilabel"):
        out |= classification_report(df, task.target, task.inputs(df))
    elif kind == "regression":
        views = P.regression_report(df, task.target, task.inputs(df))
        out |= {f"target_{name}": view for name, view in views.items()}
    elif kind == "forecasting":
        series = [task.group] if task.group else []
        out |= timeseries.timeseries_report(df, series, task.time_column, task.target)
    elif kind == "clustering":
        out |= clustering_report(df, task.key, columns)
    elif kind == "anomaly_detection":
        out |= anomaly_report(df, columns)
    elif kind == "dimensionality_reduction":
        out |= dimred_report(df, columns)
    return out
