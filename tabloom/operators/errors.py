"""Error analysis of predictions, clusters and anomaly scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.prefix import row_positions
from tabloom.functions.quantiles import exact_quantiles
from tabloom.functions.scalar import norm_ppf
from tabloom.operators.metrics import CLASS_LIMIT, confusion_counts, label_union
from tabloom.operators.profile import (
    _low_cardinality, categorical_columns, histogram_table, spearman_pair, type_of, NUMERIC,
)

WORST = 10
HISTOGRAM_BINS = 20
MOST_CONFUSED = 5
IMBALANCE_RATIO = 2.0


def row_error(df: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """Adds the signed `residual` and its size `error`; for labels, a 0/1 mismatch."""
    if type_of(df, truth) in NUMERIC:
        residual = F.col(prediction).cast("double") - F.col(truth).cast("double")
        return df.withColumns({"residual": residual, "error": F.abs(residual)})
    miss = (~F.col(truth).eqNullSafe(F.col(prediction))).cast("double")
    return df.withColumns({"residual": miss, "error": miss})


def worst_n(df: DataFrame, by: str, key: str, *, n: int = WORST, largest: bool = True) -> DataFrame:
    return df.orderBy(F.desc(by) if largest else F.asc(by), key).limit(n)


def segment_errors(
    df: DataFrame, segments: Sequence[str] | None = None, *, error: str = "error",
    target: str | None = None,
) -> DataFrame:
    """Mean error and rows per value of every segment column (all categorical columns unless
    named), in one pass over the rows."""
    columns = [c for c in (segments or categorical_columns(df)) if c != target]
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column string, value string, mean_abs_error double, rows long")
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns
    ]))
    return (
        df.select(F.col(f"`{error}`").alias("__e"), cells.alias("__s")).groupBy("__s")
        .agg(F.avg("__e").alias("mean_abs_error"), F.count("*").alias("rows"))
        .select("__s.column", "__s.value", "mean_abs_error", "rows")
        .orderBy("column", F.desc("mean_abs_error"), "value")
    )


def dense_confusion(df: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """Every (true, predicted) label pair with its count and its share of the true label;
    the share is NULL for a label that is never true."""
    counts = confusion_counts(df, truth, prediction)
    labels = [r["label"] for r in label_union(df, truth, prediction).limit(CLASS_LIMIT + 1).collect()]
    if len(labels) > CLASS_LIMIT:
        raise ValueError(f"more than {CLASS_LIMIT} labels")
    spark = df.sparkSession
    kind = df.schema[truth].dataType.simpleString()
    rows = spark.createDataFrame([(v, labels) for v in labels], f"truth {kind}, prediction array<{kind}>")
    every = rows.withColumn("prediction", F.explode("prediction"))
    full = every.join(counts, ["truth", "prediction"], "left").fillna(0, ["n"])
    row_total = F.sum("n").over(Window.partitionBy("truth"))
    return full.select("truth", "prediction", "n", (F.col("n") / F.nullif(row_total, F.lit(0))).alias("share"))


def top_confused(df: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """The most frequent wrong label pairs, pairs never seen included."""
    wrong = dense_confusion(df, truth, prediction).filter(F.col("truth") != F.col("prediction"))
    return wrong.select(F.col("n").alias("count"), "truth", "prediction").orderBy(
        F.desc("count"), F.desc("truth"), F.desc("prediction")
    ).limit(MOST_CONFUSED)


def residual_points(df: DataFrame, key: str) -> DataFrame:
    return row_error(df).select(key, "prediction", "residual")


def residual_histogram(df: DataFrame) -> DataFrame:
    return histogram_table(row_error(df), "residual", HISTOGRAM_BINS, right_closed=False)


def qq_points(df: DataFrame, key: str) -> DataFrame:
    """Each residual with its normal quantile at (rank + 0.5) / n."""
    placed = row_positions(row_error(df).select(key, "residual"), "residual", tie=key, total="n")
    at = (F.col("pos") + 0.5) / F.col("n")
    return placed.select(key, "residual", at.alias("plotting_position"), norm_ppf(at).alias("theoretical"))


def heteroscedasticity(df: DataFrame) -> DataFrame:
    """Spearman correlation of |residual| with |prediction|."""
    rows = row_error(df).select(F.col("error").alias("a"), F.abs("prediction").alias("b"))
    return spearman_pair(rows, "a", "b").select(F.col("rho").alias("spearman"))


def error_by_quantile(df: DataFrame, *, parts: int = 4) -> DataFrame:
    """Mean |residual| per quantile range of the truth (right-closed, equal edges merged)."""
    edges = exact_quantiles(df, ["truth"], [i / parts for i in range(parts + 1)])["truth"]
    edges = sorted({e for e in edges if e is not None})
    y = F.col("truth").cast("double")
    bucket = F.lit(1)
    for edge in edges[1:-1]:
        bucket = bucket + (y > edge).cast("int")
    rows = row_error(df).filter(y.isNotNull()).groupBy(bucket.alias("bin"))
    means = rows.agg(F.avg("error").alias("mean_abs_error"), F.count("*").alias("rows"))
    bounds = F.array(*[F.lit(float(e)) for e in edges])
    return means.select(
        "bin", F.element_at(bounds, F.col("bin")).alias("lower"),
        F.element_at(bounds, F.least(F.col("bin") + 1, F.lit(len(edges)))).alias("upper"),
        "mean_abs_error", "rows",
    )


def cluster_imbalance(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Cluster sizes with the ratio of the largest to the smallest and a warning from two on."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("size"))
    ratio = sizes.select(F.round(F.max("size") / F.min("size"), 4)).scalar()
    return sizes.select("*", ratio.alias("ratio"), (ratio >= IMBALANCE_RATIO).alias("imbalanced"))


def anomaly_confusion(df: DataFrame, label: str, flag: str) -> DataFrame:
    y, f = F.col(label) != 0, F.col(flag) != 0
    return df.agg(
        F.count_if(y & f).alias("tp"), F.count_if(~y & f).alias("fp"),
        F.count_if(y & ~f).alias("fn"), F.count_if(~y & ~f).alias("tn"),
    )


def flag_filter(df: DataFrame, score: str, threshold: float, key: str) -> DataFrame:
    return df.filter(F.col(score) > threshold).orderBy(F.desc(score), key)


def score_summary(df: DataFrame, score: str) -> DataFrame:
    """count, flagged, mean, std, extremes and quartiles of an anomaly score."""
    q = exact_quantiles(df, [score], [0.25, 0.5, 0.75])[score]
    s = F.col(score)
    return df.agg(
        F.count(s).alias("count"), F.count_if(s > 0).alias("flagged"), F.avg(s).alias("mean"),
        F.stddev_samp(s).alias("std"), F.min(s).alias("min"),
        *[F.lit(v).cast("double").alias(n) for v, n in zip(q, ("p25", "median", "p75"))],
        F.max(s).alias("max"),
    )


def score_quantiles(df: DataFrame, score: str, probs: Sequence[float] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    found = exact_quantiles(df, [score], list(probs))[score]
    return df.sparkSession.createDataFrame(list(zip(probs, found)), "q double, value double")


def error_views(
    df: DataFrame, task_type: str, key: str, *, score: str | None = None
) -> dict[str, DataFrame]:
    """The views of a task over test rows with `truth` and `prediction` in original units. Tasks
    without a truth take what their model gives: `cluster` and `vector`; `error` and `above` of
    reconstruction rows; an anomaly `score`, which a 0/1 `truth` is held against where there is one."""
    from tabloom.operators import metrics as M

    if task_type == "clustering":
        rows = M.silhouette_rows(df.select(key, "cluster", "vector"), key)
        return {
            "silhouette": rows, "low_silhouette": worst_n(rows, "silhouette", key, largest=False),
            "imbalance": cluster_imbalance(df),
        }
    if task_type == "dimensionality_reduction":
        return {"worst": worst_n(df, "error", key), "poorly_embedded": df.filter("above").orderBy(F.desc("error"), key)}
    if task_type == "anomaly_detection":
        name = score or "score"
        views = {
            "score_distribution": score_summary(df, name), "quantiles": score_quantiles(df, name),
            "flagged": flag_filter(df, name, 0.0, key), "worst": worst_n(df, name, key),
        }
        if "truth" in df.columns:
            flagged = df.withColumn("__flag", (F.col(name) > 0).cast("int"))
            views["confusion"] = anomaly_confusion(flagged, "truth", "__flag")
        return views

    if task_type == "binary":
        views = {"confusion": dense_confusion(df)}
        if score is not None:
            positive = M.positive_class(df, "truth")
            coded = df.withColumn("truth", M.binary_indicator("truth", positive))
            views |= {
                "roc": M.roc_curve(coded, score=score), "pr": M.pr_curve(coded, score=score),
                "thresholds": M.threshold_table(coded, score=score),
                "calibration": M.calibration(coded, score=score),
            }
    elif task_type in ("multiclass", "multilabel"):
        views = {"confusion": dense_confusion(df), "per_class": M.per_class(df), "top_confused": top_confused(df)}
    elif task_type in ("regression", "forecasting"):
        views = {
            "points": residual_points(df, key), "histogram": residual_histogram(df),
            "qq": qq_points(df, key), "heteroscedasticity": heteroscedasticity(df),
            "by_quantile": error_by_quantile(df),
        }
    else:
        raise ValueError(f"no error views for task '{task_type}'")
    errors = row_error(df)
    views["worst"] = worst_n(errors, "error", key)
    views["segments"] = segment_errors(errors, target="truth")
    return views
