"""Schema, missing values and descriptive statistics of a table."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions.hashing import unit_hash
from tabloom.functions.prefix import value_ranks
from tabloom.functions.quantiles import exact_quantiles
from tabloom.functions.scalar import chi2_quantile, is_missing, to_number

# Thresholds of the statistics.
CATEGORY_CAP = 20
SKEW_LIMIT = 1.0
MINORITY_LIMIT = 0.20
Z_LIMIT = 3.0
IQR_FACTOR = 1.5
MAHALANOBIS_PROB = 0.999
CORRELATION_LIMIT = 0.7
VARIANCE_GOAL = 0.9
HISTOGRAM_BINS = 30

NUMERIC = {"byte", "short", "integer", "long", "float", "double", "decimal"}
WIDE = 20
#: A sketch within this factor of a limit is followed by an exact count.
SKETCH_MARGIN = 4


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.typeName()


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if type_of(df, c) in NUMERIC]


def categorical_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if type_of(df, c) not in NUMERIC]


def require(df: DataFrame, columns: Sequence[str]) -> None:
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown column(s): {', '.join(unknown)}")


def _missing(df: DataFrame, c: str) -> Column:
    return is_missing(F.col(f"`{c}`"), type_of(df, c))


def _present(df: DataFrame, c: str) -> Column:
    return F.when(~_missing(df, c), F.col(f"`{c}`"))


def rows_of(one_row: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn the single row of an aggregate into one row per struct."""
    return one_row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def literal_rows(spark: SparkSession, rows: Sequence[dict], schema: str) -> DataFrame:
    """A small table of known values, as one literal of the plan."""
    told = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(told))


def _few_values(df: DataFrame, columns: Sequence[str], cap: int) -> dict[str, int]:
    """Exact numbers of distinct present values of the columns with at most `cap` of them. Sketches of all
    columns come first; only columns whose sketch is near the cap, or below it, are counted, by sets."""
    if not columns:
        return {}
    row = df.agg(*[F.approx_count_distinct(_present(df, c)) for c in columns]).first()
    near = [c for c, n in zip(columns, row) if n <= SKETCH_MARGIN * cap + 10]
    if not near:
        return {}
    row = df.agg(*[F.size(F.collect_set(_present(df, c))) for c in near]).first()
    return {c: n for c, n in zip(near, row) if n <= cap}


def _kind_of(type_name: str, few: bool) -> str:
    if type_name == "boolean":
        return "boolean"
    if type_name in ("timestamp", "timestamp_ntz", "date"):
        return "datetime"
    if type_name in NUMERIC:
        return "numeric"
    return ("categorical" if few else "text") if type_name == "string" else "other"


def infer_kind(df: DataFrame, *, cap: int = CATEGORY_CAP) -> DataFrame:
    """boolean / datetime / numeric / categorical / text / other per column."""
    few = _few_values(df, [c for c in df.columns if type_of(df, c) == "string"], cap)
    rows = [{"column": c, "kind": _kind_of(type_of(df, c), c in few)} for c in df.columns]
    return literal_rows(df.sparkSession, rows, "column string, kind string")


def _value_counts(df: DataFrame) -> tuple[int, dict[str, tuple[int, int]]]:
    """Rows, and missing and distinct present values of every column, from one pass: a row per column and value,
    as 128 bits, counted where they meet by hash; missing values are one such row."""
    def bits(c: str) -> list[Column]:
        value, kind = F.col(f"`{c}`"), type_of(df, c)
        value = F.sort_array(F.map_entries(value)) if kind == "map" else value
        return [F.when(~_missing(df, c), h) for h in (F.xxhash64(value), F.xxhash64(F.lit("second"), value))]

    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), *[h.alias(f"h{j}") for j, h in enumerate(bits(c))]) for i, c in enumerate(df.columns)]))
    values = df.select(cells.alias("v")).groupBy("v.i", "v.h0", "v.h1").agg(F.count("*").alias("n"))
    totals = values.groupBy("i").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("h0").isNull(), F.col("n")).otherwise(0)).alias("missing"), F.count("h0").alias("unique"))
    told = totals.collect()
    found = {df.columns[r["i"]]: (r["missing"], r["unique"]) for r in told}
    return max((r["rows"] for r in told), default=0), {c: found.get(c, (0, 0)) for c in df.columns}


def schema_report(
    df: DataFrame, *, cap: int = CATEGORY_CAP, approx: bool = False
) -> DataFrame:
    """One row per column: dtype, kind, missing, missing_pct, unique. `approx` replaces the
    exact distinct counts by sketches, for very wide tables."""
    if approx:
        row = df.agg(
            F.count("*"), *[F.count(_present(df, c)) for c in df.columns],
            *[F.approx_count_distinct(_present(df, c)) for c in df.columns]).first()
        total, k = row[0], len(df.columns)
        found = {c: (total - row[1 + i], row[1 + k + i]) for i, c in enumerate(df.columns)}
    else:
        total, found = _value_counts(df)
    rows = []
    for c in df.columns:
        missing, unique = found[c]
        share = math.floor(missing / total * 1e4 + 0.5) / 1e4 if total else 0.0
        rows.append({
            "column": c, "dtype": df.schema[c].dataType.simpleString(), "kind": _kind_of(type_of(df, c), unique <= cap),
            "missing": missing, "missing_pct": share, "unique": unique})
    return literal_rows(
        df.sparkSession, rows, "column string, dtype string, kind string, missing long, missing_pct double, unique long")


def feature_columns(
    df: DataFrame, *, target: str | None = None, eval_labels: str | None = None,
    group: str | None = None, time_column: str | None = None,
) -> list[str]:
    """Model inputs: everything but target, evaluation labels, group and time column."""
    outside = {target, eval_labels, group, time_column}
    return [c for c in df.columns if c not in outside]


def categorical_cardinalities(df: DataFrame, *, cap: int = CATEGORY_CAP) -> DataFrame:
    few = _few_values(df, categorical_columns(df), cap)
    rows = [{"column": c, "unique": n} for c, n in few.items()]
    return literal_rows(df.sparkSession, rows, "column string, unique long")


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing values per column, only columns that have some."""
    stats = df.agg(*[F.count_if(_missing(df, c)).alias(f"m_{c}") for c in df.columns])
    return rows_of(stats, [
        F.struct(F.lit(c).alias("column"), F.col(f"`m_{c}`").alias("missing"))
        for c in df.columns
    ]).filter(F.col("missing") > 0)


def columns_with_missing(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    return missing_counts(df.drop(*exclude)).select("column")


def dropna_complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std (n-1), min, quartiles and max per numeric column."""
    columns = list(columns or numeric_columns(df))
    stats = df.agg(*[
        f(_present(df, c).cast("double")).alias(f"{name}_{c}")
        for c in columns
        for name, f in (("n", F.count), ("avg", F.avg), ("std", F.stddev_samp),
                        ("min", F.min), ("max", F.max))
    ])
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    return rows_of(stats, [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"`n_{c}`").alias("count"),
            F.col(f"`avg_{c}`").alias("mean"),
            F.col(f"`std_{c}`").alias("std"),
            F.col(f"`min_{c}`").alias("min"),
            *[
                F.lit(q).cast("double").alias(name)
                for q, name in zip(quartiles[c], ("p25", "p50", "p75"))
            ],
            F.col(f"`max_{c}`").alias("max"),
        )
        for c in columns
    ])


# correlation and association -------------------------------------------------------


def corr_pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair over the rows complete in that pair."""
    pairs = list(combinations(columns, 2))
    x = {c: _present(df, c).cast("double") for c in columns}
    stats = df.agg(*[F.corr(x[a], x[b]).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return rows_of(stats, [
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ])


def spearman_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman correlation over the rows complete in both columns, average ranks on ties."""
    both = df.select(
        _present(df, a).cast("double").alias("a"), _present(df, b).cast("double").alias("b")
    ).na.drop()
    ranked = value_ranks(both, {"a": ("la", "ea"), "b": ("lb", "eb")})
    rank = lambda s: F.col(f"l{s}") + (F.col(f"e{s}") + 1) / 2
    return ranked.agg(F.corr(rank("a"), rank("b")).alias("rho"))


def corr_spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spearman correlation of every column pair. Columns without missing values are
    ranked once; a pair with missing values is ranked on its complete rows."""
    columns = list(columns)
    holes = {r["column"] for r in missing_counts(df.select(*columns)).collect()}
    full = [c for c in columns if c not in holes]
    parts = []
    if len(full) > 1:
        ranked = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in full])
        ranked = value_ranks(ranked, {c: (f"__l{i}", f"__e{i}") for i, c in enumerate(full)})
        rank = [F.col(f"__l{i}") + (F.col(f"__e{i}") + 1) / 2 for i in range(len(full))]
        parts.append(corr_pearson(ranked.select(*[r.alias(c) for r, c in zip(rank, full)]), full))
    for a, b in combinations(columns, 2):
        if a in holes or b in holes:
            parts.append(spearman_pair(df, a, b).select(
                F.lit(a).alias("left"), F.lit(b).alias("right"), F.col("rho").alias("r")
            ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _contingency(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Counts per (column pair, value pair) over rows where both are present."""
    cells = F.explode(F.array(*[
        F.struct(
            F.lit(a).alias("left"), F.lit(b).alias("right"),
            _present(df, a).cast("string").alias("x"), _present(df, b).cast("string").alias("y"),
        )
        for a, b in pairs
    ]))
    return (
        df.select(cells.alias("c")).select("c.*").filter(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("left", "right", "x", "y").agg(F.count("*").alias("n"))
    )


def _chi(counts: DataFrame) -> DataFrame:
    """chi-square, sizes and total per pair; empty cells need no row of their own."""
    w = lambda *c: Window.partitionBy("left", "right", *c)
    totals = counts.select(
        "left", "right", "x", "y", F.col("n").cast("double").alias("n"),
        F.sum("n").over(w("x")).alias("r"), F.sum("n").over(w("y")).alias("c"),
    )
    grouped = totals.groupBy("left", "right").agg(
        F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))).alias("q"),
        F.countDistinct("x").alias("nx"), F.countDistinct("y").alias("ny"),
    )
    chi2 = F.greatest(F.col("total") * (F.col("q") - 1), F.lit(0.0))
    return grouped.withColumn("chi2", chi2)


def _low_cardinality(df: DataFrame, columns: Sequence[str], cap: int) -> list[str]:
    few = _few_values(df, columns, cap)
    return [c for c in columns if c in few]


def cramers_v(df: DataFrame, columns: Sequence[str], *, cap: int = CATEGORY_CAP) -> DataFrame:
    """Cramér's V (not bias-corrected) of every pair of low-cardinality columns."""
    low = _low_cardinality(df, columns, cap)
    chi = _chi(_contingency(df, list(combinations(low, 2))))
    scale = F.col("total") * (F.least("nx", "ny") - 1)
    return chi.select(
        "left", "right", F.when(scale > 0, F.sqrt(F.col("chi2") / scale)).otherwise(0.0).alias("v")
    )


def chi_square(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Chi-square statistic and degrees of freedom of each feature against the target."""
    chi = _chi(_contingency(df, [(f, target) for f in features]))
    return chi.select(
        F.col("left").alias("feature"), F.col("chi2"),
        ((F.col("nx") - 1) * (F.col("ny") - 1)).alias("dof"),
    )


def crosstab(df: DataFrame, feature: str, target: str, values: Sequence) -> DataFrame:
    """Counts of each feature value against the given target values."""
    present = df.filter(~_missing(df, feature) & ~_missing(df, target))
    return present.groupBy(feature).agg(
        *[F.count_if(F.col(target) == F.lit(v)).alias(str(v)) for v in values]
    )


# target statistics ------------------------------------------------------------------


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows and share of each target value, missing targets ignored."""
    counts = df.filter(~_missing(df, target)).groupBy(target).agg(F.count("*").alias("count"))
    total = counts.select(F.sum("count")).scalar()
    return counts.withColumn("fraction", F.col("count") / total)


def class_balance(df: DataFrame, target: str, *, limit: float = MINORITY_LIMIT) -> DataFrame:
    """Class counts with the minority share and whether it is below the limit."""
    counts = class_counts(df, target)
    low = counts.select(F.min("fraction")).scalar()
    return counts.select("*", low.alias("minority_fraction"), (low < limit).alias("imbalanced"))


def skew_expr(x: Column) -> Column:
    """Adjusted Fisher-Pearson skew; 0 below three values or for a constant column."""
    n = F.count(x)
    usable = (n >= 3) & (F.stddev_pop(x) > 0)
    return F.when(
        usable, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    ).otherwise(0.0)


def skew(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    x = {c: F.when(~F.isnan(to_number(f"`{c}`")), to_number(f"`{c}`")) for c in columns}
    stats = df.agg(*[skew_expr(x[c]).alias(f"s_{c}") for c in columns])
    return rows_of(stats, [
        F.struct(F.lit(c).alias("column"), F.col(f"`s_{c}`").alias("skew")) for c in columns
    ])


def skew_hint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A log transform is suggested where |skew| exceeds one; NULL otherwise."""
    s = F.abs("skew")
    text = F.concat(F.lit("|skew| = "), F.format_string("%.2f", s), F.lit(" > 1: try a log transform"))
    return skew(df, columns).select("column", F.when(s > SKEW_LIMIT, text).alias("hint"))


def target_stats(df: DataFrame, target: str, *, classification: bool) -> DataFrame:
    """The one statistic that picks the metric set: minority share, or target skew."""
    if classification:
        least = class_counts(df, target).agg(F.min("fraction").alias("minority_fraction"))
        return least.select("minority_fraction", F.lit(0.0).alias("target_skew"))
    row = skew(df, [target]).select(
        F.lit(None).cast("double").alias("minority_fraction"), F.col("skew").alias("target_skew")
    )
    return row


def histogram_table(df: DataFrame, column: str, bins: int, *, right_closed: bool) -> DataFrame:
    """Equal-width bins over [min, max], empty bins included."""
    x = to_number(f"`{column}`")
    low, high = df.agg(F.min(x), F.max(x)).first()
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, count long")
    width = (high - low) / bins or 1.0
    at = (x - F.lit(low)) / F.lit(width)
    bucket = F.greatest(F.ceil(at), F.lit(1)) if right_closed else F.floor(at) + 1
    counts = (
        df.filter(x.isNotNull()).groupBy(F.least(bucket, F.lit(bins)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    every = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin", (F.lit(low) + (F.col("bin") - 1) * F.lit(width)).alias("lower"),
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("upper"),
        F.coalesce("n", F.lit(0)).cast("long").alias("count"),
    )


def target_histogram(df: DataFrame, target: str, *, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Right-closed bins; the minimum belongs to the first bin."""
    return histogram_table(df, target, bins, right_closed=True)


def regression_report(df: DataFrame, target: str, features: Sequence[str]) -> dict[str, DataFrame]:
    """Target skew, hint and histogram, and the complete rows as scatter."""
    return {
        "skew": skew(df, [target]),
        "hint": skew_hint(df, [target]),
        "histogram": target_histogram(df, target),
        "scatter": dropna_complete(df.select(*features, target), [*features, target]),
    }


# outliers and multivariate statistics -------------------------------------------------


def zscore_flags(df: DataFrame, columns: Sequence[str], *, limit: float = Z_LIMIT) -> DataFrame:
    """Rows with |z| above the limit per column; columns with < 3 values or std 0 are left out."""
    x = {c: to_number(f"`{c}`") for c in columns}
    row = df.agg(*[f(x[c]) for c in columns for f in (F.count, F.avg, F.stddev_samp)]).first()
    fit = {c: row[3 * i : 3 * i + 3] for i, c in enumerate(columns)}
    used = [c for c in columns if fit[c][0] >= 3 and fit[c][2]]
    flags = df.agg(*[
        F.count_if(F.abs((x[c] - F.lit(fit[c][1])) / F.lit(fit[c][2])) > limit).alias(f"z_{c}")
        for c in used
    ] or [F.count("*")])
    return rows_of(flags, [
        F.struct(F.lit(c).alias("feature"), F.col(f"`z_{c}`").alias("flagged")) for c in used
    ])


def iqr_fences(
    df: DataFrame, columns: Sequence[str], factor: float = IQR_FACTOR
) -> dict[str, tuple[float, float] | None]:
    quartiles = exact_quantiles(df, columns, [0.25, 0.75])
    out = {}
    for c, (q1, q3) in quartiles.items():
        out[c] = None if q1 is None else (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return out


def iqr_flags(df: DataFrame, columns: Sequence[str], *, factor: float = IQR_FACTOR) -> DataFrame:
    """Rows below and above the IQR fences per column; a zero IQR leaves the column out."""
    fences = iqr_fences(df, columns, factor)
    used = [c for c in columns if fences[c] and fences[c][0] < fences[c][1]]
    x = {c: to_number(f"`{c}`") for c in used}
    flags = df.agg(*[
        F.count_if(cond).alias(f"{side}_{c}")
        for c in used
        for side, cond in (("b", x[c] < fences[c][0]), ("a", x[c] > fences[c][1]))
    ])
    return rows_of(flags, [
        F.struct(F.lit(c).alias("feature"), F.col(f"`b_{c}`").alias("below"),
                 F.col(f"`a_{c}`").alias("above"))
        for c in used
    ])


def complete_doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.selectExpr(*[f"try_cast(`{c}` AS DOUBLE) AS `{c}`" for c in columns]).na.drop()


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and sample covariance of complete rows; only k x k numbers reach the
    driver."""
    columns = list(columns)
    k = len(columns)
    data = complete_doubles(df, columns)
    if k <= WIDE:
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        row = data.agg(
            F.count("*"), *[F.avg(f"`{c}`") for c in columns],
            *[F.covar_samp(f"`{columns[i]}`", f"`{columns[j]}`") for i, j in pairs],
        ).first()
        cov = np.zeros((k, k))
        for (i, j), v in zip(pairs, row[1 + k :]):
            cov[i, j] = cov[j, i] = v if v is not None else np.nan
        return row[0], np.array(row[1 : 1 + k], dtype=float), cov
    return _wide_moments(df, columns)


def _merged(parts: Iterable[tuple[int, np.ndarray, np.ndarray]], k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and centred cross products of several parts together."""
    n, mean, cross = 0, np.zeros(k), np.zeros((k, k))
    for m, other, more in parts:
        if m:
            gap = other - mean
            cross += more + np.outer(gap, gap) * (n * m / (n + m))
            mean += gap * (m / (n + m))
            n += m
    return n, mean, cross


def _wide_moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """One pass of matrix products in the tasks. Rows with gaps are left out there: a filter would be evaluated
    below the projections, which repeats the expressions of all columns."""
    k, kind = len(columns), "task int, n bigint, mean binary, gaps binary"

    def packed(task: int, part: tuple[int, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        n, mean, cross = part
        return pa.record_batch([pa.array([task], pa.int32()), pa.array([n]), pa.array([mean.tobytes()], pa.binary()),
                                pa.array([cross.tobytes()], pa.binary())], ["task", "n", "mean", "gaps"])

    def unpacked(rows: Iterable[dict]):
        return ((r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["gaps"]).reshape(k, k)) for r in rows)

    def part(batch: pa.RecordBatch) -> tuple[int, np.ndarray, np.ndarray]:
        x = np.column_stack([batch.column(j).to_numpy(zero_copy_only=False).astype(float) for j in range(k)])
        x = x[~np.isnan(x).any(axis=1)]
        mean = x.mean(axis=0) if len(x) else np.zeros(k)
        return len(x), mean, (x - mean).T @ (x - mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        yield packed(task % 16, _merged(map(part, batches), k))

    def merge(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([packed(0, _merged(unpacked(table.to_pylist()), k))])

    wide = df.select(*[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(f"c{j}") for j, c in enumerate(columns)])
    found = wide.mapInArrow(run, kind).groupBy("task").applyInArrow(merge, kind).collect()
    n, mean, cross = _merged(unpacked(r.asDict() for r in found), k)
    return n, mean, cross / (n - 1) if n > 1 else cross


def mahalanobis_expr(columns: Sequence[str], mean: np.ndarray, cov: np.ndarray) -> Column:
    """Squared distance as a column expression: sum of squares of whitened coordinates."""
    inverse = np.linalg.inv(cov + np.eye(len(columns)) * 1e-9)
    white = np.linalg.cholesky(inverse).T
    centred = [F.col(f"`{c}`") - F.lit(float(m)) for c, m in zip(columns, mean)]
    out = F.lit(0.0)
    for row in white:
        y = F.lit(0.0)
        for weight, x in zip(row, centred):
            if weight:
                y = y + F.lit(float(weight)) * x
        out = out + y * y
    return out


def mahalanobis(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and largest distance, and rows whose squared distance exceeds the chi-square
    quantile."""
    _, mean, cov = moments(df, columns)
    limit = chi2_quantile(MAHALANOBIS_PROB, len(columns))
    squared = complete_doubles(df, columns).select(mahalanobis_expr(columns, mean, cov).alias("d2"))
    return squared.agg(
        F.avg(F.sqrt("d2")).alias("mean_distance"), F.max(F.sqrt("d2")).alias("max_distance"),
        F.count_if(F.col("d2") > limit).alias("flagged"), F.lit(limit).alias("threshold"),
    )


def _correlation(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    _, _, cov = moments(df, columns)
    std = np.sqrt(np.diag(cov))
    with np.errstate(divide="ignore", invalid="ignore"):
        return cov / np.outer(std, std)


def correlation_groups(
    df: DataFrame, columns: Sequence[str], *, limit: float = CORRELATION_LIMIT
) -> DataFrame:
    """Features joined to the first feature they correlate with, in column order."""
    r = np.abs(np.nan_to_num(_correlation(df, columns)))
    leads: list[int] = []
    rows = []
    for j, member in enumerate(columns):  # every column looks back for the first lead it follows
        behind = next((i for i in leads if r[i, j] >= limit), None)
        if behind is None:
            leads.append(j)
        else:
            rows.append((columns[behind], member, float(r[behind, j])))
    return df.sparkSession.createDataFrame(rows, "lead string, member string, r double")


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation: diagonal of the inverse correlation matrix, three features or more."""
    r = _correlation(df, columns)
    used = [i for i in range(len(columns)) if np.isfinite(r[i, i])]
    rows = []
    if len(used) >= 3:
        try:
            inverse = np.linalg.inv(r[np.ix_(used, used)])
            rows = [(columns[i], float(inverse[at, at])) for at, i in enumerate(used)]
        except np.linalg.LinAlgError:
            rows = []
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


def scree_values(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, float, float, float]]:
    _, _, cov = moments(df, columns)
    values = np.clip(np.linalg.eigvalsh(cov)[::-1], 0.0, None)
    share = values / values.sum() if values.sum() > 0 else np.zeros_like(values)
    total = np.cumsum(share)
    return [
        (f"PC{i + 1}", float(v), float(s), float(t))
        for i, (v, s, t) in enumerate(zip(values, share, total))
    ]


def scree(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Eigenvalue, explained share and running share per principal component."""
    return df.sparkSession.createDataFrame(
        scree_values(df, columns),
        "component string, eigenvalue double, explained_variance double, cumulative double",
    )


def components_for(df: DataFrame, columns: Sequence[str], goal: float = VARIANCE_GOAL) -> DataFrame:
    """Smallest number of components whose running share reaches the goal."""
    return scree(df, columns).agg(
        (F.count_if(F.col("cumulative") < goal - 1e-12) + 1).alias("components")
    )


# samples ------------------------------------------------------------------------------


def hash_sample(df: DataFrame, key: str, rows: int, *, seed: int = 0) -> DataFrame:
    """Exactly `rows` rows (all, when there are fewer): those with the smallest key hash.
    Only rows under a hash bound that is expected to hold slightly more than `rows` reach
    the final top-k, so its size does not depend on the table."""
    total = df.count()
    if total <= rows:
        return df
    h = unit_hash(key, seed=seed)
    slack = (rows + 8 * math.sqrt(rows) + 8) / total
    while slack < 1 and df.filter(h < slack).count() < rows:
        slack *= 2
    return df.filter(h < slack).orderBy(h, key).limit(rows)
