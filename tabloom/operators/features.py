"""Feature preparation: fitted on train rows only, applied as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.hashing import unit_hash
from tabloom.functions.prefix import row_positions
from tabloom.functions.quantiles import exact_quantiles
from tabloom.operators.cleaning import fit_fills
from tabloom.operators.profile import NUMERIC, require, type_of
from tabloom.session import cut

SCALERS = ("standard", "robust", "minmax")
ENCODERS = ("ordinal", "one_hot")
UNSEEN, MISSING = -1, -2
LOCAL_CATEGORIES = 10_000
BROADCAST_CATEGORIES = 100_000
ONE_HOT_LIMIT = 1_000


def fit_scaler(df: DataFrame, columns: Sequence[str], kind: str) -> dict[str, tuple[float, float]]:
    """(shift, width) per column; a zero width counts as one."""
    if kind == "robust":
        q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        pairs = {c: (v[1], None if v[0] is None else v[2] - v[0]) for c, v in q.items()}
    elif kind in SCALERS:
        stats = ("avg", "stddev_pop") if kind == "standard" else ("min", "max")
        row = df.selectExpr(*[f"{f}(CAST(`{c}` AS DOUBLE))" for c in columns for f in stats]).first()
        pairs = {}
        for i, c in enumerate(columns):
            a, b = row[2 * i], row[2 * i + 1]
            pairs[c] = (a, b if kind == "standard" or a is None else b - a)
    else:
        raise ValueError(f"unknown scaler '{kind}'")
    return {c: (float(a or 0.0), float(b) if b else 1.0) for c, (a, b) in pairs.items()}


def scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({
        c: (F.col(f"`{c}`").cast("double") - F.lit(a)) / F.lit(w) for c, (a, w) in fitted.items()
    })


def fit_categories(df: DataFrame, column: str) -> DataFrame:
    """(category, code): the sorted distinct values, numbered from zero. A small vocabulary
    becomes a local table; a large one is numbered by ranges and written once."""
    values = df.select(F.col(f"`{column}`").cast("string").alias("category")).na.drop().distinct()
    few = [r["category"] for r in values.limit(LOCAL_CATEGORIES + 1).collect()]
    if len(few) <= LOCAL_CATEGORIES:
        rows = [(c, i) for i, c in enumerate(sorted(few))]
        return df.sparkSession.createDataFrame(rows, "category string, code int")
    placed = row_positions(values, "category", out="code")
    return cut(placed.select("category", F.col("code").cast("int")))


def encode_ordinal(df: DataFrame, column: str, categories: DataFrame) -> DataFrame:
    """Category code; -1 for a value not seen in the fit, -2 for a missing one. The category
    table is broadcast only while its counted size is bounded."""
    if categories.count() <= BROADCAST_CATEGORIES:
        categories = F.broadcast(categories)
    value = F.col(f"`{column}`").cast("string")
    joined = df.join(categories, value == F.col("category"), "left")
    code = F.when(value.isNull(), MISSING).otherwise(F.coalesce("code", F.lit(UNSEEN)))
    return joined.withColumn(column, code).drop("category", "code")


def one_hot_names(column: str, categories: Sequence[str | None]) -> list[tuple[str, str | None]]:
    """Column name per category; the name of the missing one is lengthened until it is free."""
    taken = {f"{column}_{v}" for v in categories if v is not None}
    gap = f"{column}_missing"
    while gap in taken:
        gap += "_"
    return [(gap if v is None else f"{column}_{v}", v) for v in categories]


def fit_one_hot(df: DataFrame, column: str) -> list[str | None]:
    """Sorted train categories; a missing value is a category of its own, placed last."""
    value = F.col(f"`{column}`").cast("string").alias("v")
    seen = [r["v"] for r in df.select(value).distinct().limit(ONE_HOT_LIMIT + 1).collect()]
    if len(seen) > ONE_HOT_LIMIT:
        raise ValueError(f"'{column}' has more than {ONE_HOT_LIMIT} categories; use ordinal")
    return sorted(v for v in seen if v is not None) + ([None] if None in seen else [])


def encode_one_hot(df: DataFrame, column: str, categories: Sequence[str | None]) -> DataFrame:
    """0/1 column per category; a value not seen in the fit gives zeros."""
    value = F.col(f"`{column}`").cast("string")
    return df.withColumns({
        name: value.eqNullSafe(F.lit(v)).cast("int") for name, v in one_hot_names(column, categories)
    }).drop(column)


@dataclass(frozen=True)
class TargetEncoding:
    """Smoothed target means of a column's categories. `table` has, for every category and fold, the mean over
    the other folds, and under fold -1 the mean over all; `priors` are the target means without each fold."""

    column: str
    key: str
    table: DataFrame
    priors: tuple[float, ...]
    prior: float
    seed: int

    def encode_train(self, df: DataFrame) -> DataFrame:
        """The rows of the fit: no row sees a target of its own fold."""
        fold = _target_fold(self.key, len(self.priors), self.seed)
        prior = F.element_at(F.array(*map(F.lit, self.priors)), fold + 1)
        return self._joined(df, fold, prior)

    def encode(self, df: DataFrame) -> DataFrame:
        """Other rows; a category that the fit has not seen gets the mean of all."""
        return self._joined(df, F.lit(-1), F.lit(self.prior))

    def _joined(self, df: DataFrame, fold: Column, prior: Column) -> DataFrame:
        table = F.broadcast(self.table) if self.table.count() <= BROADCAST_CATEGORIES else self.table
        rows = df.withColumn("__fold", fold).withColumn("__prior", prior)
        same = _category(self.column).eqNullSafe(F.col("category")) & (F.col("__fold") == F.col("part"))
        value = F.coalesce("encoded", "__prior")
        return rows.join(table, same, "left").withColumn(self.column, value).select(*df.columns)


def _category(column: str) -> Column:
    return F.col(f"`{column}`").cast("string")


def _target_fold(key: str, folds: int, seed: int) -> Column:
    return F.floor(unit_hash(key, seed=f"target:{seed}") * folds).cast("int")


def fit_target_encoding(
    train: DataFrame, column: str, target: str, key: str, *, folds: int = 5, smoothing: float = 10.0, seed: int = 0
) -> TargetEncoding:
    """Out-of-fold target encoding. Sums per category and fold are made in one aggregation, combined before
    they are shuffled, so a category in a third of the rows is a few numbers per task; a missing value is a
    category, rows without a target do not count."""
    rows = train.select(_category(column).alias("category"), _target_fold(key, folds, seed).alias("part"),
                        F.col(f"`{target}`").cast("double").alias("y")).filter(F.col("y").isNotNull() & ~F.isnan("y"))
    sums = cut(rows.groupBy("category", "part").agg(F.sum("y").alias("s"), F.count("*").alias("n")))
    by_fold = {r["part"]: (r["s"], r["n"]) for r in sums.groupBy("part").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    s, n = (sum(v[i] for v in by_fold.values()) for i in (0, 1))
    prior = s / n if n else 0.0
    priors = []
    for f in range(folds):
        own = by_fold.get(f, (0.0, 0))
        priors.append((s - own[0]) / (n - own[1]) if n > own[1] else prior)
    w = Window.partitionBy("category")
    whole = sums.select("category", "part", F.sum("s").over(w).alias("sc"), F.sum("n").over(w).alias("nc"), "s", "n")
    outside = F.element_at(F.array(*map(F.lit, priors)), F.col("part") + 1)
    apart = whole.select("category", "part", (
        (F.col("sc") - F.col("s") + smoothing * outside) / (F.col("nc") - F.col("n") + smoothing)).alias("encoded"))
    every = sums.groupBy("category").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).select(
        "category", F.lit(-1).alias("part"), ((F.col("s") + smoothing * prior) / (F.col("n") + smoothing)).alias("encoded"))
    return TargetEncoding(column, key, cut(apart.unionByName(every)), tuple(priors), prior, seed)


@dataclass(frozen=True)
class FittedFeatures:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    fills: dict = field(default_factory=dict)
    scaler: dict = field(default_factory=dict)
    ordinal: dict = field(default_factory=dict)
    one_hot: dict = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        out = list(self.numeric)
        for c in self.categorical:
            out += [n for n, _ in one_hot_names(c, self.one_hot[c])] if c in self.one_hot else [c]
        return out

    def transform(self, df: DataFrame, *, keep: Sequence[str] = ()) -> DataFrame:
        """Prepared feature columns plus the columns to keep; a kept column that is also a
        feature appears once, prepared."""
        others = [c for c in keep if c not in (*self.numeric, *self.categorical)]
        return self._prepare(df, others, "")

    def _number_text(self, c: str) -> str:
        """Fill and scale of a numeric column as one SQL expression; wide tables are built
        from text because one Column call per step and column adds up."""
        x = f"CAST(`{c}` AS DOUBLE)"
        if c in self.fills:
            x = f"IF({x} IS NULL OR isnan({x}), {float(self.fills[c])!r}D, {x})"
        if c in self.scaler:
            shift, width = self.scaler[c]
            x = f"({x} - {float(shift)!r}D) / {float(width)!r}D"
        return x

    def _prepare(self, df: DataFrame, keep: Sequence[str], prefix: str) -> DataFrame:
        out = df.selectExpr(
            *[f"`{c}`" for c in keep],
            *[f"{self._number_text(c)} AS `{prefix}{c}`" for c in self.numeric],
            *[f"`{c}` AS `{prefix}{c}`" for c in self.categorical],
        )
        for c, categories in self.ordinal.items():
            out = encode_ordinal(out, prefix + c, categories)
        for c, categories in self.one_hot.items():
            out = encode_one_hot(out, prefix + c, categories)
        return out

    def assemble(self, df: DataFrame, *, keep: Sequence[str] = (), out: str = "features") -> DataFrame:
        """The kept columns as they are, and the prepared features as one vector."""
        prepared = self._prepare(df, keep, "__f_")
        inputs = [f"__f_{c}" for c in self.names]
        vectors = VectorAssembler(inputCols=inputs, outputCol=out).transform(prepared)
        return vectors.select(*keep, out)


def fit_features(
    train: DataFrame, features: Sequence[str], *, encoder: str = "ordinal",
    scaler: str | None = "standard",
) -> FittedFeatures:
    """Median fill and scaling of numbers, encoding of the rest, learned on train rows. The passes read the
    features alone, which are kept meanwhile: a split or join before them runs once."""
    require(train, features)
    if encoder not in ENCODERS:
        raise ValueError(f"unknown encoder '{encoder}'")
    train = train.select(*[F.col(f"`{c}`") for c in features]).persist()
    try:
        return _fit_features(train, features, encoder, scaler)
    finally:
        train.unpersist()


def _fit_features(train: DataFrame, features: Sequence[str], encoder: str, scaler: str | None) -> FittedFeatures:
    numeric = [c for c in features if type_of(train, c) in NUMERIC]
    categorical = [c for c in features if c not in numeric]
    fills = fit_fills(train, numeric, "median") if numeric else {}
    fills = {c: v for c, v in fills.items() if v is not None}
    scaled = {}
    if numeric and scaler:
        filled = FittedFeatures(tuple(numeric), (), fills).transform(train)
        scaled = fit_scaler(filled, numeric, scaler)
    return FittedFeatures(
        tuple(numeric), tuple(categorical), fills, scaled,
        {c: fit_categories(train, c) for c in categorical} if encoder == "ordinal" else {},
        {c: fit_one_hot(train, c) for c in categorical} if encoder == "one_hot" else {},
    )


# target transforms -------------------------------------------------------------------------


@dataclass(frozen=True)
class TargetTransform:
    name: str
    power: float = 1.0
    mean: float = 0.0
    std: float = 1.0

    def apply(self, y: Column) -> Column:
        if self.name == "log":
            return F.log1p(y)
        return (_power(y, self.name, F.lit(self.power)) - self.mean) / self.std

    def invert(self, z: Column) -> Column:
        if self.name == "log":
            return F.expm1(z)
        t, lam = z * self.std + self.mean, self.power
        if self.name == "boxcox":
            return F.exp(t) if lam == 0 else F.pow(t * lam + 1, F.lit(1 / lam))
        up = F.expm1(t) if lam == 0 else F.pow(t * lam + 1, F.lit(1 / lam)) - 1
        down = -F.expm1(-t) if lam == 2 else 1 - F.pow(1 - t * (2 - lam), F.lit(1 / (2 - lam)))
        return F.when(t >= 0, up).otherwise(down)


def _power(y: Column, name: str, lam: Column) -> Column:
    if name == "boxcox":
        return F.when(lam == 0, F.log(y)).otherwise((F.pow(y, lam) - 1) / lam)
    up = F.when(lam == 0, F.log1p(y)).otherwise((F.pow(y + 1, lam) - 1) / lam)
    down = F.when(lam == 2, -F.log1p(-y)).otherwise(-(F.pow(1 - y, 2 - lam) - 1) / (2 - lam))
    return F.when(y >= 0, up).otherwise(down)


def fit_target_transform(
    df: DataFrame, target: str, name: str, *, low: float = -2.0, high: float = 3.0,
    points: int = 9, passes: int = 8,
) -> TargetTransform:
    """`log`, or `boxcox` / `yeojohnson` with the power of largest likelihood. Each pass
    evaluates a grid of powers in one aggregation and narrows around the best."""
    if name == "log":
        return TargetTransform("log")
    if name not in ("boxcox", "yeojohnson"):
        raise ValueError(f"unknown target transform '{name}'")
    y = F.col(f"`{target}`").cast("double")
    jacobian = F.log(y) if name == "boxcox" else F.signum(y) * F.log1p(F.abs(y))
    best = 1.0
    for _ in range(passes):
        step = (high - low) / (points - 1)
        grid = [low + i * step for i in range(points)]
        row = df.agg(
            F.count(y), F.sum(jacobian), F.min(y),
            *[F.var_pop(_power(y, name, F.lit(g))) for g in grid],
        ).first()
        if name == "boxcox" and row[2] is not None and row[2] <= 0:
            raise ValueError("box-cox needs a positive target")
        scores = [
            -row[0] / 2 * math.log(v) + (g - 1) * row[1] if v else -math.inf
            for g, v in zip(grid, row[3:])
        ]
        best = grid[scores.index(max(scores))]
        low, high = best - step, best + step
    moved = _power(y, name, F.lit(best))
    mean, std = df.agg(F.avg(moved), F.stddev_pop(moved)).first()
    return TargetTransform(name, best, mean, std or 1.0)
