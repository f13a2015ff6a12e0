"""Time series statistics and baseline forecasts over (series, time, value) rows.

Positions inside a series come from range-wise counts, and row frames are evaluated per
block of positions with the few neighbouring rows copied in, so one long series spreads
over many tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.prefix import row_positions, with_halo
from tabloom.functions.quantiles import grouped_quantiles
from tabloom.functions.scalar import to_number
from tabloom.operators.splits import backtest_cuts

# Limits of the series statistics.
PERIOD = 12
WINDOWS = (3, 5, 13)
ADF_CRITICAL = -2.86
MIN_ROWS = 4


def series_frame(
    df: DataFrame, series: Sequence[str], time: str, y: str, *, tie: str | None = None
) -> DataFrame:
    """The series columns, the time, `y` as a number, `pos` and the series length `n`. Rows
    without a value are not part of the series."""
    extra = [tie] if tie and tie not in series else []
    work = df.select(*series, time, *extra, to_number(f"`{y}`").alias("y"))
    work = work.filter(F.col("y").isNotNull() & ~F.isnan("y"))
    return row_positions(work, time, by=series, tie=tie, total="n")


def with_period(df: DataFrame) -> DataFrame:
    """Season length and odd centred window of a series of `n` rows."""
    n = F.col("n")
    period = F.when(n >= 2 * PERIOD, F.lit(PERIOD)).otherwise(F.greatest(F.lit(2), F.floor(n / 4)))
    period = period.cast("int")
    base = F.when(n >= 2 * period, period).otherwise(F.greatest(F.lit(3), F.floor(n / 4)))
    window = F.greatest(F.lit(3), F.least(base, n)).cast("int")
    return df.withColumns({"period": period, "window": window + (window % 2 == 0).cast("int")})


def period_window(df: DataFrame, series: Sequence[str]) -> DataFrame:
    return with_period(df.groupBy(*series).agg(F.count("*").alias("n")))


def _by_window(build) -> Column:
    out = build(WINDOWS[-1])
    for size in WINDOWS[:-1]:
        out = F.when(F.col("window") == size, build(size)).otherwise(out)
    return out


def trend(placed: DataFrame, series: Sequence[str]) -> DataFrame:
    """Adds the centred moving average and the trailing standard deviation (two rows or
    more) of each series."""
    widest = WINDOWS[-1]
    rows, w, home = with_halo(with_period(placed), series, before=widest - 1, after=widest // 2)
    mean = _by_window(lambda k: F.avg("y").over(w.rowsBetween(-(k // 2), k // 2)))
    std = _by_window(lambda k: F.stddev_samp("y").over(w.rowsBetween(-(k - 1), 0)))
    out = rows.withColumns({"trend": mean, "rolling_std": std}).filter(home)
    return out.drop("__block")


def decompose(placed: DataFrame, series: Sequence[str]) -> DataFrame:
    """Adds trend, the mean detrended value of the phase, and what remains."""
    rows = trend(placed, series).withColumn("phase", F.col("pos") % F.col("period"))
    means = rows.groupBy(*series, "phase").agg(F.avg(F.col("y") - F.col("trend")).alias("seasonal"))
    joined = rows.join(means, [*series, "phase"])
    return joined.withColumn("residual", F.col("y") - F.col("trend") - F.col("seasonal"))


#: Lags unless the caller asks for more; a series of n rows has at most n / 2 - 1.
LAGS = 40


def max_lag(n: Column, lags: int = LAGS) -> Column:
    return F.least(F.lit(lags), F.greatest(F.lit(1), F.floor(n / 2) - 1)).cast("int")


def acf(placed: DataFrame, series: Sequence[str], *, lags: int = LAGS) -> DataFrame:
    """Autocorrelation per series and lag up to `lags`, with the series sum of squares below."""
    most = lags
    means = placed.groupBy(*series).agg(F.avg("y").alias("m"))
    centred = placed.join(means, list(series)).withColumn("c", F.col("y") - F.col("m"))
    rows, _, home = with_halo(centred.select(*series, "pos", "n", "c"), series, before=most)
    over = f"OVER (PARTITION BY {', '.join(f'`{c}`' for c in [*series, '__block'])} ORDER BY pos)"
    steps = range(1, most + 1)
    products = rows.withColumn("__home", home).selectExpr(
        *[f"`{c}`" for c in series], "n", "c", "__home", *[f"c * lag(c, {k}) {over} AS p{k}" for k in steps]
    ).filter("__home")
    sums = products.groupBy(*series).agg(
        F.max("n").alias("n"), F.sum(F.col("c") * F.col("c")).alias("d"),
        F.expr(f"array({', '.join(f'coalesce(sum(p{k}), 0D)' for k in steps)})").alias("p"),
    )
    pairs = F.explode(F.expr("transform(p, (x, i) -> named_struct('lag', i + 1, 'p', x))")).alias("r")
    value = F.when(F.col("d") > 1e-12, F.col("r.p") / F.nullif("d", F.lit(0.0))).otherwise(0.0)
    return (
        sums.select(*series, "n", "d", pairs).filter(F.col("r.lag") <= max_lag(F.col("n"), most))
        .select(*series, F.col("r.lag").alias("lag"), value.alias("acf"))
    )


def pacf(correlations: DataFrame, series: Sequence[str]) -> DataFrame:
    """Partial autocorrelation by the Durbin-Levinson recursion; a series brings one
    number per lag."""
    fields = [correlations.schema[c] for c in series]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields],
                        "lag int", "pacf double"])
    packed = correlations.groupBy(*series).agg(
        F.sort_array(F.collect_list(F.struct("lag", "acf"))).alias("a")
    ).select(*series, F.col("a.acf").alias("r"))

    def recursion(r: Sequence[float]) -> list[float]:
        weights: list[float] = []
        out = []
        for at, rho in enumerate(r):
            top = rho - sum(w * x for w, x in zip(weights, reversed(r[:at])))
            below = 1.0 - sum(w * x for w, x in zip(weights, r))
            last = top / below if abs(below) > 1e-12 else 0.0
            weights = [w - last * v for w, v in zip(weights, reversed(weights))] + [last]
            out.append(last)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [recursion(list(r)) for r in pdf["r"]]
            out = pdf[list(series)].loc[pdf.index.repeat([len(v) for v in values])]
            out = out.assign(
                lag=[k + 1 for v in values for k in range(len(v))],
                pacf=[x for v in values for x in v],
            )
            yield out

    return packed.mapInPandas(run, schema)


def adf(placed: DataFrame, series: Sequence[str]) -> DataFrame:
    """Dickey-Fuller t statistic of the lagged level (constant, no trend); NULL below eight
    rows. Stationary when it is below the 5 % critical value."""
    rows, w, home = with_halo(placed.select(*series, "pos", "n", "y"), series, before=1)
    steps = rows.withColumn("x", F.lag("y", 1).over(w)).filter(home & F.col("x").isNotNull())
    d, x = F.col("y") - F.col("x"), F.col("x")
    fit = steps.groupBy(*series).agg(
        F.max("n").alias("n"), F.count("*").alias("m"), F.regr_slope(d, x).alias("slope"),
        F.regr_sxx(d, x).alias("sxx"), F.regr_syy(d, x).alias("syy"), F.regr_sxy(d, x).alias("sxy"),
    )
    sse = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    variance = sse / F.greatest(F.lit(1), F.col("m") - 2) / F.nullif("sxx", F.lit(0.0))
    t = F.when(F.col("n") >= 8, F.col("slope") / F.sqrt(F.greatest(variance, F.lit(1e-18))))
    return fit.select(
        *series, t.alias("statistic"), F.lit(ADF_CRITICAL).alias("critical"),
        F.coalesce(t < ADF_CRITICAL, F.lit(False)).alias("stationary"),
    )


def timeseries_report(
    df: DataFrame, series: Sequence[str], time: str, y: str
) -> dict[str, DataFrame]:
    """Decomposition, ACF, PACF and stationarity of every series of four rows or more."""
    placed = series_frame(df, series, time, y).filter(F.col("n") >= MIN_ROWS)
    correlations = acf(placed, series)
    return {
        "decomposition": decompose(placed, series),
        "acf": correlations,
        "pacf": pacf(correlations, series),
        "stationarity": adf(placed, series),
    }


def lag_features(
    placed: DataFrame, series: Sequence[str], *, lags: int = PERIOD
) -> DataFrame:
    """y_lag_1 ... y_lag_<lags>. A series of n rows uses at most n / 3 lags (the others stay
    NULL) and loses as many leading rows."""
    rows, w, home = with_halo(placed, series, before=lags)
    used = F.greatest(F.lit(1), F.least(F.lit(lags), F.greatest(F.lit(1), F.floor(F.col("n") / 3))))
    out = rows.withColumn("lags", used.cast("int")).withColumns({
        f"y_lag_{k}": F.when(F.col("lags") >= k, F.lag("y", k).over(w)) for k in range(1, lags + 1)
    })
    return out.filter(home & (F.col("pos") >= F.col("lags"))).drop("__block")


# baseline forecasts -----------------------------------------------------------------------


def horizon(steps: int) -> int:
    if int(steps) < 1:
        raise ValueError("a forecast needs at least one step")
    return int(steps)


def forecast_naive(df: DataFrame, series: Sequence[str], time: str, y: str, steps: int) -> DataFrame:
    """The last observed value, repeated."""
    last = df.groupBy(*series).agg(F.max_by(F.col(y).cast("double"), time).alias("forecast"))
    return last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon(steps)))))


def forecast_seasonal_naive(
    placed: DataFrame, series: Sequence[str], steps: int, *, period: int = PERIOD
) -> DataFrame:
    """The value one season ago; the season is capped at the history length."""
    p = F.least(F.lit(max(1, period)), F.col("n")).cast("int")
    at = (F.col("pos") - (F.col("n") - p)).cast("int")
    last = placed.filter(at >= 0).filter(at < horizon(steps))
    return last.select(
        *series, F.explode(F.sequence(at + 1, F.lit(horizon(steps)), p)).alias("step"),
        F.col("y").alias("forecast"),
    )


def history_trace(placed: DataFrame, series: Sequence[str], time: str, *, rows: int | None = None) -> DataFrame:
    """The whole series, or its last `rows` points."""
    kept = placed if rows is None else placed.filter(F.col("pos") >= F.col("n") - rows)
    return kept.select(
        *series, time, F.round("y", 6).alias("value")
    )


def _backtest_errors(placed: DataFrame, series: Sequence[str], period: int, splits: int) -> DataFrame:
    cuts = backtest_cuts(placed, splits=splits).withColumn(
        "p", F.least(F.lit(max(1, period)), F.col("train_end")).cast("long")
    )
    held = cuts.filter((F.col("pos") >= F.col("train_end")) & (F.col("pos") < F.col("test_end")))
    held = held.withColumn("at", (F.col("pos") - F.col("train_end")) % F.col("p"))
    known = cuts.filter(
        (F.col("pos") < F.col("train_end")) & (F.col("pos") >= F.col("train_end") - F.col("p"))
    ).select(
        *series, "fold", (F.col("pos") - F.col("train_end") + F.col("p")).alias("at"),
        F.col("y").alias("prediction"),
    )
    return held.join(known, [*series, "fold", "at"]).withColumn("error", F.col("y") - F.col("prediction"))


def forecast_backtest(
    placed: DataFrame, series: Sequence[str], *, period: int = 1, splits: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Expanding-window backtest of the (seasonal) naive forecast: one row per series and
    fold, and one row per series with pooled residual bands."""
    errors = _backtest_errors(placed, series, period, splits)
    folds = errors.groupBy(*series, "fold").agg(
        F.max("train_end").alias("train_rows"), F.count("*").alias("horizon"),
        F.avg(F.abs("error")).alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
    )
    pooled = errors.groupBy(*series).agg(
        F.avg(F.abs("error")).alias("backtest_mae"), F.stddev_pop("error").alias("residual_std")
    )
    bands = grouped_quantiles(
        errors, series, "error", [0.05, 0.95], ["residual_q05", "residual_q95"]
    )
    return folds, pooled.join(bands, list(series))


def forecast_frame(points: DataFrame, bands: DataFrame, series: Sequence[str]) -> DataFrame:
    """step, forecast, lower and upper: the point plus the residual quantiles of its series."""
    joined = points.join(bands.select(*series, "residual_q05", "residual_q95"), list(series), "left")
    low = F.coalesce("residual_q05", F.lit(0.0))
    high = F.coalesce("residual_q95", F.lit(0.0))
    return joined.select(
        *series, "step", F.round("forecast", 6).alias("forecast"),
        F.round(F.col("forecast") + low, 6).alias("lower"),
        F.round(F.col("forecast") + high, 6).alias("upper"),
    )
