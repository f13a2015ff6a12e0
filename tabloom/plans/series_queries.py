"""Queries for time series and baseline forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import timeseries as T
from tabloom.plans.fixtures import DAILY_EVENTS, daily_events
from tabloom.plans.registry import query, rounded

KEY = ["event_type"]

PLACED = f"""(SELECT event_type, day, y, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS pos,
count(*) OVER (PARTITION BY event_type) AS n FROM {DAILY_EVENTS})"""

# Thirty days of events: n >= 24, so the period is 12 and the window 13; the rule is in the SQL.
PERIODS = """(SELECT *, window0 + (window0 % 2 = 0)::INTEGER AS "window" FROM (SELECT *, greatest(3, least(
CASE WHEN n >= 2 * period THEN period ELSE greatest(3, n // 4) END, n))::INTEGER AS window0 FROM (SELECT event_type, n,
CASE WHEN n >= 24 THEN 12 ELSE greatest(2, n // 4) END::INTEGER AS period FROM
(SELECT event_type, count(*) AS n FROM {src} GROUP BY 1))))""".replace("{src}", DAILY_EVENTS)

TREND = f"""(SELECT p.*, period, "window", CASE "window"
WHEN 3 THEN avg(y) OVER (PARTITION BY p.event_type ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)
WHEN 5 THEN avg(y) OVER (PARTITION BY p.event_type ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
ELSE avg(y) OVER (PARTITION BY p.event_type ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) END AS trend,
CASE "window"
WHEN 3 THEN stddev_samp(y) OVER (PARTITION BY p.event_type ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
WHEN 5 THEN stddev_samp(y) OVER (PARTITION BY p.event_type ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
ELSE stddev_samp(y) OVER (PARTITION BY p.event_type ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) END AS rolling_std
FROM {PLACED} p JOIN {PERIODS} q USING (event_type))"""

SEASON = f"""(SELECT *, y - trend - seasonal AS residual FROM (SELECT *, avg(y - trend) OVER (
PARTITION BY event_type, pos % period) AS seasonal FROM {TREND}))"""


def placed(spark, sf):
    return T.series_frame(daily_events(spark, sf), KEY, "day", "y")


@query("ts_period_window", f'SELECT event_type, n, period, "window" FROM {PERIODS}')
def ts_period_window(spark, sf):
    return T.period_window(daily_events(spark, sf), KEY)


@query("ts_trend", f"SELECT event_type, day, round(trend, 5) AS trend FROM {TREND}")
def ts_trend(spark, sf):
    return rounded(T.trend(placed(spark, sf), KEY).select("event_type", "day", "trend"), 5)


@query("ts_rolling_std", f"SELECT event_type, day, round(rolling_std, 5) AS rolling_std FROM {TREND}")
def ts_rolling_std(spark, sf):
    return rounded(T.trend(placed(spark, sf), KEY).select("event_type", "day", "rolling_std"), 5)


for _name, _column in (("ts_seasonal", "seasonal"), ("ts_residual", "residual")):
    def _run(spark, sf, column=_column):
        return rounded(T.decompose(placed(spark, sf), KEY).select("event_type", "day", column), 5)

    query(_name, f"SELECT event_type, day, round({_column}, 5) AS {_column} FROM {SEASON}")(_run)


@query("join_season_map", f"""SELECT DISTINCT event_type, pos % period AS phase, round(seasonal, 5) AS seasonal FROM {SEASON}""")
def join_season_map(spark, sf):
    d = T.decompose(placed(spark, sf), KEY).select("event_type", "phase", "seasonal")
    return rounded(d.dropDuplicates(["event_type", "phase"]), 5)


ACF = f"""(WITH c AS (SELECT event_type, pos, n, y - avg(y) OVER (PARTITION BY event_type) AS c FROM {PLACED}),
s AS (SELECT event_type, sum(c * c) AS d FROM c GROUP BY 1)
SELECT a.event_type, lag::INTEGER AS lag, sum(a.c * b.c) / any_value(d) AS acf
FROM c a CROSS JOIN range(1, 41) r(lag) JOIN c b ON a.event_type = b.event_type AND a.pos - lag = b.pos
JOIN s ON s.event_type = a.event_type WHERE lag <= least(40, greatest(1, a.n // 2 - 1)) GROUP BY 1, 2)"""


@query("ts_acf", f"SELECT event_type, lag, round(acf, 6) AS acf FROM {ACF}")
def ts_acf(spark, sf):
    return rounded(T.acf(placed(spark, sf), KEY))


@query("ts_pacf", f"""WITH RECURSIVE r AS (SELECT event_type, list(acf ORDER BY lag) AS r FROM {ACF} GROUP BY 1),
dl AS (SELECT event_type, r, 1 AS k, [r[1]] AS phi FROM r
UNION ALL SELECT event_type, r, k + 1, list_concat(list_transform(range(1, k + 1), lambda j: phi[j] - last * phi[k + 1 - j]), [last])
FROM (SELECT event_type, r, k, phi,
  (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 1 - j])))
  / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j]))) AS last FROM dl WHERE k < len(r)))
SELECT event_type, k::INTEGER AS lag, round(phi[k], 5) AS pacf FROM dl""")
def ts_pacf(spark, sf):
    return rounded(T.pacf(T.acf(placed(spark, sf), KEY), KEY), 5)


ADF = f"""(WITH s AS (SELECT event_type, n, y, lag(y) OVER (PARTITION BY event_type ORDER BY pos) AS x FROM {PLACED}),
f AS (SELECT event_type, any_value(n) AS n, count(*) AS m, regr_slope(y - x, x) AS b, regr_sxx(y - x, x) AS sxx,
regr_syy(y - x, x) AS syy, regr_sxy(y - x, x) AS sxy FROM s WHERE x IS NOT NULL GROUP BY 1)
SELECT event_type, CASE WHEN n >= 8 THEN b / sqrt((syy - b * sxy) / (m - 2) / sxx) END AS statistic FROM f)"""


@query("ts_adf", f"""SELECT event_type, round(statistic, 5) AS statistic, -2.86::DOUBLE AS critical,
coalesce(statistic < -2.86, false) AS stationary FROM {ADF}""")
def ts_adf(spark, sf):
    return rounded(T.adf(placed(spark, sf), KEY), 5)


@query("timeseries_report", f"""SELECT 'residual' AS part, event_type AS a, day::VARCHAR AS b, round(residual, 5) AS value FROM {SEASON}
UNION ALL SELECT 'acf', event_type, lag::VARCHAR, round(acf, 5) FROM {ACF}
UNION ALL SELECT 'adf', event_type, '', round(statistic, 5) FROM {ADF}""")
def timeseries_report(spark, sf):
    from tabloom.operators.reports import long_report
    report = T.timeseries_report(daily_events(spark, sf), KEY, "day", "y")
    return rounded(long_report(report, {
        "residual": ("decomposition", "event_type", "day", "residual"),
        "acf": ("acf", "event_type", "lag", "acf"),
        "adf": ("stationarity", "event_type", None, "statistic"),
    }), 5)


@query("lag_features", "SELECT * FROM (SELECT event_type, day, y, pos, " + ", ".join(
    f"CASE WHEN least(4, greatest(1, n // 3)) >= {k} THEN lag(y, {k}) OVER (PARTITION BY event_type ORDER BY pos) END AS y_lag_{k}"
    for k in range(1, 5)) + f" FROM {PLACED}) JOIN (SELECT event_type, least(4, greatest(1, count(*) // 3)) AS l FROM {DAILY_EVENTS} GROUP BY 1) USING (event_type) WHERE pos >= l")
def lag_features(spark, sf):
    f = T.lag_features(placed(spark, sf), KEY, lags=4)
    return f.select("event_type", "day", "y", "pos", *[f"y_lag_{k}" for k in range(1, 5)], F.col("lags").cast("long").alias("l"))


@query("forecast_naive", f"""SELECT event_type, step::INTEGER AS step, last_y AS forecast FROM
(SELECT event_type, arg_max(y, day) AS last_y FROM {DAILY_EVENTS} GROUP BY 1), range(1, 13) r(step)""")
def forecast_naive(spark, sf):
    return T.forecast_naive(daily_events(spark, sf), KEY, "day", "y", 12)


@query("forecast_seasonal_naive", f"""SELECT event_type, step::INTEGER AS step, y AS forecast FROM {PLACED}, range(1, 25) r(step)
WHERE pos = n - least(12, n) + (step - 1) % least(12, n)""")
def forecast_seasonal_naive(spark, sf):
    return T.forecast_seasonal_naive(placed(spark, sf), KEY, 24)


@query("history_trace", f"SELECT event_type, day, round(y, 6) AS value FROM {PLACED}")
def history_trace(spark, sf):
    return T.history_trace(placed(spark, sf), KEY, "day")


def backtest_sql(period: int) -> str:
    return f"""(WITH c AS (SELECT *, head + fold * size AS te, CASE WHEN fold = 2 THEN n ELSE head + (fold + 1) * size END AS th
FROM (SELECT *, greatest(1, floor((n - head) / 3)) AS size FROM (SELECT *, greatest(2, floor(n * 0.4)) AS head FROM {PLACED}) WHERE n >= 4 AND n - head >= 3), range(3) r(fold))
SELECT a.event_type, a.fold::INTEGER AS fold, a.te, a.y - b.y AS error FROM c a JOIN {PLACED} b ON a.event_type = b.event_type
AND b.pos = a.te - least({period}, a.te) + (a.pos - a.te) % least({period}, a.te) WHERE a.pos >= a.te AND a.pos < a.th)"""


@query("forecast_backtest", f"""SELECT event_type, fold, any_value(te)::BIGINT AS train_rows, count(*) AS horizon,
round(avg(abs(error)), 5) AS mae, round(sqrt(avg(error * error)), 5) AS rmse FROM {backtest_sql(1)} GROUP BY 1, 2""")
def forecast_backtest(spark, sf):
    return rounded(T.forecast_backtest(placed(spark, sf), KEY)[0], 5)


BANDS = """(SELECT event_type, avg(abs(error)) AS backtest_mae, stddev_pop(error) AS residual_std,
quantile_cont(error, 0.05) AS residual_q05, quantile_cont(error, 0.95) AS residual_q95 FROM {e} GROUP BY 1)"""


@query("forecast_backtest_bands", f"""SELECT event_type, round(backtest_mae, 5) AS backtest_mae, round(residual_std, 5) AS residual_std,
round(residual_q05, 5) AS residual_q05, round(residual_q95, 5) AS residual_q95 FROM {BANDS.format(e=backtest_sql(7))}""")
def forecast_backtest_bands(spark, sf):
    return rounded(T.forecast_backtest(placed(spark, sf), KEY, period=7)[1], 5)


@query("forecast_frame", f"""SELECT p.event_type, step::INTEGER AS step, round(y, 5) AS forecast, round(y + residual_q05, 5) AS lower,
round(y + residual_q95, 5) AS upper FROM {PLACED} p JOIN {BANDS.format(e=backtest_sql(12))} b USING (event_type), range(1, 13) r(step)
WHERE pos = n - least(12, n) + (step - 1) % least(12, n)""")
def forecast_frame(spark, sf):
    rows = placed(spark, sf)
    _, bands = T.forecast_backtest(rows, KEY, period=12)
    points = T.forecast_seasonal_naive(rows, KEY, 12)
    return rounded(T.forecast_frame(points, bands, KEY), 5)


@query("repeat_rows", f"""SELECT event_type, y, step::INTEGER AS step FROM {PLACED}, range(1, 7) r(step) WHERE pos = n - 1""")
def repeat_rows(spark, sf):
    last = placed(spark, sf).filter(F.col("pos") == F.col("n") - 1)
    return last.select("event_type", "y", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("step"))
