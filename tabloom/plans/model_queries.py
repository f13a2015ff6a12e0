"""Queries for model training, prediction, explanation and outcome tables."""

from __future__ import annotations

import json
import random
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.hashing import unit_hash_sql
from tabloom.operators import errors as E
from tabloom.operators import explain as X
from tabloom.operators import metrics as M
from tabloom.operators import outcome as O
from tabloom.operators import predict as R
from tabloom.operators import training as N
from tabloom.operators.reports import anomaly_report, classification_report, dimred_report, long_report
from tabloom.plans.fixtures import (
    DAILY_EVENTS,
    REGRESSED, VECTOR_CELLS, VECTORS, regressed, vector_columns, vectors,
)
from tabloom.plans.metric_queries import (
    ANOVA, ERROR_BY_QUANTILE, HETERO, PROFILES, RESIDUAL_HIST, _F, lines, personas_sql,
)
from tabloom.plans.profile_queries import _EIGEN2, IQR, MAHALANOBIS, ZSCORE, _VIF_SQL, histogram_sql
from tabloom.plans.association_queries import B, CONFIDENCE, LIFT, RULES, SUPPORT, _TOP, baskets, rules
from tabloom.plans.registry import query, rounded
from tabloom.plans.series_queries import KEY, placed
from tabloom.session import scratch_dir, stored, table

DOC_TASK = N.Task("binary", key="doc_id", target="quality")
LINE_TASK = N.Task("regression", key="row_key", target="l_extendedprice", features=("l_quantity", "l_discount", "l_tax"))
ONE = N.Task("regression", key="row_key", target="l_extendedprice", features=("l_quantity",))
RAW = N.PreprocessingOptions(scaler=None)


def docs(spark, sf):
    """Labelled documents with their length, language and source."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    return d.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


def priced(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_key"),
        "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag")


def kind(spark, sf, task_type: str):
    """Embeddings, one column per dimension, as an unsupervised task with evaluation labels."""
    v = vector_columns(spark, sf)
    labels = None if task_type == "dimensionality_reduction" else "cluster"
    task = N.Task(task_type, key="vec_id", eval_labels=labels,
                  features=tuple(c for c in v.columns if c.startswith("e")))
    return v, task


def fitted_docs(spark, sf, model: str, **params):
    d = docs(spark, sf)
    return d, N.fit_model(d, DOC_TASK, model, params)


def _classifier(name: str, model: str, **params):
    @query(name)
    def run(spark, sf):
        d, fitted = fitted_docs(spark, sf, model, **params)
        return rounded(fitted.predict(d).select("doc_id", "prediction", "p_0", "p_1"), 4)


_classifier("fit_logistic", "logistic_regression", class_weight="balanced")
_classifier("fit_tree", "decision_tree", max_depth=5)
_classifier("fit_forest", "random_forest", n_estimators=20, max_depth=6)
_classifier("fit_boosting", "hist_gradient_boosting", max_iter=10)
_classifier("fit_mlp", "mlp", hidden=(8,), epochs=50)

_MOMENTS = """(SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, count(*) AS n, regr_sxx(l_extendedprice, l_quantity) AS sxx,
regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem)"""


def _coefficients(fitted, digits):
    m = fitted.model
    row = [(float(m.coefficients[0]), float(m.intercept))]
    return lambda spark: rounded(spark.createDataFrame(row, "slope double, intercept double"), digits)


def _one_feature(name: str, model: str, slope: str, digits: int, **params):
    @query(name, f"SELECT round(b, {digits}) AS slope, round(my - b * mx, {digits}) AS intercept FROM (SELECT *, {slope} AS b FROM {_MOMENTS})")
    def run(spark, sf):
        return _coefficients(N.fit_model(priced(spark, sf), ONE, model, params, options=RAW), digits)(spark)


_one_feature("fit_linear", "linear_regression", "sxy / sxx", 4)
_one_feature("fit_ridge", "ridge", "sxy / (sxx + 100000)", 3, alpha=100000.0)
_one_feature("fit_lasso", "lasso", "(sxy / n - 1000) / (sxx / n)", 2, alpha=1000.0)


@query("fit_boosting_multiclass")
def fit_boosting_multiclass(spark, sf):
    p = priced(spark, sf)
    task = N.Task("multiclass", key="row_key", target="l_returnflag", features=("l_quantity", "l_discount"))
    fitted = N.fit_model(p, task, "hist_gradient_boosting", {"max_iter": 2, "max_depth": 2})
    return fitted.predict(p).groupBy("prediction").agg(F.count("*").alias("n"))


@query("fit_kmeans")
def fit_kmeans(spark, sf):
    v, task = kind(spark, sf, "clustering")
    fitted = N.fit_model(v, task, "kmeans", {"n_clusters": 10, "n_init": 2})
    return fitted.predict(v).select("vec_id", "prediction")


_PCA_TASK = N.Task("dimensionality_reduction", key="row_key", features=("l_quantity", "l_discount"))


@query("fit_pca", _EIGEN2 + " SELECT 'PC1' AS pc, round(e1 / (e1 + e2), 6) AS explained FROM e UNION ALL SELECT 'PC2', round(e2 / (e1 + e2), 6) FROM e")
def fit_pca(spark, sf):
    fitted = N.fit_model(priced(spark, sf), _PCA_TASK, "pca", {"n_components": 2}, options=RAW)
    rows = [(f"PC{i + 1}", v) for i, v in enumerate(fitted.extra["explained"])]
    return rounded(spark.createDataFrame(rows, "pc string, explained double"))


@query("fit_isolation_forest")
def fit_isolation_forest(spark, sf):
    v, task = kind(spark, sf, "anomaly_detection")
    fitted = N.fit_model(v, task, "isolation_forest", {"n_estimators": 50})
    return rounded(fitted.predict(v).select("vec_id", "score", "prediction"), 6)


_NEAR = f"""(SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.vector, b.vector) AS d FROM {VECTORS} a CROSS JOIN {VECTORS} b)"""


@query("fit_lof", f"""WITH p AS MATERIALIZED (SELECT * FROM {_NEAR}),
nt AS MATERIALIZED (SELECT i, j, d FROM p WHERE i <> j QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 20),
na AS MATERIALIZED (SELECT i, j, d FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 20),
kd AS (SELECT i, max(d) AS kd FROM nt GROUP BY 1),
dt AS MATERIALIZED (SELECT nt.i, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM nt JOIN kd ON kd.i = nt.j GROUP BY 1),
da AS (SELECT na.i, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM na JOIN kd ON kd.i = na.j GROUP BY 1),
lt AS (SELECT nt.i, avg(o.lrd) / any_value(s.lrd) AS lof FROM nt JOIN dt o ON o.i = nt.j JOIN dt s ON s.i = nt.i GROUP BY 1),
la AS (SELECT na.i, avg(o.lrd) / any_value(s.lrd) AS lof FROM na JOIN dt o ON o.i = na.j JOIN da s ON s.i = na.i GROUP BY 1)
SELECT i AS vec_id, round(lof - (SELECT quantile_cont(lof, 0.95) FROM lt), 6) AS score FROM la""")
def fit_lof(spark, sf):
    v, task = kind(spark, sf, "anomaly_detection")
    fitted = N.fit_model(v, task, "lof", options=RAW)
    return rounded(fitted.predict(v).select("vec_id", "score"), 6)


@query("anomaly_score")
def anomaly_score(spark, sf):
    v, task = kind(spark, sf, "anomaly_detection")
    fitted = N.fit_model(v, task, "isolation_forest", {"n_estimators": 30}, seed=1)
    return fitted.predict(v).agg(F.count("*").alias("rows"), F.sum("prediction").alias("flagged"))


@query("fit_lag_boosting")
def fit_lag_boosting(spark, sf):
    rows = placed(spark, sf)
    model = R.fit_lag_boosting(rows, KEY, lags=5, max_iter=10)
    return rounded(model.forecast(rows, 7), 4)


# runs -----------------------------------------------------------------------------------------------


@query("train_model")
def train_model(spark, sf):
    run = N.train_model(docs(spark, sf), DOC_TASK, "logistic_regression")
    return rounded(run.leaderboard(), 4)


_KEYED = """(SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_key, l_quantity AS x, l_extendedprice AS y FROM lineitem)"""
_H = unit_hash_sql("row_key", seed=0)
# Equal folds in hash order, and the least squares line of the other folds for each of them;
# `shrink` is the penalty of a ridge fit on the standardised feature.
_FOLDS = f"""(SELECT x, y, CASE WHEN pos < (n % 5) * (n // 5 + 1) THEN pos // (n // 5 + 1) ELSE (pos - n % 5) // (n // 5) END AS fold
FROM (SELECT *, row_number() OVER (ORDER BY {_H}) - 1 AS pos, count(*) OVER () AS n FROM {_KEYED}))"""


def cv_sql(shrink: float) -> str:
    """rmse, mae and r2 per fold, on the train and on the held-out rows."""
    parts = " UNION ALL ".join(
        f"SELECT fold, '{m}' AS metric, max({e}) FILTER (NOT held) AS train, max({e}) FILTER (held) AS val FROM v GROUP BY fold"
        for m, e in (("rmse", "rmse"), ("mae", "mae"), ("r2", "r2")))
    return f"""(WITH f AS MATERIALIZED (SELECT * FROM {_FOLDS}),
b AS (SELECT g AS fold, avg(x) AS mx, avg(y) AS my, regr_sxy(y, x) / (regr_sxx(y, x) * (1 + {shrink} / count(*))) AS b
  FROM f, range(5) r(g) WHERE f.fold <> g GROUP BY 1),
v AS (SELECT b.fold::INTEGER AS fold, f.fold = b.fold AS held, sqrt(avg((y - my - b * (x - mx)) ** 2)) AS rmse,
  avg(abs(y - my - b * (x - mx))) AS mae, 1 - sum((y - my - b * (x - mx)) ** 2) / (var_pop(y) * count(*)) AS r2 FROM f, b GROUP BY 1, 2)
{parts})"""


CV = f"SELECT fold, metric, round(train, 4) AS train, round(val, 4) AS val FROM {cv_sql(0)}"


@query("cv_scores", CV)
def cv_scores(spark, sf):
    return rounded(N.cv_scores(priced(spark, sf), ONE, "linear_regression"), 4)


DAY_TASK = N.Task("forecasting", key="day", target="y", time_column="day", features=())


def days(spark, sf):
    return placed(spark, sf).groupBy("day").agg(F.round(F.sum("y"), 4).alias("y"))


def cv_season_sql(period: int) -> str:
    """Expanding folds over the daily totals: the last season of the history is repeated."""
    return f"""WITH s AS (SELECT day, round(sum(y), 4) AS y FROM {DAILY_EVENTS} GROUP BY day),
p AS (SELECT y, row_number() OVER (ORDER BY day) - 1 AS pos, count(*) OVER () AS n FROM s),
f AS (SELECT f - 1 AS fold, n - 5 * (n // 6) + (f - 1) * (n // 6) AS a, n // 6 AS size FROM (SELECT max(n) AS n FROM p), range(1, 6) r(f)),
v AS (SELECT fold, h.y AS y, t.y AS g FROM f JOIN p h ON h.pos >= a AND h.pos < a + size
  JOIN p t ON t.pos = a - least({period}, a) + (h.pos - a) % least({period}, a)),
o AS (SELECT fold, h.y AS y, t.y AS g FROM f JOIN p h ON h.pos < a JOIN p t ON t.pos = h.pos - least({period}, a)),
e AS (SELECT fold, 'val' AS part, y, g FROM v UNION ALL SELECT fold, 'train', y, g FROM o),
m AS (SELECT fold, part, avg(abs(y - g)) AS mae, sqrt(avg((y - g) ** 2)) AS rmse,
  100 * avg(2 * abs(y - g) / (abs(y) + abs(g))) AS smape FROM e GROUP BY 1, 2)
SELECT fold::INTEGER AS fold, metric, round(max(value) FILTER (part = 'train'), 4) AS train, round(max(value) FILTER (part = 'val'), 4) AS val
FROM (UNPIVOT m ON mae, rmse, smape INTO NAME metric VALUE value) GROUP BY 1, 2"""


@query("cv_naive", cv_season_sql(1))
def cv_naive(spark, sf):
    return rounded(N.cv_scores(days(spark, sf), DAY_TASK, "naive"), 4).filter("metric <> 'mase'")


@query("cv_seasonal_naive", cv_season_sql(3))
def cv_seasonal_naive(spark, sf):
    return rounded(N.cv_scores(days(spark, sf), DAY_TASK, "seasonal_naive", {"period": 3}), 4).filter("metric <> 'mase'")


# One feature, hash folds: the validation RMSE of least squares has a closed form.
@query("leaderboard_stats", """WITH s AS (SELECT run, fold, v, t FROM (SELECT l_returnflag AS run, l_linenumber AS fold, avg(l_discount) AS v, avg(l_tax) AS t FROM lineitem GROUP BY 1, 2))
SELECT run, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(avg(t), 6) AS train_mean, round(avg(t) - avg(v), 6) AS gap, count(*) AS folds FROM s GROUP BY 1""")
def leaderboard_stats(spark, sf):
    folds = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("run"), "l_linenumber").agg(
        F.avg("l_discount").alias("val"), F.avg("l_tax").alias("train"))
    return rounded(N.leaderboard_stats(folds, ["run"]))


@query("leaderboard_order", "SELECT l_returnflag AS run_id, max(l_shipdate)::VARCHAR AS trained_at FROM lineitem GROUP BY 1")
def leaderboard_order(spark, sf):
    runs = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("run_id")).agg(
        F.max("l_shipdate").cast("string").alias("trained_at"))
    return N.leaderboard_order(runs)


@query("tune")
def tune(spark, sf):
    return rounded(N.tune(docs(spark, sf), DOC_TASK, "logistic_regression", trials=5, frozen={"max_iter": 100}), 4)


def tune_sql(trials: int, seed: int = 0) -> str:
    """Successive halving of ridge fits on one standardised feature, in closed form."""
    rng = random.Random(seed)
    drawn = [N.draw(N.spec_of("ridge", "regression"), rng, {"fit_intercept": True}) for _ in range(trials)]
    values = ", ".join(f"({t}, '{json.dumps(p, sort_keys=True)}', {p['alpha']!r}::DOUBLE)" for t, p in enumerate(drawn))
    return f"""WITH k AS MATERIALIZED (SELECT x, y, {unit_hash_sql('row_key', seed='tune:0')} AS u,
  row_number() OVER (ORDER BY {_H}) <= ceil(0.25 * count(*) OVER ()) AS held FROM {_KEYED}),
m AS (SELECT share, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, count(*) AS n
  FROM k, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) AS r(share) WHERE NOT held AND u < share GROUP BY share),
a AS (SELECT * FROM (VALUES {values}) AS v(trial, params, alpha)),
s AS MATERIALIZED (SELECT trial, share, sqrt(avg((y - my - sxy / (sxx * (1 + alpha / n)) * (x - mx)) ** 2)) AS score
  FROM k, m, a WHERE held GROUP BY trial, share),
r1 AS (SELECT trial FROM s WHERE share = 0.25 ORDER BY score, trial LIMIT {-(-trials // 2)}),
r2 AS (SELECT trial FROM s JOIN r1 USING (trial) WHERE share = 0.5 ORDER BY score, trial LIMIT {-(-(-(-trials // 2)) // 2)}),
z AS (SELECT trial, score FROM s JOIN r2 USING (trial) WHERE share = 1.0 ORDER BY score, trial LIMIT 1)
SELECT trial::INTEGER AS trial, params, round(score, 4) AS score, share < 1.0 AS pruned, trial IN (SELECT trial FROM z) AS best
FROM s JOIN a USING (trial) WHERE share = CASE WHEN trial IN (SELECT trial FROM r2) THEN 1.0 WHEN trial IN (SELECT trial FROM r1) THEN 0.5 ELSE 0.25 END"""


@query("tune_ridge", tune_sql(4))
def tune_ridge(spark, sf):
    return rounded(N.tune(priced(spark, sf), ONE, "ridge", trials=4, frozen={"fit_intercept": True}), 4)


@query("tune_forecast")
def tune_forecast(spark, sf):
    return rounded(N.tune(days(spark, sf), DAY_TASK, "seasonal_naive", trials=4), 4)


@query("auto_compare", " UNION ALL ".join(
    f"""SELECT '{m}' AS model, metric, round(avg(val), 4) AS mean, round(stddev_samp(val), 4) AS std, round(avg(train), 4) AS train_mean,
    round(avg(train) - avg(val), 4) AS gap, count(*) AS folds FROM {cv_sql(a)} GROUP BY metric""" for m, a in (("linear_regression", 0), ("ridge", 1000))))
def auto_compare(spark, sf):
    return rounded(N.auto_compare(
        priced(spark, sf), ONE, ["linear_regression", "ridge"], params={"ridge": {"alpha": 1000.0}}), 4)


@query("sidecar_metrics", f"SELECT 'run' AS run_id, * FROM ({CV})")
def sidecar_metrics(spark, sf):
    folds = N.cv_scores(priced(spark, sf), ONE, "linear_regression")
    path = f"{scratch_dir(spark, 'metrics')}/run"
    folds.withColumn("run_id", F.lit("run")).write.json(path)
    return rounded(spark.read.schema("run_id string, fold int, metric string, train double, val double").json(path), 4)


@query("persist_model", "SELECT count(*) AS rows, count(*) AS same FROM labels JOIN documents USING (doc_id)")
def persist_model(spark, sf):
    d, fitted = fitted_docs(spark, sf, "decision_tree", max_depth=4)
    path = N.save_model(fitted, f"{scratch_dir(spark, 'model')}/run")
    again = N.load_model(spark, path).predict(d).select("doc_id", F.col("prediction").alias("again"))
    return fitted.predict(d).join(again, "doc_id").agg(
        F.count("*").alias("rows"), F.count_if(F.col("prediction") == F.col("again")).alias("same"))


def _kept(spark, fitted, df, key):
    """Rows, and rows whose predictions are the same after the model was stored and loaded."""
    own = fitted.predict(df)
    # means of neighbours are sums in any order
    told = F.struct(*[
        F.round(F.col(c), 6).alias(c) if own.schema[c].dataType.typeName() == "double" else F.col(c)
        for c in own.columns if c not in df.columns])
    again = N.load_model(spark, N.save_model(fitted, f"{scratch_dir(spark, 'model')}/run")).predict(df)
    again = again.select(F.col(key).alias("__key"), told.alias("__again"))
    both = own.select(key, told.alias("__own"))
    both = both.join(again, both[key] == again["__key"])
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("__own").eqNullSafe(F.col("__again"))).alias("same"))


_DAYS = f"(SELECT count(DISTINCT day) AS n FROM {DAILY_EVENTS})"


@query("model_store", f"""SELECT unnest(['isolation_forest', 'lof']) AS model, n AS rows, n AS same FROM (SELECT count(*) AS n FROM embeddings)
UNION ALL SELECT 'seasonal_naive', n, n FROM {_DAYS}
UNION ALL SELECT 'apriori', n, n FROM (SELECT count(DISTINCT basket) AS n FROM {B})
UNION ALL SELECT 'ridge', n, n FROM (SELECT count(*) AS n FROM labels JOIN documents USING (doc_id))""")
def model_store(spark, sf):
    v, anomalies = kind(spark, sf, "anomaly_detection")
    s, o, d = days(spark, sf), stored(orders(spark, sf)), docs(spark, sf)
    amount = N.Task("regression", key="doc_id", target="n_chars", features=("lang", "quality"))
    runs = [
        (v, anomalies, "isolation_forest", {"n_estimators": 20}), (v, anomalies, "lof", {}),
        (s, DAY_TASK, "seasonal_naive", {"period": 3}),
        (o, ORDER_TASK, "apriori", ORDER_PARAMS),
        (d, amount, "ridge", {}),
    ]
    parts = [
        _kept(spark, N.fit_model(df, task, name, params), df, task.key).select(F.lit(name).alias("model"), "rows", "same")
        for df, task, name, params in runs]
    return reduce(DataFrame.unionByName, parts)


# association as a training task: one row per order, its brands in an array
ORDER_TASK = N.Task("association", key="o_orderkey", features=("brands",))
ORDER_PARAMS = {"min_support": SUPPORT, "min_confidence": CONFIDENCE, "min_lift": LIFT}


def orders(spark, sf):
    return baskets(spark, sf).groupBy(F.col("basket").alias("o_orderkey")).agg(F.collect_set("item").alias("brands"))


@query("fit_association", f"SELECT unnest(['support', 'confidence', 'lift']) AS metric, unnest([round(avg(support), 6), round(avg(confidence), 6), round(avg(lift), 6)]) AS value FROM {RULES}")
def fit_association(spark, sf):
    o = orders(spark, sf)
    fitted = N.fit_model(o, ORDER_TASK, "apriori", ORDER_PARAMS)
    values = N.score_rows(fitted, o, N.metric_plan(o, ORDER_TASK))
    return spark.createDataFrame(sorted(values.items()), "metric string, value double")


@query("predict_association", f"""SELECT basket AS o_orderkey, coalesce(items, '') AS prediction FROM (SELECT DISTINCT basket FROM {B})
LEFT JOIN (SELECT basket, string_agg(item, ', ' ORDER BY place) AS items FROM {_TOP} GROUP BY 1) USING (basket)""")
def predict_association(spark, sf):
    o = orders(spark, sf)
    return N.fit_model(o, ORDER_TASK, "apriori", ORDER_PARAMS).predict(o).select("o_orderkey", "prediction")


@query("train_association")
def train_association(spark, sf):
    return rounded(N.train_model(orders(spark, sf), ORDER_TASK, "apriori", ORDER_PARAMS).leaderboard(), 4)


@query("predict_frame", f"""SELECT row_key, y AS l_extendedprice, round(exp(a + b * x) - 1, 2) AS prediction FROM {_KEYED},
(SELECT regr_slope(ln(1 + y), x) AS b, regr_intercept(ln(1 + y), x) AS a FROM {_KEYED})""")
def predict_frame(spark, sf):
    p = priced(spark, sf)
    fitted = N.fit_model(p, ONE, "linear_regression", options=N.PreprocessingOptions(target_transform="log"))
    return rounded(fitted.predict(p).select("row_key", "l_extendedprice", "prediction"), 2)


_HELD = f"(SELECT x, y, row_number() OVER (ORDER BY {_H}) <= ceil(0.2 * count(*) OVER ()) AS held FROM {_KEYED})"
_TEST = f"""(SELECT y, y - a - b * x AS err FROM {_HELD}, (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM {_HELD} WHERE NOT held) WHERE held)"""


@query("evaluate_test", f"""SELECT 'rmse' AS metric, round(sqrt(avg(err * err)), 4) AS value FROM {_TEST} UNION ALL SELECT 'mae', round(avg(abs(err)), 4) FROM {_TEST}
UNION ALL SELECT 'r2', round(1 - sum(err * err) / (var_pop(y) * count(*)), 4) FROM {_TEST}""")
def evaluate_test(spark, sf):
    prepared = N.run_preprocessing(priced(spark, sf), ONE, N.PreprocessingOptions())
    fitted = N.fit_model(prepared.frame.filter("split = 'train'").drop("split"), ONE, "linear_regression")
    return rounded(R.evaluate_test(fitted, prepared), 4)


@query("evaluate_test_classifier")
def evaluate_test_classifier(spark, sf):
    prepared = N.run_preprocessing(docs(spark, sf), DOC_TASK, N.PreprocessingOptions())
    fitted = N.fit_model(prepared.frame.filter("split = 'train'").drop("split"), DOC_TASK, "logistic_regression")
    return rounded(R.evaluate_test(fitted, prepared), 5)


@query("scan_batch_score")
def scan_batch_score(spark, sf):
    from tabloom.sources.files import scan_csv
    d, fitted = fitted_docs(spark, sf, "decision_tree", max_depth=4)
    path = f"{scratch_dir(spark, 'batch')}/rows"
    d.write.option("header", True).csv(path)
    return fitted.predict(scan_csv(spark, path, schema=d.schema)).select("doc_id", "prediction")


_STD = f"(SELECT stddev_samp(truth - prediction) AS s FROM {REGRESSED})"


@query("prediction_interval", f"SELECT row_key, round(prediction - 1.959963984540054 * s, 3) AS lower, round(prediction + 1.959963984540054 * s, 3) AS upper FROM {REGRESSED}, {_STD}")
def prediction_interval(spark, sf):
    r = regressed(spark, sf)
    std = r.agg(F.stddev_samp(F.col("truth") - F.col("prediction"))).first()[0]
    return rounded(R.prediction_interval(r, "prediction", std).select("row_key", "lower", "upper"), 3)


@query("confidence_bands", f"""SELECT row_key, round(prediction + lo, 3) AS lower, round(prediction + hi, 3) AS upper FROM {REGRESSED},
(SELECT quantile_cont(truth - prediction, 0.025) AS lo, quantile_cont(truth - prediction, 0.975) AS hi FROM {REGRESSED})""")
def confidence_bands(spark, sf):
    r = regressed(spark, sf).withColumn("residual", F.col("truth") - F.col("prediction"))
    return rounded(R.confidence_bands(r, r, "prediction", "residual").select("row_key", "lower", "upper"), 3)


_CENTERS = f"(SELECT cluster, list(m ORDER BY d) AS center FROM (SELECT cluster, d, avg(x) AS m FROM {VECTOR_CELLS} GROUP BY 1, 2) GROUP BY 1)"


@query("nearest_centroid", f"""SELECT vec_id, arg_min(c.cluster, list_distance(v.vector, c.center)) AS assigned FROM {VECTORS} v CROSS JOIN {_CENTERS} c GROUP BY 1""")
def nearest_centroid(spark, sf):
    v = vectors(spark, sf)
    return R.nearest_centroid(v, M.centroids(v), "vector").select("vec_id", "assigned")


# PCA metrics and rows -------------------------------------------------------------------------------


def _pca(spark, sf, n):
    v, task = kind(spark, sf, "dimensionality_reduction")
    return v, N.fit_model(v, task, "pca", {"n_components": n})


@query("metric_pca")
def metric_pca(spark, sf):
    v, fitted = _pca(spark, sf, 10)
    plan = N.MetricPlan("explained_variance", ("explained_variance", "reconstruction_error"))
    values = N.score_rows(fitted, v, plan)
    return rounded(spark.createDataFrame([(k, float(x)) for k, x in values.items()], "metric string, value double"), 5)


# With one of two components kept, the mean squared reconstruction error is the smaller
# eigenvalue of the population covariance, spread over two features.
@query("metric_pca_two", _EIGEN2 + " SELECT round(e2 * (n - 1) / n / 2, 8) AS reconstruction_error FROM e, (SELECT count(*) AS n FROM lineitem)")
def metric_pca_two(spark, sf):
    p = priced(spark, sf)
    fitted = N.fit_model(p, _PCA_TASK, "pca", {"n_components": 1}, options=RAW)
    plan = N.MetricPlan("reconstruction_error", ("reconstruction_error",))
    value = N.score_rows(fitted, p, plan)["reconstruction_error"]
    return rounded(spark.createDataFrame([(value,)], "reconstruction_error double"), 8)


@query("reconstruction_rows", f"""WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_discount) AS my,
0.5 * atan2(2 * covar_samp(l_quantity, l_discount), var_samp(l_quantity) - var_samp(l_discount)) AS t FROM lineitem),
r AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_key, abs((l_discount - my) * cos(t) - (l_quantity - mx) * sin(t)) AS error FROM lineitem, m)
SELECT row_key, round(error, 6) AS error, round((SELECT quantile_cont(error, 0.8) FROM r), 6) AS threshold FROM r""")
def reconstruction_rows(spark, sf):
    p = priced(spark, sf)
    fitted = N.fit_model(p, _PCA_TASK, "pca", {"n_components": 1}, options=RAW)
    return rounded(O.reconstruction_rows(fitted, p).drop("above"), 6)


@query("explain_pca")
def explain_pca(spark, sf):
    v, fitted = _pca(spark, sf, 3)
    return rounded(long_report(X.explain_pca(fitted, v), {
        "loading": ("loadings", "pc", "feature", "loading"), "variance": ("variance_explained", "pc", None, "explained"),
        "error": ("reconstruction_error", "feature", None, "mean_squared_error")}), 5)


# explanations -----------------------------------------------------------------------------------------


@query("explain_linear", f"SELECT 'l_quantity' AS feature, round(sxy / sxx, 4) AS coefficient, NULL::DOUBLE AS odds_ratio FROM {_MOMENTS}")
def explain_linear(spark, sf):
    fitted = N.fit_model(priced(spark, sf), ONE, "linear_regression", options=RAW)
    return rounded(X.explain_linear(fitted, spark), 4)


@query("explain_linear_odds")
def explain_linear_odds(spark, sf):
    _, fitted = fitted_docs(spark, sf, "logistic_regression")
    return rounded(X.explain_linear(fitted, spark), 4)


@query("explain_linear_local", f"SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_key, round(l_quantity * sxy / sxx, 3) AS l_quantity FROM lineitem, {_MOMENTS}")
def explain_linear_local(spark, sf):
    p = priced(spark, sf)
    return rounded(X.explain_linear_local(N.fit_model(p, ONE, "linear_regression", options=RAW), p), 3)


@query("explain_tree")
def explain_tree(spark, sf):
    _, fitted = fitted_docs(spark, sf, "random_forest", n_estimators=10, max_depth=5)
    return rounded(X.explain_tree(fitted, spark), 4)


@query("explain_permutation")
def explain_permutation(spark, sf):
    d, fitted = fitted_docs(spark, sf, "decision_tree", max_depth=4)
    return rounded(X.explain_permutation(fitted, d, repeats=2), 4)


# the average curve, then the curve of every row: with one feature both follow the line
@query("explain_pdp_ice", f"""WITH c AS (SELECT 'l_quantity' AS feature, g AS grid, round(my + sxy / sxx * (g - mx), 3) AS value
FROM (SELECT DISTINCT l_quantity AS g FROM lineitem), {_MOMENTS})
SELECT feature, grid, value AS average, NULL::VARCHAR AS row_key, NULL::DOUBLE AS response FROM c
UNION ALL SELECT feature, grid, NULL, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber), value FROM lineitem, c""")
def explain_pdp_ice(spark, sf):
    p = priced(spark, sf)
    fitted = N.fit_model(p, ONE, "linear_regression", options=RAW)
    views = X.explain_pdp_ice(fitted, p)
    return rounded(views["average"].unionByName(views["ice"], allowMissingColumns=True), 3)


@query("explain_ice_tree")
def explain_ice_tree(spark, sf):
    d, fitted = fitted_docs(spark, sf, "decision_tree", max_depth=4)
    return rounded(X.explain_pdp_ice(fitted, d, curves_of=d)["ice"], 4)


@query("explain_ig")
def explain_ig(spark, sf):
    d, fitted = fitted_docs(spark, sf, "mlp", hidden=(8,), epochs=50)
    return rounded(X.explain_ig(fitted, d), 4)


@query("explain_clusters", f"""SELECT 'anova' AS part, feature AS a, '' AS b, round(f_ratio, 5) AS value FROM {ANOVA}
UNION ALL SELECT 'persona', cluster::VARCHAR, feature, round(deviation, 5) FROM {personas_sql(_F)}
UNION ALL SELECT 'centroid', l_linenumber::VARCHAR, '', round(avg(l_quantity), 5) FROM lineitem GROUP BY l_linenumber""")
def explain_clusters(spark, sf):
    return rounded(long_report(X.explain_clusters(lines(spark, sf), "cluster", _F), {
        "anova": ("anova", "feature", None, "f_ratio"), "persona": ("personas", "cluster", "feature", "deviation"),
        "centroid": ("centroids", "cluster", None, "l_quantity")}), 5)


@query("explain_model")
def explain_model(spark, sf):
    d, fitted = fitted_docs(spark, sf, "decision_tree", max_depth=3)
    return rounded(X.explain_model(fitted, d)["importances"], 4)


@query("error_views", f"""SELECT 'by_quantile' AS part, bin::VARCHAR AS a, mean_abs_error AS value FROM ({ERROR_BY_QUANTILE})
UNION ALL SELECT 'histogram', bin::VARCHAR, count::DOUBLE FROM ({RESIDUAL_HIST})
UNION ALL SELECT 'spearman', '', round(spearman, 4) FROM ({HETERO})""")
def error_views(spark, sf):
    views = E.error_views(regressed(spark, sf), "regression", "row_key")
    return rounded(long_report(views, {
        "by_quantile": ("by_quantile", "bin", None, "mean_abs_error"), "histogram": ("histogram", "bin", None, "count"),
        "spearman": ("heteroscedasticity", None, None, "spearman")}).drop("b"), 4)


@query("error_views_unsupervised", """WITH s AS (SELECT l_linenumber AS cluster, count(*) AS size FROM lineitem GROUP BY 1),
w AS (SELECT (l_extendedprice - 40000) AS score, l_orderkey * 10 + l_linenumber AS row_key FROM lineitem)
SELECT 'imbalance' AS part, cluster::VARCHAR AS a, size::DOUBLE AS value FROM s
UNION ALL SELECT 'flagged', '', count(*)::DOUBLE FROM w WHERE score > 0
UNION ALL SELECT 'worst', row_key::VARCHAR, round(score, 4) FROM (SELECT * FROM w ORDER BY score DESC, row_key LIMIT 10)""")
def error_views_unsupervised(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_key"), F.col("l_linenumber").alias("cluster"),
        (F.col("l_extendedprice") - 40000).alias("score"), F.array(F.col("l_quantity")).alias("vector"))
    sizes = E.error_views(rows, "clustering", "row_key")["imbalance"]
    odd = E.error_views(rows, "anomaly_detection", "row_key")
    parts = [
        sizes.select(F.lit("imbalance").alias("part"), F.col("cluster").cast("string").alias("a"), F.col("size").cast("double").alias("value")),
        odd["flagged"].agg(F.lit("flagged").alias("part"), F.lit("").alias("a"), F.count("*").cast("double").alias("value")),
        odd["worst"].select(F.lit("worst").alias("part"), F.col("row_key").cast("string").alias("a"), F.round("score", 4).alias("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("error_views_anomaly", """SELECT count(*) FILTER (l_returnflag = 'R' AND l_quantity > 40) AS tp, count(*) FILTER (l_returnflag <> 'R' AND l_quantity > 40) AS fp,
count(*) FILTER (l_returnflag = 'R' AND l_quantity <= 40) AS fn, count(*) FILTER (l_returnflag <> 'R' AND l_quantity <= 40) AS tn FROM lineitem""")
def error_views_anomaly(spark, sf):
    rows = priced(spark, sf).select("row_key", (F.col("l_quantity") - 40).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("truth"))
    return E.error_views(rows, "anomaly_detection", "row_key")["confusion"]


# the axes of a PCA are unit vectors at right angles, and lengths along all of them add up to the total
@query("pca_axes", f"""SELECT i.i::INTEGER AS i, j.i::INTEGER AS j, (i.i = j.i)::INTEGER::DOUBLE AS dot FROM range(1, 4) i(i), range(1, 4) j(i)
UNION ALL SELECT 0, 0, round(sum(v), 5) FROM (SELECT var_samp(x) AS v FROM {VECTOR_CELLS} GROUP BY d)""")
def pca_axes(spark, sf):
    v, task = kind(spark, sf, "dimensionality_reduction")
    fitted = N.fit_model(v, task, "pca", {"n_components": len(task.features)}, options=RAW)
    axes = fitted.model.stages[1].pc.toArray()[:, :3]
    dots = axes.T @ axes
    rows = [(i + 1, j + 1, abs(round(float(dots[i, j]), 6))) for i in range(3) for j in range(3)]
    rows.append((0, 0, round(float(sum(fitted.extra["eigenvalues"])), 5)))
    return spark.createDataFrame(rows, "i int, j int, dot double")


@query("kmeans_fixed_point", "SELECT count(*) AS rows, count(*) AS nearest FROM embeddings")
def kmeans_fixed_point(spark, sf):
    """Rows whose cluster is that of the nearest centre of the fit."""
    v, task = kind(spark, sf, "clustering")
    fitted = N.fit_model(v, task, "kmeans", {"n_clusters": 6, "n_init": 1})
    centers = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(fitted.model.clusterCenters())], "cluster int, center array<double>")
    from pyspark.ml.functions import vector_to_array
    rows = fitted.vectors(v).select("vec_id", vector_to_array("features").alias("vector"))
    both = R.nearest_centroid(rows, centers, "vector").join(fitted.predict(v).select("vec_id", "prediction"), "vec_id")
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("assigned") == F.col("prediction")).alias("nearest"))


@query("error_views_binary")
def error_views_binary(spark, sf):
    d, fitted = fitted_docs(spark, sf, "logistic_regression")
    scored = fitted.predict(d).withColumn("truth", F.col("quality"))
    return E.error_views(scored, "binary", "doc_id", score="p_1")["confusion"]


@query("learning_curve")
def learning_curve(spark, sf):
    d, fitted = fitted_docs(spark, sf, "hist_gradient_boosting", max_iter=10)
    return rounded(O.learning_curve(fitted, d), 4)


# outcomes and bundles -----------------------------------------------------------------------------------


@query("outcome_supervised")
def outcome_supervised(spark, sf):
    d, fitted = fitted_docs(spark, sf, "logistic_regression")
    _, out = O.outcome_supervised(fitted, d, threshold=0.4, refit_on_all=True)
    O.package({"predictions": out}, scratch_dir(spark, "outcome"))
    return rounded(out.select("doc_id", "prediction", "p_1", "prediction_at_threshold"), 4)


@query("outcome_unsupervised", f"""{PROFILES}""")
def outcome_unsupervised(spark, sf):
    from tabloom.operators.clusters import cluster_profiles
    profiles = cluster_profiles(lines(spark, sf), "cluster", _F)
    path = O.package({"profiles": profiles}, scratch_dir(spark, "outcome"))[0]
    return rounded(spark.read.option("header", True).schema(profiles.schema).csv(path), 5)


@query("outcome_clusters")
def outcome_clusters(spark, sf):
    v, task = kind(spark, sf, "clustering")
    fitted = N.fit_model(v, task, "kmeans", {"n_clusters": 10, "n_init": 1})
    return rounded(O.outcome_unsupervised(fitted, v)["personas"], 4)


@query("outcome_anomalies")
def outcome_anomalies(spark, sf):
    v, task = kind(spark, sf, "anomaly_detection")
    fitted = N.fit_model(v, task, "isolation_forest", {"n_estimators": 30})
    return rounded(O.outcome_unsupervised(fitted, v)["score_distribution"], 4)


@query("outcome_embeddings")
def outcome_embeddings(spark, sf):
    v, fitted = _pca(spark, sf, 5)
    return rounded(O.outcome_unsupervised(fitted, v)["summary"], 4)


@query("outcome_rules", f"SELECT array_to_string(antecedent, ' + ') AS antecedent, array_to_string(consequent, ' + ') AS consequent, support FROM {RULES}")
def outcome_rules(spark, sf):
    return O.outcome_rules(rules(spark, sf))["rules"].select("antecedent", "consequent", "support")


@query("anomaly_report", f"""SELECT 'zscore' AS part, feature AS a, flagged::DOUBLE AS value FROM ({ZSCORE.format(t='events')})
UNION ALL SELECT 'above', feature, above::DOUBLE FROM ({IQR})
UNION ALL SELECT 'mahalanobis', '', flagged::DOUBLE FROM ({MAHALANOBIS.replace('l_quantity', 'user_id').replace('l_extendedprice', 'value').replace('lineitem', 'events')})""")
def anomaly_report_query(spark, sf):
    e = table(spark, sf, "events")
    return long_report(anomaly_report(e, ["value", "user_id"]), {
        "zscore": ("zscore", "feature", None, "flagged"), "above": ("iqr", "feature", None, "above"),
        "mahalanobis": ("mahalanobis", None, None, "flagged")}).drop("b")


@query("dimred_report", f"SELECT 'vif' AS part, feature AS a, vif AS value FROM ({_VIF_SQL})")
def dimred_report_query(spark, sf):
    bundle = dimred_report(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(long_report(bundle, {"vif": ("vif", "feature", None, "vif")}).drop("b"))


@query("clustering_report")
def clustering_report(spark, sf):
    from tabloom.operators.clusters import hopkins
    from tabloom.operators.profile import components_for
    v = vector_columns(spark, sf)
    a = hopkins(vectors(spark, sf), "vec_id", "vector").select(F.lit("hopkins").alias("part"), F.col("hopkins").alias("value"))
    b = components_for(v, [c for c in v.columns if c.startswith("e")])
    return rounded(a.union(b.select(F.lit("components_for_90"), F.col("components").cast("double"))))


@query("classification_report", """SELECT 'class_counts' AS part, l_returnflag AS a, '' AS b, count(*)::DOUBLE AS value FROM lineitem GROUP BY 2
UNION ALL SELECT 'feature_by_class', l_linestatus, l_returnflag, count(*)::DOUBLE FROM lineitem GROUP BY 2, 3""")
def classification_report_query(spark, sf):
    bundle = classification_report(table(spark, sf, "lineitem"), "l_returnflag", ["l_linestatus"])
    return long_report(bundle, {
        "class_counts": ("class_counts", "l_returnflag", None, "count"),
        "feature_by_class": ("feature_by_class", "value", "class", "count")})


_PAIRS = (("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_quantity", "l_extendedprice"),
          ("l_discount", "l_tax"), ("l_discount", "l_extendedprice"), ("l_tax", "l_extendedprice"))


@query("eda_report", "SELECT 'skew' AS part, 'l_extendedprice' AS a, '' AS b, round(skewness(l_extendedprice), 5) AS value FROM lineitem"
    + "".join(f" UNION ALL SELECT 'mean', '{c}', '', round(avg({c}), 5) FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice"))
    + "".join(f" UNION ALL SELECT 'pearson', '{a}', '{b}', round(corr({a}, {b}), 5) FROM lineitem" for a, b in _PAIRS)
    + f" UNION ALL SELECT 'histogram', bin::VARCHAR, '', count::DOUBLE FROM ({histogram_sql('lineitem', 'l_extendedprice', 30, True)})")
def eda_report(spark, sf):
    from tabloom.operators.reports import eda_report as report
    bundle = report(priced(spark, sf), N.Task("regression", key="row_key", target="l_extendedprice"))
    return rounded(long_report(bundle, {
        "skew": ("target_skew", "column", None, "skew"), "histogram": ("target_histogram", "bin", None, "count"),
        "mean": ("describe", "column", None, "mean"), "pearson": ("pearson", "left", "right", "r")}), 5)
