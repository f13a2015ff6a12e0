"""Queries for metrics, error analysis and cluster statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.hashing import unit_hash_sql
from tabloom.operators import clusters as K
from tabloom.operators import errors as E
from tabloom.operators import metrics as M
from tabloom.operators import timeseries as T
from tabloom.plans.fixtures import (
    CLASSED, DAILY_EVENTS, REGRESSED, SCORED, VECTOR_CELLS, VECTORS, classed, daily_events, regressed,
    scored, vectors,
)
from tabloom.plans.registry import query, rounded
from tabloom.plans.series_queries import PLACED
from tabloom.session import table


@query("binary_indicator", "SELECT doc_id, (quality = (SELECT max(quality) FROM labels))::INTEGER AS y FROM labels")
def binary_indicator(spark, sf):
    l = table(spark, sf, "labels")
    return l.select("doc_id", M.binary_indicator("quality", M.positive_class(l, "quality")).alias("y"))


@query("outlier_label", "SELECT vec_id, (label <> 0)::INTEGER AS y FROM embeddings")
def outlier_label(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", M.outlier_label("label").alias("y"))


@query("apply_threshold", f"SELECT row_key, (p >= 0.5)::INTEGER AS y FROM {SCORED}")
def apply_threshold(spark, sf):
    return scored(spark, sf).select("row_key", M.apply_threshold(F.col("p")).alias("y"))


@query("flag_filter", f"SELECT row_key, p FROM {SCORED} WHERE p > 0.6")
def flag_filter(spark, sf):
    return E.flag_filter(scored(spark, sf).select("row_key", "p"), "p", 0.6, "row_key")


PER_CLASS = f"""(WITH c AS (SELECT * FROM {CLASSED}), l AS (SELECT truth AS label FROM c UNION SELECT prediction FROM c),
s AS (SELECT label, (SELECT count(*) FROM c WHERE truth = label AND prediction = label) AS tp,
(SELECT count(*) FROM c WHERE truth = label) AS support, (SELECT count(*) FROM c WHERE prediction = label) AS predicted FROM l)
SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
2 * tp / (support + predicted) AS f1 FROM s)"""
_SCORES = f"""(SELECT sum(tp) / sum(support) AS accuracy, avg(f1) AS macro_f1,
(sum(tp)::DOUBLE * sum(support) - sum(support::DOUBLE * predicted)) / (sqrt(sum(support)::DOUBLE ** 2 - sum(predicted::DOUBLE ** 2))
* sqrt(sum(support)::DOUBLE ** 2 - sum(support::DOUBLE ** 2))) AS mcc, avg(recall) FILTER (support > 0) AS balanced_accuracy FROM {PER_CLASS})"""


@query("metric_accuracy_f1", f"""SELECT round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS f1 FROM {_SCORES}
UNION ALL SELECT round(avg((truth = (p >= 0.5)::INTEGER)::INTEGER), 6), round(2 * count(*) FILTER (truth = 1 AND p >= 0.5)
/ (count(*) FILTER (truth = 1) + count(*) FILTER (p >= 0.5)), 6) FROM {SCORED}""")
def metric_accuracy_f1(spark, sf):
    many = M.classification_scores(classed(spark, sf))
    two = scored(spark, sf).withColumn("prediction", M.apply_threshold(F.col("p")))
    binary = M.classification_scores(two, positive=1)
    return rounded(many.select("accuracy", "f1").union(binary.select("accuracy", "f1")))


@query("metric_imbalanced", f"""SELECT round(macro_f1, 6) AS macro_f1, round(mcc, 6) AS mcc,
round(balanced_accuracy, 6) AS balanced_accuracy FROM {_SCORES}""")
def metric_imbalanced(spark, sf):
    return rounded(M.classification_scores(classed(spark, sf)).select("macro_f1", "mcc", "balanced_accuracy"))


STEPS = f"""(SELECT p AS score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS positives, sum(neg) OVER () AS negatives
FROM (SELECT p, count(*) FILTER (truth = 1) AS pos, count(*) FILTER (truth = 0) AS neg FROM {SCORED} GROUP BY 1)
WINDOW w AS (ORDER BY p DESC))"""


@query("metric_pr_auc", f"SELECT round(sum(pos / positives * (tp / (tp + fp))), 6) AS pr_auc FROM {STEPS}")
def metric_pr_auc(spark, sf):
    return rounded(M.ranking_scores(scored(spark, sf)).select("pr_auc"))


@query("metric_roc_auc", f"""WITH r AS (SELECT truth, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM {SCORED}),
n AS (SELECT sum(truth)::DOUBLE AS a, count(*) - sum(truth)::DOUBLE AS b, sum(r) FILTER (truth = 1) AS s FROM r)
SELECT round((s - a * (a + 1) / 2) / (a * b), 6) AS roc_auc FROM n""")
def metric_roc_auc(spark, sf):
    return rounded(M.ranking_scores(scored(spark, sf)).select("roc_auc"))


@query("roc_curve", f"SELECT score, round(fp / negatives, 6) AS fpr, round(tp / positives, 6) AS tpr FROM {STEPS}")
def roc_curve(spark, sf):
    return rounded(M.roc_curve(scored(spark, sf)))


@query("pr_curve", f"SELECT score, round(tp / (tp + fp), 6) AS precision, round(tp / positives, 6) AS recall FROM {STEPS}")
def pr_curve(spark, sf):
    return rounded(M.pr_curve(scored(spark, sf)))


@query("metric_regression", f"""SELECT round(sqrt(avg((truth - prediction) ** 2)), 4) AS rmse, round(avg(abs(truth - prediction)), 4) AS mae,
round(1 - sum((truth - prediction) ** 2) / (var_pop(truth) * count(*)), 6) AS r2 FROM {REGRESSED}""")
def metric_regression(spark, sf):
    return rounded(M.regression_scores(regressed(spark, sf)), 4, r2=6)


@query("metric_forecast", f"""WITH s AS (SELECT event_type, y, n_events * 20.0 AS p, lag(y, 7) OVER (PARTITION BY event_type ORDER BY day) AS b FROM {DAILY_EVENTS})
SELECT event_type, round(avg(abs(y - p)), 5) AS mae, round(sqrt(avg((y - p) ** 2)), 5) AS rmse,
round(100 * avg(abs(y - p) / abs(y)) FILTER (abs(y) > 1e-12), 5) AS mape,
round(100 * avg(2 * abs(y - p) / (abs(y) + abs(p))) FILTER (abs(y) > 1e-12), 5) AS smape,
round(avg(abs(y - p)) / avg(abs(y - b)), 5) AS mase FROM s GROUP BY 1""")
def metric_forecast(spark, sf):
    daily = daily_events(spark, sf).withColumn("prediction", F.col("n_events") * 20.0)
    from tabloom.functions.prefix import row_positions
    placed = row_positions(daily.withColumnRenamed("y", "truth"), "day", by=["event_type"])
    return rounded(M.forecast_scores(placed, ["event_type"], period=7), 5)


@query("metric_val_loss", f"""SELECT 'log_loss' AS loss_name, round(avg(CASE WHEN truth = 1 THEN -ln(q) ELSE -ln(1 - q) END), 6) AS loss
FROM (SELECT truth, greatest(least(p, 1 - 1e-15), 1e-15) AS q FROM {SCORED})
UNION ALL SELECT 'mse', round(avg((truth - prediction) ** 2), 2) FROM {REGRESSED}""")
def metric_val_loss(spark, sf):
    a = M.validation_loss(scored(spark, sf), "truth", "p", classification=True)
    b = M.validation_loss(regressed(spark, sf), "truth", "prediction", classification=False)
    return a.select(F.lit("log_loss").alias("loss_name"), F.round("loss", 6).alias("loss")).union(
        b.select(F.lit("mse"), F.round("loss", 2)))


def threshold_sql(values: str) -> str:
    return f"""SELECT t AS threshold, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(tp / n1, 6) AS recall,
round(2 * tp / (tp + fp + n1), 6) AS f1, round(1 - (fp + n1 - tp) / n, 6) AS accuracy FROM (SELECT t, count(*) AS n, sum(truth) AS n1,
count(*) FILTER (p >= t AND truth = 1) AS tp, count(*) FILTER (p >= t AND truth = 0) AS fp FROM {SCORED}, {values} GROUP BY t)"""


@query("threshold_metrics", threshold_sql("(SELECT 0.4::DOUBLE AS t)"))
def threshold_metrics(spark, sf):
    return rounded(M.threshold_metrics(scored(spark, sf), 0.4))


@query("threshold_eval", threshold_sql("(SELECT 0.5::DOUBLE AS t)"))
def threshold_eval(spark, sf):
    return rounded(M.threshold_metrics(scored(spark, sf)))


@query("threshold_table", threshold_sql("(SELECT (i / 8)::DOUBLE AS t FROM range(9) r(i))"))
def threshold_table(spark, sf):
    return rounded(M.threshold_table(scored(spark, sf)))


@query("calibration", f"""SELECT bin::INTEGER AS bin, round((bin + 0.5) / 10, 6)::DOUBLE AS center, round(avg(truth), 6) AS observed, count(truth) AS rows
FROM range(10) r(bin) LEFT JOIN {SCORED} s ON least(floor(p * 10), 9) = bin GROUP BY bin""")
def calibration(spark, sf):
    return rounded(M.calibration(scored(spark, sf)))


@query("metric_anomaly_mean", f"SELECT round(avg(p - 0.5), 6) AS score_distribution FROM {SCORED}")
def metric_anomaly_mean(spark, sf):
    s = scored(spark, sf).withColumn("score", F.col("p") - 0.5)
    return rounded(M.anomaly_mean(s))


@query("metric_ari_nmi", f"""WITH c AS (SELECT truth, prediction, count(*)::DOUBLE AS n FROM {CLASSED} GROUP BY 1, 2),
a AS (SELECT truth, sum(n) AS n FROM c GROUP BY 1), b AS (SELECT prediction, sum(n) AS n FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c),
x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS bt, (SELECT sum(n * (n - 1) / 2) FROM a) AS pa, (SELECT sum(n * (n - 1) / 2) FROM b) AS pb,
(SELECT -sum(n / t * ln(n / t)) FROM a, t) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM b, t) AS hb,
(SELECT sum(c.n / t * ln(t * c.n / (a.n * b.n))) FROM c JOIN a USING (truth) JOIN b USING (prediction), t) AS mi, t FROM t)
SELECT round((bt - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 6) AS adjusted_rand,
round(mi / ((ha + hb) / 2), 6) AS nmi FROM x""")
def metric_ari_nmi(spark, sf):
    return rounded(M.ari_nmi(classed(spark, sf)))


# errors ---------------------------------------------------------------------------------------


@query("row_error", f"SELECT row_key, round(prediction - truth, 4) AS residual, round(abs(prediction - truth), 4) AS error FROM {REGRESSED}")
def row_error(spark, sf):
    return rounded(E.row_error(regressed(spark, sf)).select("row_key", "residual", "error"), 4)


@query("join_pred_truth", """SELECT l_orderkey, l_linenumber, l_partkey, o_totalprice AS truth, l_extendedprice AS prediction
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def join_pred_truth(spark, sf):
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return l.join(o, l.l_orderkey == o.o_orderkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("o_totalprice").alias("truth"),
        F.col("l_extendedprice").alias("prediction"))


@query("worst_n", f"""SELECT row_key, round(abs(prediction - truth), 4) AS error FROM {REGRESSED}
ORDER BY abs(prediction - truth) DESC, row_key LIMIT 10""")
def worst_n(spark, sf):
    return rounded(E.worst_n(E.row_error(regressed(spark, sf)), "error", "row_key").select("row_key", "error"), 4)


@query("top_flagged", f"SELECT row_key, p FROM {SCORED} ORDER BY p DESC, row_key LIMIT 10")
def top_flagged(spark, sf):
    return E.worst_n(scored(spark, sf).select("row_key", "p"), "p", "row_key")


@query("segment_errors", f"""SELECT 'l_returnflag' AS "column", l_returnflag AS value, round(avg(abs(prediction - truth)), 4) AS mean_abs_error, count(*) AS rows FROM {REGRESSED} GROUP BY 2
UNION ALL SELECT 'l_linestatus', l_linestatus, round(avg(abs(prediction - truth)), 4), count(*) FROM {REGRESSED} GROUP BY 2
UNION ALL SELECT 'row_key', row_key::VARCHAR, round(avg(abs(prediction - truth)), 4), count(*) FROM {REGRESSED} GROUP BY 2""")
def segment_errors(spark, sf):
    e = E.row_error(regressed(spark, sf))
    return rounded(E.segment_errors(e, ["l_returnflag", "l_linestatus", "row_key"]), 4)


CONFUSION = f"""(SELECT a.label AS truth, b.label AS prediction, count(c.row_key) AS n FROM (SELECT DISTINCT label FROM {PER_CLASS}) a
CROSS JOIN (SELECT DISTINCT label FROM {PER_CLASS}) b LEFT JOIN {CLASSED} c ON c.truth = a.label AND c.prediction = b.label GROUP BY 1, 2)"""


@query("confusion", f"SELECT truth, prediction, n, round(n / nullif(sum(n) OVER (PARTITION BY truth), 0), 6) AS share FROM {CONFUSION}")
def confusion(spark, sf):
    return rounded(E.dense_confusion(classed(spark, sf)))


@query("top_confused", f"SELECT n AS count, truth, prediction FROM {CONFUSION} WHERE truth <> prediction ORDER BY n DESC, truth DESC, prediction DESC LIMIT 5")
def top_confused(spark, sf):
    return E.top_confused(classed(spark, sf))


@query("label_union", f"SELECT label FROM {PER_CLASS}")
def label_union(spark, sf):
    return M.label_union(classed(spark, sf))


@query("per_class", f"SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, support FROM {PER_CLASS}")
def per_class(spark, sf):
    return rounded(M.per_class(classed(spark, sf)).select("label", "precision", "recall", "support"))


@query("residual_points", f"SELECT row_key, round(prediction, 4) AS prediction, round(prediction - truth, 4) AS residual FROM {REGRESSED}")
def residual_points(spark, sf):
    return rounded(E.residual_points(regressed(spark, sf), "row_key"), 4)


RESIDUAL_HIST = f"""WITH r AS (SELECT prediction - truth AS r FROM {REGRESSED}), m AS (SELECT min(r) AS lo, (max(r) - min(r)) / 20 AS w FROM r),
k AS (SELECT least(floor((r - lo) / w) + 1, 20)::INTEGER AS bin, count(*) AS n FROM r, m GROUP BY 1)
SELECT b.bin::INTEGER AS bin, round(lo + (b.bin - 1) * w, 3) AS lower, round(lo + b.bin * w, 3) AS upper, coalesce(n, 0) AS count
FROM range(1, 21) b(bin) CROSS JOIN m LEFT JOIN k ON k.bin = b.bin"""


@query("residual_hist", RESIDUAL_HIST)
def residual_hist(spark, sf):
    return rounded(E.residual_histogram(regressed(spark, sf)), 3)


@query("qq_points", f"""SELECT row_key, round(prediction - truth, 4) AS residual,
round((row_number() OVER (ORDER BY prediction - truth, row_key) - 0.5) / count(*) OVER (), 8) AS plotting_position FROM {REGRESSED}""")
def qq_points(spark, sf):
    q = E.qq_points(regressed(spark, sf), "row_key")
    return rounded(q.select("row_key", "residual", "plotting_position"), 4, plotting_position=8)


HETERO = f"""SELECT round(corr(a, b), 6) AS spearman FROM (SELECT
rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2.0 AS a, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0 AS b
FROM (SELECT abs(prediction - truth) AS e, abs(prediction) AS q FROM {REGRESSED}))"""


@query("heteroscedasticity", HETERO)
def heteroscedasticity(spark, sf):
    return rounded(E.heteroscedasticity(regressed(spark, sf)))


ERROR_BY_QUANTILE = f"""WITH q AS (SELECT quantile_cont(truth, [0, 0.25, 0.5, 0.75, 1]) AS e FROM {REGRESSED}),
b AS (SELECT 1 + (truth > e[2])::INTEGER + (truth > e[3])::INTEGER + (truth > e[4])::INTEGER AS bin, e, abs(prediction - truth) AS err FROM {REGRESSED}, q)
SELECT bin, round(any_value(e[bin]), 4) AS lower, round(any_value(e[bin + 1]), 4) AS upper, round(avg(err), 4) AS mean_abs_error, count(*) AS rows FROM b GROUP BY 1"""


@query("error_by_quantile", ERROR_BY_QUANTILE)
def error_by_quantile(spark, sf):
    return rounded(E.error_by_quantile(regressed(spark, sf)), 4)


@query("cluster_imbalance", """SELECT label AS cluster, count(*) AS size, round(max(count(*)) OVER () / min(count(*)) OVER (), 4) AS ratio,
max(count(*)) OVER () / min(count(*)) OVER () >= 2 AS imbalanced FROM embeddings GROUP BY 1""")
def cluster_imbalance(spark, sf):
    return E.cluster_imbalance(vectors(spark, sf))


@query("anomaly_confusion", f"""SELECT count(*) FILTER (truth = 1 AND p > 0.5) AS tp, count(*) FILTER (truth = 0 AND p > 0.5) AS fp,
count(*) FILTER (truth = 1 AND p <= 0.5) AS fn, count(*) FILTER (truth = 0 AND p <= 0.5) AS tn FROM {SCORED}""")
def anomaly_confusion(spark, sf):
    s = scored(spark, sf).withColumn("flag", (F.col("p") > 0.5).cast("int"))
    return E.anomaly_confusion(s, "truth", "flag")


@query("score_summary", """SELECT count(s) AS count, count(*) FILTER (s > 0) AS flagged, round(avg(s), 5) AS mean, round(stddev_samp(s), 5) AS std,
round(min(s), 5) AS min, round(quantile_cont(s, 0.25), 5) AS p25, round(quantile_cont(s, 0.5), 5) AS median, round(quantile_cont(s, 0.75), 5) AS p75,
round(max(s), 5) AS max FROM (SELECT value - 50 AS s FROM events)""")
def score_summary(spark, sf):
    e = table(spark, sf, "events").select((F.col("value") - 50).alias("s"))
    return rounded(E.score_summary(e, "s"), 5)


@query("score_quantiles", """SELECT q, round(quantile_cont(value, [0.5, 0.9, 0.95, 0.99])[i], 5) AS value FROM events,
(VALUES (1, 0.5::DOUBLE), (2, 0.9), (3, 0.95), (4, 0.99)) v(i, q) GROUP BY i, q""")
def score_quantiles(spark, sf):
    return rounded(E.score_quantiles(table(spark, sf, "events"), "value"), 5)


# clusters ---------------------------------------------------------------------------------------

_F = ["l_quantity", "l_extendedprice", "l_discount"]
_AGG = ", ".join(f"round(avg({c}), 5) AS {c}_mean, round(stddev_pop({c}), 5) AS {c}_std" for c in _F)
PROFILES = f"SELECT l_linenumber AS cluster, count(*) AS size, {_AGG} FROM lineitem GROUP BY 1"


def lines(spark, sf):
    return table(spark, sf, "lineitem").withColumnRenamed("l_linenumber", "cluster")


@query("cluster_profiles", PROFILES)
def cluster_profiles(spark, sf):
    return rounded(K.cluster_profiles(lines(spark, sf), "cluster", _F), 5)


@query("centroid_table", "SELECT l_linenumber AS cluster, " + ", ".join(f"round(avg({c}), 5) AS {c}" for c in _F) + " FROM lineitem GROUP BY 1")
def centroid_table(spark, sf):
    return rounded(K.centroid_table(lines(spark, sf), "cluster", _F), 5)


def _long_sql(features) -> str:
    return "(" + " UNION ALL ".join(f"SELECT l_linenumber AS cluster, '{c}' AS feature, {c} AS x FROM lineitem" for c in features) + ")"


ANOVA = f"""(WITH g AS (SELECT feature, cluster, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM {_long_sql(_F)} GROUP BY 1, 2),
o AS (SELECT feature, avg(x) AS grand FROM {_long_sql(_F)} GROUP BY 1)
SELECT feature, (sum(n * (m - grand) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f_ratio FROM g JOIN o USING (feature) GROUP BY 1)"""


@query("anova_f", f"SELECT feature, round(f_ratio, 5) AS f_ratio FROM {ANOVA}")
def anova_f(spark, sf):
    return rounded(K.anova_f(lines(spark, sf), "cluster", _F), 5)


def personas_sql(features) -> str:
    return f"""(SELECT cluster, feature, m AS mean, m - o AS deviation, row_number() OVER (PARTITION BY cluster ORDER BY abs(m - o) DESC, feature)::INTEGER AS place FROM
(SELECT cluster, feature, avg(x) AS m FROM {_long_sql(features)} GROUP BY 1, 2) JOIN
(SELECT feature, avg(x) AS o FROM {_long_sql(features)} GROUP BY 1) USING (feature) QUALIFY place <= 3)"""


@query("top_personas", f"SELECT cluster, feature, round(mean, 5) AS mean, round(deviation, 5) AS deviation, place FROM {personas_sql([*_F, 'l_tax'])}")
def top_personas(spark, sf):
    return rounded(K.top_personas(lines(spark, sf), "cluster", [*_F, "l_tax"]), 5)


DEVIATIONS = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(avg({c}) FILTER (flag), 5) AS flagged_mean, round(avg({c}), 5) AS base_mean,
    round((avg({c}) FILTER (flag) - avg({c})) / stddev_pop({c}), 5) AS deviation FROM (SELECT *, p > 0.6 AS flag FROM {SCORED})""" for c in _F)


@query("top_deviations", DEVIATIONS)
def top_deviations(spark, sf):
    s = scored(spark, sf).withColumn("flag", (F.col("p") > 0.6).cast("int"))
    return rounded(K.top_deviations(s, "flag", _F), 5)


@query("explain_anomaly", DEVIATIONS)
def explain_anomaly(spark, sf):
    from tabloom.operators.explain import explain_anomaly as explain
    s = scored(spark, sf).withColumn("flag", (F.col("p") > 0.6).cast("int"))
    return rounded(explain(s, "flag", _F)["per_feature_deviation"], 5)


_CENTER = f"(SELECT cluster, d, avg(x) AS m, count(*) AS n FROM {VECTOR_CELLS} GROUP BY 1, 2)"
_DIST = f"""(SELECT vec_id, v.cluster, sum((x - m) ** 2) AS d2 FROM {VECTOR_CELLS} v JOIN {_CENTER} c ON v.cluster = c.cluster AND v.d = c.d GROUP BY 1, 2)"""


@query("metric_davies_bouldin", f"""WITH s AS (SELECT cluster, avg(sqrt(d2)) AS s FROM {_DIST} GROUP BY 1), c AS MATERIALIZED (SELECT * FROM {_CENTER}),
g AS (SELECT a.cluster AS i, b.cluster AS j, sqrt(sum((a.m - b.m) ** 2)) AS gap FROM c a JOIN c b ON a.d = b.d AND a.cluster <> b.cluster GROUP BY 1, 2)
SELECT round(avg(r), 5) AS davies_bouldin FROM (SELECT i, max((x.s + y.s) / gap) AS r FROM g JOIN s x ON x.cluster = i JOIN s y ON y.cluster = j GROUP BY 1)""")
def metric_davies_bouldin(spark, sf):
    return rounded(M.davies_bouldin(vectors(spark, sf)), 5)


@query("metric_calinski", f"""WITH w AS (SELECT sum(d2) AS w, count(*) AS n, count(DISTINCT cluster) AS k FROM {_DIST}),
t AS (SELECT sum(v) AS t FROM (SELECT var_pop(x) * count(*) AS v FROM {VECTOR_CELLS} GROUP BY d))
SELECT round(((t - w) / (k - 1)) / (w / (n - k)), 5) AS calinski_harabasz FROM w, t""")
def metric_calinski(spark, sf):
    return rounded(M.calinski_harabasz(vectors(spark, sf)), 5)


PAIRS = f"""(SELECT a.vec_id AS i, a.cluster AS ci, b.vec_id AS j, b.cluster AS cj, list_distance(a.vector, b.vector) AS d
FROM {VECTORS} a JOIN {VECTORS} b ON a.vec_id <> b.vec_id)"""
SILHOUETTE = f"""(WITH m AS (SELECT i, ci, cj, avg(d) AS d FROM {PAIRS} GROUP BY 1, 2, 3),
r AS (SELECT i AS vec_id, ci AS cluster, max(d) FILTER (ci = cj) AS a, min(d) FILTER (ci <> cj) AS b FROM m GROUP BY 1, 2)
SELECT vec_id, cluster, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM r)"""


@query("silhouette_rows", f"SELECT vec_id, cluster, round(silhouette, 6) AS silhouette FROM {SILHOUETTE}")
def silhouette_rows(spark, sf):
    return rounded(M.silhouette_rows(vectors(spark, sf), "vec_id"))


@query("metric_silhouette", f"SELECT round(avg(silhouette), 6) AS silhouette, count(*) FILTER (silhouette < 0) AS negative FROM {SILHOUETTE}")
def metric_silhouette(spark, sf):
    s = M.silhouette_rows(vectors(spark, sf), "vec_id")
    return rounded(s.agg(F.avg("silhouette").alias("silhouette"), F.count_if(F.col("silhouette") < 0).alias("negative")))


@query("metric_silhouette_squared", f"""WITH m AS (SELECT i, ci, cj, avg(d * d) AS d FROM {PAIRS} GROUP BY 1, 2, 3),
r AS (SELECT i, max(d) FILTER (ci = cj) AS a, min(d) FILTER (ci <> cj) AS b FROM m GROUP BY 1)
SELECT round(avg((b - a) / greatest(a, b)), 5) AS silhouette FROM r""")
def metric_silhouette_squared(spark, sf):
    value = M.silhouette_squared(vectors(spark, sf))
    return rounded(spark.createDataFrame([(value,)], "silhouette double"), 5)


@query("low_silhouette", f"SELECT vec_id, round(s, 6) AS silhouette FROM (SELECT vec_id, silhouette AS s FROM {SILHOUETTE}) ORDER BY s, vec_id LIMIT 10")
def low_silhouette(spark, sf):
    s = M.silhouette_rows(vectors(spark, sf), "vec_id")
    return rounded(E.worst_n(s, "silhouette", "vec_id", largest=False).select("vec_id", "silhouette"))


_HALVES = f"(SELECT vec_id, vector, [list_avg(vector[1:32]), list_avg(vector[33:64])] AS low FROM {VECTORS})"


@query("metric_trustworthiness", f"""WITH v AS MATERIALIZED (SELECT * FROM {_HALVES}),
p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.vector, b.vector) AS dh, list_distance(a.low, b.low) AS dl FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT row_number() OVER (PARTITION BY i ORDER BY dh, j) AS rh, row_number() OVER (PARTITION BY i ORDER BY dl, j) AS rl FROM p)
SELECT round(1 - sum(greatest(rh - 5, 0)) * 2.0 / (n * 5 * (2 * n - 16)), 6) AS trustworthiness
FROM r, (SELECT count(*) AS n FROM v) WHERE rl <= 5 GROUP BY n""")
def metric_trustworthiness(spark, sf):
    half = lambda a: F.aggregate(F.slice("vector", a, 32), F.lit(0.0), lambda s, x: s + x) / 32
    v = vectors(spark, sf).select("vec_id", "vector", F.array(half(1), half(33)).alias("low"))
    return rounded(M.trustworthiness(v, "vec_id", "vector", "low"))


_PROBES = f"(SELECT * FROM {VECTORS} ORDER BY {unit_hash_sql('vec_id', seed=0)}, vec_id LIMIT (SELECT least(100, greatest(5, count(*) // 10)) FROM embeddings))"
_U = "(CAST(CAST('0x' || substr(md5(concat_ws('|', i, d - 1, '0')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0)"


@query("join_nearest", f"""SELECT p.vec_id, round(min(list_distance(p.vector, v.vector)), 6) AS distance FROM {_PROBES} p JOIN {VECTORS} v ON p.vec_id <> v.vec_id GROUP BY 1""")
def join_nearest(spark, sf):
    from tabloom.operators.profile import hash_sample
    v = vectors(spark, sf)
    m = min(K.MAX_PROBES, max(5, v.count() // 10))
    picked = hash_sample(v.select("vec_id", "vector"), "vec_id", m).collect()
    ids = [r["vec_id"] for r in picked]
    near = K.nearest_to_probes(v, "vec_id", "vector", [r["vector"] for r in picked], ids)
    names = F.array(*[F.lit(i).cast("long") for i in ids])
    return rounded(near.select(F.element_at(names, F.col("probe") + 1).alias("vec_id"), "distance"))


@query("hopkins", f"""WITH m AS (SELECT least(100, greatest(5, count(*) // 10)) AS m FROM embeddings),
b AS (SELECT d, min(x) AS lo, max(x) AS hi FROM {VECTOR_CELLS} GROUP BY 1),
u AS (SELECT i, list(lo + {_U} * (hi - lo) ORDER BY d) AS vector FROM b, m, range(100) r(i) WHERE i < m GROUP BY 1),
du AS (SELECT i, min(list_distance(u.vector, v.vector)) AS d FROM u CROSS JOIN {VECTORS} v GROUP BY 1),
dp AS (SELECT p.vec_id, min(list_distance(p.vector, v.vector)) AS d FROM {_PROBES} p JOIN {VECTORS} v ON p.vec_id <> v.vec_id GROUP BY 1)
SELECT round((SELECT sum(d) FROM du) / ((SELECT sum(d) FROM du) + (SELECT sum(d) FROM dp)), 6) AS hopkins""")
def hopkins(spark, sf):
    return rounded(K.hopkins(vectors(spark, sf), "vec_id", "vector"))
