"""Scores of predictions, computed by aggregation over (truth, prediction, score) rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.prefix import prefix_sums, with_halo
from tabloom.functions.neighbours import BLOCK_ROWS, CHUNK, QUERY_ROWS, Rough, _rows, direct, distances, hits, nearest
from tabloom.functions.tiles import LEAST, matrix, packed, streamed, tiles
from tabloom.operators.profile import rows_of
from tabloom.session import cut

CLASS_LIMIT = 10_000
THRESHOLDS = tuple(i / 8 for i in range(9))
CALIBRATION_BINS = 10
TRUST_NEIGHBOURS = 5


def _ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b != 0, a / F.nullif(b, F.lit(0))).otherwise(F.lit(empty).cast("double"))


# classification ---------------------------------------------------------------------------


def binary_indicator(label: Column | str, positive) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return (c == F.lit(positive)).cast("int")


def positive_class(df: DataFrame, label: str):
    """The second of two classes in sorted order."""
    found = df.agg(F.min(label), F.max(label)).first()
    return found[1]


def outlier_label(c: Column | str) -> Column:
    """Any non-zero evaluation label counts as an outlier."""
    return ((F.col(c) if isinstance(c, str) else c) != 0).cast("int")


def apply_threshold(p: Column, threshold: float = 0.5) -> Column:
    return F.when(p >= threshold, 1).otherwise(0)


def confusion_counts(df: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("n")
    )


def label_union(df: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    pairs = confusion_counts(df, truth, prediction)
    return pairs.select(F.explode(F.array("truth", "prediction")).alias("label")).distinct()


def per_class(df: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """precision, recall, f1 and support of each label; 0 on a zero division."""
    counts = confusion_counts(df, truth, prediction)
    hit = F.col("truth") == F.col("prediction")
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("long").alias("tp"),
                 F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    )).alias("s")).select("s.*")
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    return sums.select(
        "label", "tp", "support", "predicted",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def classification_scores(
    df: DataFrame, truth: str = "truth", prediction: str = "prediction", *, positive=None
) -> DataFrame:
    """accuracy, f1 (of the positive class, or macro), macro_f1, mcc, balanced_accuracy."""
    table = per_class(df, truth, prediction)
    s = F.sum("support").cast("double")
    agree = F.sum("tp")
    cross = F.sum(F.col("support").cast("double") * F.col("predicted"))
    squares = lambda c: F.sum(F.col(c).cast("double") * F.col(c))
    below = F.sqrt((s * s - squares("predicted")) * (s * s - squares("support")))
    macro = F.avg("f1")
    chosen = macro if positive is None else F.max(F.when(F.col("label") == F.lit(positive), F.col("f1")))
    return table.agg(
        (agree / s).alias("accuracy"), chosen.alias("f1"), macro.alias("macro_f1"),
        _ratio(agree * s - cross, below).alias("mcc"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
    )


def score_steps(df: DataFrame, truth: str = "truth", score: str = "p") -> DataFrame:
    """One row per distinct score, best first: tp and fp counts when everything scored at
    least that much is predicted positive, and the counts before it."""
    steps = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum((F.col(truth) == 1).cast("long")).alias("pos"),
        F.sum((F.col(truth) != 1).cast("long")).alias("neg"),
    ).withColumn("down", -F.col("score"))
    sums = prefix_sums(
        steps, "down", {"tp_before": F.col("pos"), "fp_before": F.col("neg")},
        totals={"positives": F.col("pos"), "negatives": F.col("neg")},
    )
    return sums.withColumns({
        "tp": F.col("tp_before") + F.col("pos"), "fp": F.col("fp_before") + F.col("neg"),
    }).drop("down")


def ranking_scores(df: DataFrame, truth: str = "truth", score: str = "p") -> DataFrame:
    """ROC-AUC by rank sums (NULL with one class) and average precision as a step sum."""
    steps = score_steps(df, truth, score)
    behind = F.col("negatives") - F.col("fp")
    pairs = F.sum(F.col("pos") * (behind + F.col("neg") / 2))
    both = F.max("positives").cast("double") * F.max("negatives")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    gain = F.sum(F.col("pos") * precision)
    return steps.agg(
        _ratio(pairs, both, None).alias("roc_auc"),
        _ratio(gain, F.max("positives"), None).alias("pr_auc"),
    )


def roc_curve(df: DataFrame, truth: str = "truth", score: str = "p") -> DataFrame:
    return score_steps(df, truth, score).select(
        "score", _ratio(F.col("fp"), F.col("negatives"), None).alias("fpr"),
        _ratio(F.col("tp"), F.col("positives"), None).alias("tpr"),
    )


def pr_curve(df: DataFrame, truth: str = "truth", score: str = "p") -> DataFrame:
    return score_steps(df, truth, score).select(
        "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        _ratio(F.col("tp"), F.col("positives"), None).alias("recall"),
    )


def threshold_table(
    df: DataFrame, truth: str = "truth", score: str = "p", *, thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """precision, recall, f1 and accuracy at each threshold, from one aggregation."""
    y = F.col(truth) == 1
    stats = df.agg(F.count("*").alias("rows"), F.count_if(y).alias("positives"), *[
        a for i, t in enumerate(thresholds) for a in (
            F.count_if(y & (F.col(score) >= t)).alias(f"tp{i}"),
            F.count_if(~y & (F.col(score) >= t)).alias(f"fp{i}"))
    ])
    rows = rows_of(stats, [
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"),
                 F.col(f"fp{i}").alias("fp"), "positives", "rows")
        for i, t in enumerate(thresholds)
    ])
    wrong = F.col("fp") + F.col("positives") - F.col("tp")
    return rows.select(
        "threshold", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("positives")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives")).alias("f1"),
        (1 - wrong / F.col("rows")).alias("accuracy"),
    )


def threshold_metrics(df: DataFrame, threshold: float = 0.5, truth: str = "truth", score: str = "p") -> DataFrame:
    return threshold_table(df, truth, score, thresholds=[threshold])


def calibration(
    df: DataFrame, truth: str = "truth", score: str = "p", *, bins: int = CALIBRATION_BINS
) -> DataFrame:
    """Observed positive rate per probability bin; the last bin is closed, an empty bin is
    NULL with zero rows."""
    bucket = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    seen = df.groupBy(bucket.alias("bin")).agg(
        F.avg((F.col(truth) == 1).cast("double")).alias("observed"), F.count("*").alias("n")
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(seen, "bin", "left").select(
        "bin", ((F.col("bin") + 0.5) / bins).alias("center"), "observed",
        F.coalesce("n", F.lit(0)).alias("rows"),
    )


def validation_loss(df: DataFrame, truth: str, score: str, *, classification: bool) -> DataFrame:
    """Binary log loss of a probability, or mean squared error."""
    y = F.col(truth)
    if not classification:
        e = y.cast("double") - F.col(score)
        return df.agg(F.avg(e * e).alias("loss"))
    p = F.greatest(F.least(F.col(score), F.lit(1 - 1e-15)), F.lit(1e-15))
    return df.agg(F.avg(F.when(y == 1, -F.log(p)).otherwise(-F.log(1 - p))).alias("loss"))


# regression and forecasting -----------------------------------------------------------------


def regression_scores(df: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    y, e = F.col(truth).cast("double"), F.col(truth).cast("double") - F.col(prediction)
    spread = F.var_pop(y) * F.count(y)
    return df.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.sum(e * e) / F.nullif(spread, F.lit(0.0))).alias("r2"),
    )


def forecast_scores(
    placed: DataFrame, series: Sequence[str], *, truth: str = "truth",
    prediction: str = "prediction", period: int = 1,
) -> DataFrame:
    """MAE, RMSE, MAPE, sMAPE (rows with a truth near zero left out) and MASE, scaled by the
    seasonal difference of the held-out series. Needs `pos` inside each series."""
    rows, w, home = with_halo(placed, series, before=period)
    y, p = F.col(truth).cast("double"), F.col(prediction).cast("double")
    rows = rows.withColumn("__step", F.abs(y - F.lag(y, period).over(w))).filter(home)
    e, usable = F.abs(y - p), F.abs(y) > 1e-12
    sums = rows.groupBy(*series).agg(
        F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (100 * F.avg(F.when(usable, e / F.nullif(F.abs(y), F.lit(0.0))))).alias("mape"),
        (100 * F.avg(F.when(usable, 2 * e / F.nullif(F.abs(y) + F.abs(p), F.lit(0.0))))).alias("smape"),
        F.avg("__step").alias("__scale"),
    )
    mase = F.when(F.col("__scale") > 1e-12, F.col("mae") / F.nullif("__scale", F.lit(0.0)))
    return sums.withColumn("mase", mase).drop("__scale")


# clustering ---------------------------------------------------------------------------------


def square_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def centroids(df: DataFrame, cluster: str = "cluster", vector: str = "vector") -> DataFrame:
    """(cluster, size, center): the mean vector per cluster."""
    summary = Summarizer.metrics("count", "mean").summary(array_to_vector(vector))
    return df.groupBy(cluster).agg(summary.alias("s")).select(
        cluster, F.col("s.count").alias("size"), vector_to_array("s.mean").alias("center")
    )


def _with_center(df: DataFrame, cluster: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the distance to their centre. The centres (one vector per cluster) are
    counted before they are broadcast."""
    centers = centroids(df, cluster, vector)
    small = centers.count() <= CLASS_LIMIT
    side = centers.select(F.col(cluster), "center", "size")
    joined = df.join(F.broadcast(side) if small else side, cluster)
    return joined.withColumn("d2", square_distance(F.col(vector), F.col("center"))), centers


def davies_bouldin(df: DataFrame, cluster: str = "cluster", vector: str = "vector") -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / centre distance."""
    rows, centers = _with_center(df, cluster, vector)
    spread = rows.groupBy(cluster).agg(F.avg(F.sqrt("d2")).alias("s"))
    table = centers.join(spread, cluster).select(cluster, "center", "s").collect()
    if len(table) > CLASS_LIMIT:
        raise ValueError(f"more than {CLASS_LIMIT} clusters")
    c, s = np.array([r["center"] for r in table]), np.array([r["s"] for r in table])
    worst = []
    for i in range(len(c)):
        gap = np.sqrt(((c - c[i]) ** 2).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            worst.append(np.nanmax(np.where(gap > 0, (s + s[i]) / gap, -np.inf)))
    return df.sparkSession.createDataFrame([(float(np.mean(worst)),)], "davies_bouldin double")


def calinski_harabasz(df: DataFrame, cluster: str = "cluster", vector: str = "vector") -> DataFrame:
    rows, _ = _with_center(df, cluster, vector)
    within, n = rows.agg(F.sum("d2"), F.count("*")).first()
    variance = df.select(Summarizer.variance(array_to_vector(vector)).alias("v")).first()["v"]
    total = float(variance.toArray().sum()) * (n - 1)
    k = df.select(cluster).distinct().count()
    value = ((total - within) / (k - 1)) / (within / (n - k)) if k > 1 and n > k and within else None
    return df.sparkSession.createDataFrame([(value,)], "calinski_harabasz double")


def silhouette_squared(df: DataFrame, cluster: str = "cluster", vector: str = "vector") -> float:
    """Mean silhouette for squared Euclidean distance: linear in the rows."""
    prepared = df.select(F.col(cluster).alias("prediction"), array_to_vector(vector).alias("features"))
    return ClusteringEvaluator().evaluate(prepared)


def silhouette_rows(
    df: DataFrame, key: str, cluster: str = "cluster", vector: str = "vector"
) -> DataFrame:
    """Euclidean silhouette of every row. Blocks exchange sums per cluster, not pairs; the
    work is still quadratic in the rows, use `silhouette_squared` for large tables."""
    kind, label = (df.schema[c].dataType.simpleString() for c in (key, cluster))

    def sums(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({key: [], "other": [], "total": [], "n": []})
        points, others = matrix(x[vector]), matrix(y[vector])
        codes, labels = pd.factorize(y[cluster])
        onehot = np.zeros((len(y), len(labels)))
        onehot[np.arange(len(y)), codes] = 1.0
        step = max(1, CHUNK // len(y))
        totals = np.concatenate([distances(points[at : at + step], others) @ onehot for at in range(0, len(x), step)])
        rows = np.repeat(np.arange(len(x)), len(labels))
        return pd.DataFrame({
            key: x[key].to_numpy()[rows], "other": np.tile(np.asarray(labels), len(x)),
            "total": totals.ravel(), "n": np.tile(onehot.sum(axis=0).astype(int), len(x)),
        })

    rows = df.select(key, cluster, vector)
    partial = tiles(rows, rows, key, sums, f"{key} {kind}, other {label}, total double, n long")
    full = partial.groupBy(key, "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("other") == F.col(cluster)
    per_row = full.join(df.select(key, cluster), key).groupBy(key, cluster).agg(
        F.max(F.when(own, F.col("n"))).alias("size"),
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
    )
    value = (F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0))
    return per_row.select(key, cluster, F.when(F.col("size") > 1, F.coalesce(value, F.lit(0.0)))
                          .otherwise(0.0).alias("silhouette"))


def trustworthiness(
    df: DataFrame, key: str, high: str, low: str, *, k: int = TRUST_NEIGHBOURS
) -> DataFrame:
    """How far the k neighbours in the embedding are from being neighbours in the original
    space. Ranks are counts of closer rows, over all rows: a block of rows stays in its task and reads the others
    block by block."""
    n = df.count()
    if not 0 < k < n / 2:
        raise ValueError("needs more than twice as many rows as neighbours")
    kind = df.schema[key].dataType.simpleString()
    near = nearest(df, df, key, low, k, skip_self=True).select(key, "neighbour")
    target = df.select(F.col(key).alias("neighbour"), F.col(high).alias("__y"))
    probes = near.join(target, "neighbour").groupBy(key).agg(
        F.collect_list(F.struct("neighbour", "__y")).alias("near")
    )
    left = df.select(F.col(key).alias("id"), F.col(high).cast("array<double>").alias("v"), key).join(probes, key).select(
        "id", "v", F.transform("near", lambda r: r["neighbour"]).alias("near"),
        F.flatten(F.transform("near", lambda r: r["__y"].cast("array<double>"))).alias("y"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch["near"].value_lengths().to_numpy()
            x = _rows(batch["v"])
            y = batch["y"].flatten().to_numpy(zero_copy_only=False).reshape(int(lengths.sum()), x.shape[1])
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            limit = direct(np.repeat(x, lengths, axis=0), y)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["v"], batch["near"], pa.ListArray.from_arrays(pa.array(ends), pa.array(limit))],
                ["id", "v", "near", "far"])

    rows = left.mapInArrow(measure, f"id {kind}, v array<double>, near array<{kind}>, far array<double>")
    blocks = lambda size: max(1, math.ceil(n / size), min(LEAST, n // 1024))
    part = lambda parts: F.pmod(F.xxhash64("id", "v"), F.lit(parts))
    few, many = blocks(QUERY_ROWS), blocks(BLOCK_ROWS)
    others = df.select(F.col(key).alias("id"), F.col(high).cast("array<double>").alias("v"))
    counted = streamed(packed(rows, part(few), few), cut(packed(others, part(many), many)), _closer,
                       f"id {kind}, neighbour {kind}, n long")
    ranks = counted.groupBy("id", "neighbour").agg((F.sum("n") + 1).alias("rank"))
    penalty = F.sum(F.greatest(F.col("rank") - k, F.lit(0)))
    return ranks.agg((1 - penalty * (2.0 / (n * k * (2 * n - 3 * k - 1)))).alias("trustworthiness"))


def _closer(x: pa.Table):
    """For the neighbours of a block of rows, the number of rows nearer than each."""
    x = x.combine_chunks()
    column = lambda name: x[name].chunk(0)
    a, keys, sizes = _rows(column("v")), column("id").to_numpy(zero_copy_only=False), column("near").value_lengths().to_numpy()
    near, limit = column("near").flatten(), column("far").flatten().to_numpy()
    ids, counts = near.to_numpy(zero_copy_only=False), np.zeros(len(near), np.int64)
    ends, rows = np.concatenate([[0], np.cumsum(sizes)]), np.repeat(np.arange(len(a)), sizes)
    single = lambda v, to: np.nextafter(v.astype(np.float32), np.float32(to))[:, None]

    def meet(_: int, opened) -> None:
        y = opened().combine_chunks()
        b, others = _rows(y["v"].chunk(0)), y["id"].chunk(0).to_numpy(zero_copy_only=False)
        rough = Rough(b)
        same = pd.DataFrame({"key": keys, "i": np.arange(len(a))}).merge(
            pd.DataFrame({"key": others, "j": np.arange(len(b))}), on="key").sort_values("i")
        step = max(1, CHUNK // len(b))
        for at in range(0, len(a), step):
            d2, off = rough(a[at : at + step])
            first, last = np.searchsorted(same["i"], [at, at + step])
            d2[same["i"].to_numpy()[first:last] - at, same["j"].to_numpy()[first:last]] = np.inf  # the row itself
            for place in range(int(sizes[at : at + step].max())):
                some = np.flatnonzero(sizes[at : at + step] > place)
                row = ends[at + some] + place
                part = d2[some] if len(some) < len(d2) else d2
                sure = part < single(limit[row] ** 2 - off[some], -np.inf)
                counts[row] += np.count_nonzero(sure, axis=1)
                # rows about as far as the neighbour are measured; the neighbour does not count
                i, j = hits((part <= single(limit[row] ** 2 + off[some], np.inf)) ^ sure)
                for s in range(0, len(i), CHUNK // 50):
                    p, q = i[s : s + CHUNK // 50], j[s : s + CHUNK // 50]
                    gap, to = direct(a[at + some[p]], b[q]), row[p]
                    before = (gap < limit[to]) | ((gap == limit[to]) & (others[q] < ids[to]))
                    np.add.at(counts, to, before & (others[q] != ids[to]))

    return meet, lambda: pa.table({"id": column("id").take(pa.array(rows)), "neighbour": near, "n": counts})


def ari_nmi(df: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean)."""
    counts = confusion_counts(df, truth, prediction)
    pairs = lambda n: n.cast("double") * (n - 1) / 2
    n = F.col("n").cast("double")
    cells = counts.agg(F.sum(n).alias("total"), F.sum(pairs(F.col("n"))).alias("both")).first()
    total, both = cells
    sides = {}
    for c in ("truth", "prediction"):
        side = counts.groupBy(c).agg(F.sum("n").alias("n"))
        share = F.col("n") / F.lit(total)
        sides[c] = side.agg(F.sum(pairs(F.col("n"))), -F.sum(share * F.log(share)), F.count("*")).first()
    w = lambda c: F.sum("n").over(Window.partitionBy(c))
    joint = counts.select("n", w("truth").alias("r"), w("prediction").alias("c"))
    mutual = joint.agg(F.sum(
        F.col("n") / F.lit(total) * F.log(F.lit(total) * F.col("n") / (F.col("r").cast("double") * F.col("c")))
    )).first()[0]
    (a, ha, ka), (b, hb, kb) = sides["truth"], sides["prediction"]
    expected = a * b / (total * (total - 1) / 2)
    top = (a + b) / 2
    ari = 1.0 if top == expected else (both - expected) / (top - expected)
    nmi = 1.0 if ka == kb == 1 else (0.0 if ha + hb == 0 else mutual / ((ha + hb) / 2))
    return df.sparkSession.createDataFrame([(float(ari), float(nmi))], "adjusted_rand double, nmi double")


def anomaly_mean(df: DataFrame, score: str = "score") -> DataFrame:
    return df.agg(F.avg(score).alias("score_distribution"))
