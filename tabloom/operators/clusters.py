"""Cluster profiles, personas, deviations and clusterability."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.hashing import SCALE
from tabloom.operators.profile import hash_sample, rows_of

TOP_FEATURES = 3
TOP_DEVIATIONS = 10
MAX_PROBES = 100


def cluster_profiles(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """size, <feature>_mean and <feature>_std (population) per cluster."""
    return df.groupBy(cluster).agg(F.count("*").alias("size"), *[
        f(F.col(f"`{c}`").cast("double")).alias(f"{c}_{name}")
        for c in features for name, f in (("mean", F.avg), ("std", F.stddev_pop))
    ])


def centroid_table(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    return df.groupBy(cluster).agg(*[F.avg(f"`{c}`").alias(c) for c in features])


def _long(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("x")) for c in features
    ]))
    return df.select(*keys, cells.alias("c")).select(*keys, "c.*")


def anova_f(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """Between/within F ratio per feature; NULL with one cluster, a cluster of one row, or no
    spread inside the clusters."""
    groups = _long(df, [cluster], features).groupBy("feature", cluster).agg(
        F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")
    )
    n = F.col("n")
    sums = groups.groupBy("feature").agg(
        F.sum(n).alias("rows"), F.count("*").alias("k"), F.min(n).alias("least"),
        F.sum(n * F.col("v")).alias("within"), F.sum(n * F.col("m")).alias("s"),
        F.sum(n * F.col("m") * F.col("m")).alias("ss"),
        F.collect_list(F.struct(n.cast("double").alias("n"), "m")).alias("groups"),
    )
    grand = F.col("s") / F.col("rows")
    between = F.aggregate(
        "groups", F.lit(0.0), lambda acc, g: acc + g["n"] * (g["m"] - grand) * (g["m"] - grand)
    )
    usable = (F.col("k") > 1) & (F.col("least") >= 2) & (F.col("within") > 0) & (F.col("rows") > F.col("k"))
    ratio = (between / F.nullif(F.col("k") - 1, F.lit(0))) / F.nullif(
        F.col("within") / F.nullif(F.col("rows") - F.col("k"), F.lit(0)), F.lit(0.0))
    return sums.select("feature", F.when(usable, ratio).alias("f_ratio"))


def top_personas(
    df: DataFrame, cluster: str, features: Sequence[str], *, top: int = TOP_FEATURES
) -> DataFrame:
    """The features whose cluster mean is farthest from the overall mean."""
    groups = _long(df, [cluster], features).groupBy(cluster, "feature").agg(
        F.count("x").alias("n"), F.sum("x").alias("s")
    )
    overall = groups.groupBy("feature").agg((F.sum("s") / F.sum("n")).alias("overall"))
    gaps = groups.join(overall, "feature").select(
        cluster, "feature", (F.col("s") / F.col("n")).alias("mean"),
        (F.col("s") / F.col("n") - F.col("overall")).alias("deviation"),
    )
    w = Window.partitionBy(cluster).orderBy(F.desc(F.abs("deviation")), "feature")
    return gaps.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def top_deviations(
    df: DataFrame, flag: str, features: Sequence[str], *, top: int = TOP_DEVIATIONS
) -> DataFrame:
    """Features by the z-deviation of the flagged rows from all rows; a zero spread counts as one."""
    flagged = F.col(flag) != 0
    stats = df.agg(*[
        a for i, c in enumerate(features) for a in (
            F.avg(F.when(flagged, F.col(f"`{c}`").cast("double"))).alias(f"f{i}"),
            F.avg(F.col(f"`{c}`").cast("double")).alias(f"b{i}"),
            F.stddev_pop(F.col(f"`{c}`").cast("double")).alias(f"s{i}"))
    ])
    rows = rows_of(stats, [
        F.struct(F.lit(c).alias("feature"), F.col(f"f{i}").alias("flagged_mean"),
                 F.col(f"b{i}").alias("base_mean"), F.col(f"s{i}").alias("s"))
        for i, c in enumerate(features)
    ])
    spread = F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    scored = rows.filter(F.col("flagged_mean").isNotNull()).withColumn(
        "deviation", (F.col("flagged_mean") - F.col("base_mean")) / spread
    ).drop("s")
    return scored.orderBy(F.desc(F.abs("deviation")), "feature").limit(top)


def nearest_to_probes(
    df: DataFrame, key: str, vector: str, probes: Sequence[tuple], probe_ids: Sequence
) -> DataFrame:
    """Smallest Euclidean distance from each probe (at most a few hundred vectors) to the rows
    of the table, a row with the probe's own key left out. Each batch of rows gives one
    number per probe."""
    points = np.asarray(probes, dtype=float)
    own = np.asarray(probe_ids, dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.full(len(points), np.inf)
        for pdf in batches:
            if not len(pdf):
                continue
            rows, ids = np.asarray(pdf[vector].tolist(), dtype=float), pdf[key].to_numpy()
            for i, p in enumerate(points):
                d = np.sqrt(((rows - p) ** 2).sum(axis=1))
                d = d[ids != own[i]] if own[i] is not None else d
                if len(d):
                    best[i] = min(best[i], d.min())
        yield pd.DataFrame({"probe": np.arange(len(points)), "distance": best})

    partial = df.select(key, vector).mapInPandas(run, "probe int, distance double")
    return partial.groupBy("probe").agg(F.min("distance").alias("distance"))


def _uniform(i: int, d: int, seed: int) -> float:
    import hashlib

    text = f"{i}|{d}|{seed}".encode()
    return int(hashlib.md5(text).hexdigest()[:12], 16) / SCALE


def hopkins(df: DataFrame, key: str, vector: str, *, seed: int = 0) -> DataFrame:
    """Hopkins statistic: about 0.5 for random data, above 0.7 for clusterable data. Probes
    are the rows with the smallest key hashes; they are not their own neighbours."""
    n = df.count()
    spark = df.sparkSession
    if n < 20:
        return spark.createDataFrame([(None,)], "hopkins double")
    m = min(MAX_PROBES, max(5, n // 10))
    picked = hash_sample(df.select(key, vector), key, m, seed=seed).collect()
    bounds = Summarizer.metrics("min", "max").summary(array_to_vector(vector))
    low, high = df.select(bounds.alias("s")).select("s.min", "s.max").first()
    low, high = low.toArray(), high.toArray()
    uniform = [
        [lo + _uniform(i, d, seed) * (hi - lo) for d, (lo, hi) in enumerate(zip(low, high))]
        for i in range(m)
    ]
    probes = uniform + [list(r[vector]) for r in picked]
    ids = [None] * m + [r[key] for r in picked]
    near = nearest_to_probes(df, key, vector, probes, ids)
    u = F.sum(F.when(F.col("probe") < m, F.col("distance")).otherwise(0.0))
    return near.agg((u / F.nullif(F.sum("distance"), F.lit(0.0))).alias("hopkins"))
