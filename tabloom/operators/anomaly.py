"""Isolation forest and local outlier factor; scores above zero are anomalies."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.hashing import unit_hash
from tabloom.functions.prefix import row_positions
from tabloom.functions.quantiles import exact_quantiles
from tabloom.functions.neighbours import nearest
from tabloom.operators.profile import hash_sample
from tabloom.operators.store import Parts, TableModel
from tabloom.session import cut, stored

SAMPLE_ROWS = 256
EULER = 0.5772156649015329


def _path_length(n) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        long = 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(rows: np.ndarray, depth_limit: int, columns: np.ndarray, rng) -> list[tuple]:
    """Nodes (feature, threshold, left, right, depth, rows); a leaf has feature -1."""
    nodes: list[list] = []

    def split(part: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth, len(part)])
        if depth >= depth_limit or len(part) <= 1:
            return at
        low, high = part[:, columns].min(axis=0), part[:, columns].max(axis=0)
        open_columns = np.where(high > low)[0]
        if not len(open_columns):
            return at
        pick = int(rng.choice(open_columns))
        cut_at = float(rng.uniform(low[pick], high[pick]))
        feature = int(columns[pick])
        below = part[:, feature] <= cut_at
        nodes[at][0], nodes[at][1] = feature, cut_at
        nodes[at][2] = split(part[below], depth + 1)
        nodes[at][3] = split(part[~below], depth + 1)
        return at

    split(rows, 0)
    return [tuple(n) for n in nodes]


_NODE = ["f", "t", "l", "r", "d", "n"]


@dataclass(frozen=True)
class IsolationForest(TableModel):
    """Trees as a table of nodes: tree, node, feature, threshold, left, right, depth, rows. A tree
    has fewer than 2 * SAMPLE_ROWS nodes, so the trees of a task are a few MB."""

    nodes: DataFrame
    sample: int
    offset: float = 0.0

    def parts(self, spark: SparkSession) -> Parts:
        return Parts({"nodes": self.nodes}, {}, {"sample": self.sample, "offset": self.offset})

    @classmethod
    def of(cls, parts: Parts) -> IsolationForest:
        return cls(parts.tables["nodes"], **parts.values)

    def trees(self) -> list[np.ndarray]:
        grown = self.nodes.toPandas().sort_values(["tree", "node"])
        return [g[_NODE].to_numpy(float) for _, g in grown.groupby("tree")]

    def raw(self, df: DataFrame, vector: str, out: str = "score") -> DataFrame:
        """Adds 2^(-mean depth / expected depth) minus the offset."""
        trees = df.sparkSession.sparkContext.broadcast(self.trees())
        expected, offset = float(_path_length(self.sample)), self.offset
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = np.asarray(pdf[vector].tolist(), dtype=float)
                depth = np.zeros(len(pdf))
                everyone = np.arange(len(pdf))
                for tree in trees.value if len(pdf) else []:
                    feature, left, right = (tree[:, i].astype(int) for i in (0, 2, 3))
                    at = np.zeros(len(pdf), dtype=int)
                    while True:
                        inner = feature[at] >= 0
                        if not inner.any():
                            break
                        f = np.where(inner, feature[at], 0)
                        step = np.where(x[everyone, f] <= tree[at, 1], left[at], right[at])
                        at = np.where(inner, step, at)
                    depth += tree[at, 4] + _path_length(tree[at, 5])
                mean = depth / max(1, len(trees.value))
                yield pdf.assign(**{out: np.power(2.0, -mean / expected) - offset if expected else 0.0})

        return df.mapInPandas(run, f"{fields}, `{out}` double")


def fit_isolation_forest(
    df: DataFrame, key: str, vector: str, *, trees: int = 200, contamination: float = 0.05,
    max_features: float = 1.0, seed: int = 0,
) -> IsolationForest:
    """Each tree grows on at most 256 rows of a hash sample (the algorithm's own sample
    size); all rows are scored, and their quantile sets the zero of the score."""
    width = df.select(F.max(F.size(vector))).first()[0]
    pool = cut(hash_sample(df.select(key, vector), key, trees * SAMPLE_ROWS, seed=seed))
    rows = pool.count()
    size = min(SAMPLE_ROWS, rows)
    placed = row_positions(pool.withColumn("__h", unit_hash(key, seed=seed)), "__h", out="pos")
    rng = np.random.default_rng(seed)
    strides = []
    for _ in range(trees):
        stride = int(rng.integers(1, max(2, rows)))
        while math.gcd(stride, rows) != 1:
            stride += 1
        strides.append((stride, int(rng.integers(0, rows))))
    spark = df.sparkSession
    walk = spark.createDataFrame([(t, a, b) for t, (a, b) in enumerate(strides)], "tree int, a long, b long")
    slots = walk.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).select(
        "tree", F.pmod(F.col("a") * F.col("s") + F.col("b"), F.lit(rows)).alias("pos")
    )
    depth_limit = math.ceil(math.log2(max(size, 2)))
    used = max(1, int(max_features * width))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        own = np.random.default_rng([seed, tree])
        ordered = pdf.sort_values("pos")
        columns = np.sort(own.choice(width, size=used, replace=False))
        nodes = _grow(np.asarray(ordered[vector].tolist(), dtype=float), depth_limit, columns, own)
        out = pd.DataFrame(nodes, columns=_NODE)
        return out.assign(tree=tree, node=range(len(out)))[["tree", "node", *_NODE]]

    nodes = cut(slots.join(placed.select("pos", vector), "pos").groupBy("tree").applyInPandas(
        grow, "tree int, node int, f int, t double, l int, r int, d int, n int"))
    bare = IsolationForest(nodes, size)
    scored = bare.raw(df.select(key, vector), vector)
    offset = exact_quantiles(scored, ["score"], [1 - contamination])["score"][0]
    return IsolationForest(nodes, size, offset)


@dataclass(frozen=True)
class LocalOutlierFactor(TableModel):
    """Train rows with their k-distance and local density, and the zero of the score."""

    train: DataFrame
    key: str
    vector: str
    k: int
    offset: float

    def parts(self, spark: SparkSession) -> Parts:
        return Parts({"train": self.train}, {}, {"key": self.key, "vector": self.vector, "k": self.k, "offset": self.offset})

    @classmethod
    def of(cls, parts: Parts) -> LocalOutlierFactor:
        return cls(parts.tables["train"], **parts.values)

    def raw(self, df: DataFrame, out: str = "score") -> DataFrame:
        near = nearest(df, self.train, self.key, self.vector, self.k, skip_self=False)
        factor = _factor(near, self.train, self.key)
        return df.join(factor.select(self.key, (F.col("lof") - self.offset).alias(out)), self.key)


def _mean(value: Column) -> Column:
    """A mean of neighbours that no order of rows changes."""
    values = F.array_sort(F.collect_list(value))
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)


def _density(near: DataFrame, distances: DataFrame, key: str) -> DataFrame:
    known = distances.select(F.col(key).alias("neighbour"), "k_distance")
    reach = _mean(F.greatest("distance", "k_distance"))
    return near.join(known, "neighbour").groupBy(key).agg((1.0 / (reach + 1e-10)).alias("density"))


def _factor(near: DataFrame, train: DataFrame, key: str) -> DataFrame:
    own = _density(near, train, key)
    around = train.select(F.col(key).alias("neighbour"), F.col("density").alias("other"))
    mean = near.join(around, "neighbour").groupBy(key).agg(_mean(F.col("other")).alias("other"))
    return mean.join(own, key).select(key, (F.col("other") / F.col("density")).alias("lof"))


def fit_lof(
    df: DataFrame, key: str, vector: str, *, k: int = 20, contamination: float = 0.05
) -> LocalOutlierFactor:
    """Exact neighbours, found in the cells that can hold them."""
    rows = df.select(key, vector)
    k = min(k, rows.count() - 1)
    near = stored(nearest(rows, rows, key, vector, k, skip_self=True))
    far = near.groupBy(key).agg(F.max("distance").alias("k_distance"))
    density = _density(near, far, key)
    train = cut(rows.join(far, key).join(density, key))
    factor = _factor(near, train, key)
    offset = exact_quantiles(factor, ["lof"], [1 - contamination])["lof"][0]
    return LocalOutlierFactor(train, key, vector, k, offset)
