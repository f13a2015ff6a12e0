"""Folds even in rows, and target means that never see their own row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions.hashing import unit_hash
from tabloom.operators import features as P
from tabloom.operators import splits as S


def test_fill_edges():
    assert S._fill_edges([0, 0, 0, 0, 0], 100) == [20, 40, 60, 80]
    assert S._fill_edges([50, 10, 0], 40) == [0, 15]  # level 25 in the two others
    assert S._fill_edges([9, 1, 1], 0) == [0, 0]


def test_folds_are_even_in_rows_and_keep_groups_whole(spark):
    rng = np.random.default_rng(1)
    groups = [0] * 1500 + rng.integers(1, 3000, 8500).tolist()
    df = spark.createDataFrame([(i, None if g == 7 else g) for i, g in enumerate(groups)], "k int, g long").repartition(6)
    out = S.cv_group_even(df, "g").toPandas()
    sizes = out.fold.value_counts()
    assert len(out) == 10_000 and sizes.max() < 2020 and sizes.min() > 1980
    assert (out.fillna(-1).groupby("g").fold.nunique() == 1).all()
    assert S.cv_group_even(df.limit(0), "g").count() == 0


def test_one_group_larger_than_a_fold(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 500, F.lit("big")).otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"))
    sizes = sorted(r["count"] for r in S.cv_group_even(df, "g").groupBy("fold").count().collect())
    assert sizes[-1] == 500 and max(sizes[:-1]) - min(sizes[:-1]) <= 20


def test_target_encoding_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, None if c == 3 else f"c{c}", None if i % 50 == 0 else float(y)) for i, (c, y) in
            enumerate(zip(rng.integers(0, 6, 300), rng.normal(size=300)))]
    train = spark.createDataFrame(rows, "k int, c string, y double")
    fold = {r.k: r.f for r in train.select("k", F.floor(unit_hash("k", seed="target:0") * 5).alias("f")).collect()}
    fitted = P.fit_target_encoding(train, "c", "y", "k")
    for r in fitted.encode_train(train).collect():
        own = rows[r.k][1]
        prior = np.mean([y for k, _, y in rows if y is not None and fold[k] != fold[r.k]])
        seen = [y for k, c, y in rows if c == own and y is not None and fold[k] != fold[r.k]]
        assert float(r.c) == pytest.approx((sum(seen) + 10 * prior) / (len(seen) + 10))
    test = spark.createDataFrame([(1, "c1"), (2, "new"), (3, None)], "k int, c string")
    every = [y for *_, y in rows if y is not None]
    got = {r.k: float(r.c) for r in fitted.encode(test).collect()}
    assert got[2] == pytest.approx(np.mean(every))
    for k, c in ((1, "c1"), (3, None)):
        seen = [y for _, o, y in rows if o == c and y is not None]
        assert got[k] == pytest.approx((sum(seen) + 10 * np.mean(every)) / (len(seen) + 10))


def test_target_encoding_does_not_leak(spark):
    """With a category for every row the code of a train row cannot tell its target."""
    rng = np.random.default_rng(3)
    rows = [(i, f"row{i}", float(rng.integers(0, 2))) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, c string, y double")
    coded = P.fit_target_encoding(df, "c", "y", "k").encode_train(df).toPandas()
    by_code = coded.groupby("c").y.mean()
    assert len(by_code) <= 5 and by_code.between(0.3, 0.7).all()
