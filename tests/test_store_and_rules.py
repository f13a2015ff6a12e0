"""Stored models of every kind, level-wise itemsets and rule matching against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import association as R
from tabloom.operators import training as N
from tabloom.operators.models import MODELS

SMALL = {
    "random_forest": {"n_estimators": 3, "max_depth": 3}, "decision_tree": {"max_depth": 3},
    "hist_gradient_boosting": {"max_iter": 2, "max_depth": 2}, "mlp": {"hidden": (3,), "epochs": 5},
    "kmeans": {"n_clusters": 2, "n_init": 1}, "isolation_forest": {"n_estimators": 5}, "lof": {"n_neighbors": 4},
    "lag_boosting": {"lags": 2, "max_iter": 2}, "seasonal_naive": {"period": 3}, "pca": {"n_components": 1},
    "apriori": {"min_support": 0.2, "min_confidence": 0.2, "min_lift": 0.1},
}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(i, float(rng.normal()), float(i % 7), "abc"[i % 3], i % 2, float(i % 5 + rng.normal()), f"2024-01-{1 + i % 28:02d}", i)
            for i in range(60)]
    return spark.createDataFrame(data, "k long, x double, z double, s string, y int, v double, t string, at int").cache()


def task_for(name):
    kind = MODELS[name].tasks[0]
    if kind == "forecasting":
        return N.Task(kind, key="k", target="v", time_column="at", features=())
    if kind == "association":
        return N.Task(kind, key="k", features=("s", "t"))
    if kind == "regression":
        return N.Task(kind, key="k", target="v", features=("x", "z", "s"))
    if kind in ("binary", "multiclass"):
        return N.Task(kind, key="k", target="y", features=("x", "z", "s"))
    return N.Task(kind, key="k", features=("x", "z"))


@pytest.mark.parametrize("name", sorted(MODELS))
def test_every_model_is_the_same_after_loading(spark, rows, tmp_path, name):
    task = task_for(name)
    fitted = N.fit_model(rows, task, name, SMALL.get(name))
    again = N.load_model(spark, N.save_model(fitted, str(tmp_path / "run")))
    assert type(again.model) is type(fitted.model) and again.task == task
    ahead = rows.withColumn("at", F.col("at") + 30).withColumn("k", F.col("k") + 1000) if task.task_type == "forecasting" else rows
    for df in (rows, ahead):
        assert sorted(map(str, fitted.predict(df).collect())) == sorted(map(str, again.predict(df).collect()))
    with pytest.raises(Exception, match="exist"):
        N.save_model(fitted, str(tmp_path / "run"))


def test_association_is_a_training_task(spark):
    data = [(i, ["a", "b"] if i % 2 else ["a", "b", "c"], "d" if i % 3 else None) for i in range(40)]
    df = spark.createDataFrame(data, "k long, items array<string>, extra string")
    task = N.Task("association", key="k", features=("items", "extra"))
    run = N.train_model(df, task, "apriori", SMALL["apriori"])
    assert run.plan.primary == "lift" and {r.metric for r in run.leaderboard().collect()} == {"support", "confidence", "lift"}
    told = {r.k: r.prediction for r in run.trained.predict(df).collect()}
    assert set(told) == set(range(40)) and "c" in told[1] and "d" in told[0] and "a" not in told[1]


def test_tuning_keeps_time_and_groups_apart(spark, monkeypatch):
    seen = []
    fit, score = N.fit_model, N.score_rows
    monkeypatch.setattr(N, "fit_model", lambda df, *a, **k: (seen.append(df), fit(df, *a, **k))[1])
    monkeypatch.setattr(N, "score_rows", lambda t, df, plan: (seen.append(df), score(t, df, plan))[1])
    df = spark.createDataFrame([(i, i, f"g{i % 6}", float(i % 4)) for i in range(80)], "k int, t int, g string, y double")
    series = N.Task("forecasting", key="k", target="y", time_column="t", features=())
    N.tune(df, series, "seasonal_naive", trials=2)
    for part, held in zip(seen[::2], seen[1::2]):
        assert part.agg(F.max("t")).first()[0] < held.agg(F.min("t")).first()[0] == 60
    seen.clear()
    N.tune(df, N.Task("regression", key="k", target="y", group="g", features=("t",)), "ridge", trials=2)
    for part, held in zip(seen[::2], seen[1::2]):
        assert not {r.g for r in part.collect()} & {r.g for r in held.collect()}


def brute_itemsets(baskets, support, longest):
    items = sorted({i for b in baskets for i in b})
    out = {}
    for k in range(1, longest + 1):
        for sets in itertools.combinations(items, k):
            share = sum(set(sets) <= b for b in baskets) / len(baskets)
            if share >= support:
                out[sets] = share
    return out


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_itemsets_against_brute_force(spark, longest):
    rng = random.Random(2)
    baskets = [{i for i in "abcdefgh" if rng.random() < 0.45} | {"z"} for _ in range(150)]
    df = spark.createDataFrame([(b, i) for b, items in enumerate(baskets) for i in items], "basket int, item string").repartition(5)
    got = {tuple(r["items"]): r.support for r in R.mine_itemsets(df, 0.15, max_len=longest).collect()}
    assert got == pytest.approx(brute_itemsets(baskets, 0.15, longest))
    assert R.mine_itemsets(df.limit(0), 0.1).count() == 0


@pytest.mark.parametrize("most", [100_000, 0])
def test_rules_meet_baskets_at_their_rarest_item(spark, monkeypatch, most):
    monkeypatch.setattr(R, "BROADCAST_RULES", most)
    monkeypatch.setattr(R, "HEAVY_BASKETS", 20)
    rng = random.Random(6)
    baskets = {b: {i for i in "abcdef" if rng.random() < 0.4} | {"a"} for b in range(120)}
    df = spark.createDataFrame([(b, i) for b, items in baskets.items() for i in items], "basket int, item string")
    rules = R.mine_rules(df, min_support=0.05, min_confidence=0.1, min_lift=0.1)
    known = rules.collect()
    got = {(r.basket, tuple(r.antecedent), tuple(r.consequent)) for r in R.matching_rules(df, rules).collect()}
    assert got == {(b, tuple(r.antecedent), tuple(r.consequent)) for b, items in baskets.items() for r in known if set(r.antecedent) <= items}
    best = {}
    for b, items in baskets.items():
        offers = {}
        for r in known:
            if set(r.antecedent) <= items:
                for i in set(r.consequent) - items:
                    offers[i] = max(offers.get(i, 0), round(r.lift * r.confidence, 6))
        best[b] = sorted(offers, key=lambda i: (-offers[i], i))[:3]
    told = {r.basket: r["items"].split(", ") for r in R.recommended_text(R.recommend(df, rules, top=3)).collect()}
    assert told == {b: items for b, items in best.items() if items}
