import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import anomaly as A
from tabloom.operators import association as R
from tabloom.operators import explain as X
from tabloom.operators import features as P
from tabloom.operators import metrics as M
from tabloom.operators import predict as D
from tabloom.operators import splits as S
from tabloom.operators import timeseries as T
from tabloom.operators import training as N
from tabloom.operators.advice import suggest_task


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    n = 400
    x, noise = rng.normal(size=n), rng.normal(size=n)
    y = (x + 0.3 * rng.normal(size=n) > 0).astype(int)
    rows = [(i, float(a), float(b), "abc"[i % 3], int(c)) for i, (a, b, c) in enumerate(zip(x, noise, y))]
    return spark.createDataFrame(rows, "k long, x double, noise double, s string, y int").cache()


TASK = N.Task("binary", key="k", target="y")


def test_features_are_fitted_on_train_rows(planted):
    frame = S.split_random(planted, "k")
    train = frame.filter("split = 'train'")
    fitted = P.fit_features(train, ["x", "s"])
    want = train.agg(F.avg("x"), F.stddev_pop("x")).first()
    assert fitted.scaler["x"] == pytest.approx(tuple(want))
    assert frame.filter("split = 'test'").count() == 80


def test_splits_repeat_and_groups_stay_whole(planted):
    a, b = (S.split_grouped(planted, "s", test_size=0.3, seed=2).select("k", "split").collect() for _ in range(2))
    assert sorted(a) == sorted(b)
    grouped = S.split_grouped(planted, "s", test_size=0.3).groupBy("s").agg(F.countDistinct("split").alias("n"))
    assert all(r.n == 1 for r in grouped.collect())


def test_logistic_finds_the_signal_and_explains_it(spark, planted):
    fitted = N.fit_model(planted, TASK, "logistic_regression")
    scored = fitted.predict(planted).withColumn("truth", F.col("y"))
    assert scored.columns[:5] == planted.columns and scored.filter("x is null").count() == 0
    assert M.ranking_scores(scored, score="p_1").first().roc_auc > 0.95
    assert X.explain_linear(fitted, spark).first().feature == "x"
    drops = X.explain_permutation(fitted, planted, repeats=1).collect()
    assert drops[0].feature == "x" and drops[0].importance > 0.2


def test_partial_dependence_comes_with_the_curve_of_every_row(spark, planted, tmp_path):
    few = planted.filter("k < 30").select("k", "x", F.round("noise").alias("noise"), "y")
    task = N.Task("binary", key="k", target="y", features=("x", "noise"))
    fitted = N.fit_model(few, task, "decision_tree", {"max_depth": 3})
    told = X.explain_pdp_ice(fitted, few, features=["noise"])
    average = {r.grid: r.average for r in told["average"].collect()}
    curves = {(r.k, r.grid): r.response for r in told["ice"].collect()}
    assert set(curves) == {(k, g) for k in range(30) for g in average}
    for g, mean in average.items():
        own = {r.k: r.p_1 for r in fitted.predict(few.withColumn("noise", F.lit(g))).collect()}
        assert {k: curves[k, g] for k in range(30)} == own and mean == pytest.approx(sum(own.values()) / 30)
    some = X.explain_pdp_ice(fitted, few, features=["noise"], curves_of=few.filter("k < 2"))["ice"]
    assert {r.k for r in some.collect()} == {0, 1}

    import __spark_entry__ as entry
    lines = [(i, 1, 1, 1, float(i % 3), 10.0 * (i % 3) + 5, 0.1, 0.0, "R") for i in range(9)]
    spark.createDataFrame(lines, """l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,
        l_extendedprice double, l_discount double, l_tax double, l_returnflag string""").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = entry.queries()["explain_pdp_ice"](spark, str(tmp_path)).collect()
    assert sorted((r.grid, r.average) for r in rows if r.row_key is None) == [(0.0, 5.0), (1.0, 15.0), (2.0, 25.0)]
    assert sorted((r.row_key, r.grid, r.response) for r in rows if r.row_key is not None) == [
        (f"{i}-1-1-1", float(g), 10.0 * g + 5) for i in range(9) for g in range(3)]


def test_integrated_gradients_are_complete(planted):
    task = N.Task("binary", key="k", target="y", features=("x", "noise"))
    fitted = N.fit_model(planted, task, "mlp", {"hidden": (5,), "epochs": 60})
    net = X._network(fitted)
    rows = fitted.vectors(planted).select("k", "features").collect()
    x = np.array([r.features.toArray() for r in rows])

    def probabilities(x):
        for w, b in net[:-1]:
            x = 1 / (1 + np.exp(-(x @ w.T + b)))
        z = np.exp(x @ net[-1][0].T + net[-1][1])
        return z / z.sum(axis=1, keepdims=True)

    p = probabilities(x)
    model = {r.k: r.p_1 for r in fitted.predict(planted).select("k", "p_1").collect()}
    assert np.allclose(p[:, 1], [model[r.k] for r in rows])
    zero = probabilities(np.zeros((1, 2)))[0]
    target = p.argmax(axis=1)
    want = p[np.arange(len(p)), target] - zero[target]
    got = X.integrated_gradients(fitted, planted, steps=400).toPandas().set_index("k").loc[[r.k for r in rows]]
    assert np.allclose(got.sum(axis=1), want, atol=2e-3)


def test_model_is_saved_and_loaded(spark, planted, tmp_path):
    fitted = N.fit_model(planted, TASK, "decision_tree", {"max_depth": 3})
    again = N.load_model(spark, N.save_model(fitted, str(tmp_path / "m")))
    cols = ["k", "prediction", "p_1"]
    assert fitted.predict(planted).select(cols).exceptAll(again.predict(planted).select(cols)).count() == 0


@pytest.fixture(scope="module")
def outliers(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(180, 2)), rng.normal(size=(20, 2)) * 0.5 + 8])
    rows = [(i, v.tolist(), int(i >= 180)) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "k long, v array<double>, label int").cache()


def test_isolation_forest_ranks_outliers(outliers):
    _, df = outliers
    forest = A.fit_isolation_forest(df, "k", "v", trees=60, contamination=0.1)
    scored = forest.raw(df, "v").withColumnRenamed("label", "truth")
    assert M.ranking_scores(scored, score="score").first().roc_auc > 0.97
    assert 15 <= scored.filter("score > 0").count() <= 20


def test_lof_matches_brute_force(outliers):
    x, df = outliers
    lof = A.fit_lof(df, "k", "v", k=12, contamination=0.1)
    got = lof.raw(df).toPandas().set_index("k").sort_index().score.to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    own = d + np.diag([np.inf] * len(x))
    near = np.argsort(own, axis=1, kind="stable")[:, :12]
    kd = np.sort(own, axis=1)[:, 11]
    density = 1 / (np.maximum(np.take_along_axis(own, near, 1), kd[near]).mean(1) + 1e-10)
    train = density[near].mean(1) / density
    with_self = np.argsort(d, axis=1, kind="stable")[:, :12]
    new = 1 / (np.maximum(np.take_along_axis(d, with_self, 1), kd[with_self]).mean(1) + 1e-10)
    want = density[with_self].mean(1) / new - np.quantile(train, 0.9)
    assert np.allclose(got, want)


def test_power_transform_finds_the_power_and_inverts(spark):
    rng = np.random.default_rng(0)
    y = np.exp(rng.normal(size=2000) * 0.4 + 1)
    df = spark.createDataFrame([(float(v),) for v in y], "y double")
    t = P.fit_target_transform(df, "y", "boxcox")
    assert abs(t.power) < 0.1
    for name in ("boxcox", "yeojohnson"):
        t = P.fit_target_transform(df, "y", name)
        back = df.select("y", t.invert(t.apply(F.col("y"))).alias("b")).toPandas()
        assert np.allclose(back.y, back.b)


def test_forecast_scores(spark):
    rows = [("s", i, float(a), float(b)) for i, (a, b) in enumerate(zip([1, 2, 3, 4], [1, 2, 4, 3]))]
    df = spark.createDataFrame(rows, "s string, pos long, truth double, prediction double")
    r = M.forecast_scores(df, ["s"]).first()
    assert (r.mae, r.mase) == (0.5, 0.5) and r.rmse == pytest.approx(0.5 ** 0.5)


def test_interval_and_bands(spark):
    df = spark.createDataFrame([(10.0,)], "p double")
    r = D.prediction_interval(df, "p", 2.0).first()
    assert r.upper - r.lower == pytest.approx(2 * 1.959964 * 2.0, rel=1e-5)
    residuals = spark.createDataFrame([(-1.0,), (-0.5,), (0.5,), (1.0,)], "r double")
    r = D.confidence_bands(df, residuals, "p", "r", alpha=0.5).first()
    assert r.upper - r.lower == pytest.approx(1.25)


def test_backtest_cuts(spark):
    got = S.backtest_cuts(spark.createDataFrame([(40,), (3,)], "n long")).orderBy("fold").collect()
    assert [(r.n, r.train_end, r.test_end) for r in got] == [(40, 16, 24), (40, 24, 32), (40, 32, 40)]


def test_lag_forecast_continues_a_line(spark):
    rows = [("s", i, float(i % 4)) for i in range(80)]
    placed = T.series_frame(spark.createDataFrame(rows, "s string, t long, y double"), ["s"], "t", "y")
    model = D.fit_lag_boosting(placed, ["s"], lags=4, max_iter=20)
    got = [r.forecast for r in model.forecast(placed, 8).orderBy("step").collect()]
    assert np.allclose(got, [0, 1, 2, 3] * 2, atol=0.2)


def test_rules_and_recommendations(spark):
    baskets = [("a", "b", "c")] * 4 + [("a", "b")] * 3 + [("c", "d")] * 3
    long = spark.createDataFrame([(i, x) for i, b in enumerate(baskets) for x in b], "basket long, item string")
    found = {tuple(r["items"]): r.support for r in R.mine_itemsets(long, 0.3).collect()}
    assert found[("a", "b", "c")] == 0.4 and found[("c", "d")] == 0.3 and ("a", "d") not in found
    rules = R.mine_rules(long, min_support=0.3, min_confidence=0.5)
    row = rules.filter(F.array_join("antecedent", ",") == "d").first()
    assert (row.consequent, row.confidence, row.lift) == (["c"], 1.0, pytest.approx(1 / 0.7, abs=1e-6))
    new = spark.createDataFrame([(1, "a"), (2, "d")], "basket long, item string")
    offers = {(r.basket, r.item) for r in R.recommend(new, rules).collect()}
    assert (1, "b") in offers and (2, "c") in offers and (1, "a") not in offers
    assert tuple(R.rule_stats(rules.filter("lift > 99")).first()) == (0.0, 0.0, 0.0)


def test_task_suggestion(spark):
    df = spark.createDataFrame([(1, 0.5, "u"), (1, 1.5, "v"), (1, 2.5, "w")], "a int, b double, c string")
    assert suggest_task(df, "b") == "regression" and suggest_task(df, "c") == "multiclass"
    with pytest.raises(ValueError):
        suggest_task(df, "a")


def test_forecasters_train_score_and_predict(spark):
    rows = [(i, i, float(10 * (i % 4) + i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, t int, y double")
    task = N.Task("forecasting", key="k", target="y", time_column="t", features=())
    for name, params in (("naive", {}), ("seasonal_naive", {"period": 4}), ("lag_boosting", {"lags": 4, "max_iter": 5})):
        run = N.train_model(df, task, name, params)
        board = {r.metric: r["mean"] for r in run.leaderboard().collect()}
        assert set(board) == {"mae", "rmse", "smape", "mase"} and all(v is not None for v in board.values())
        values = {r.metric: r.value for r in D.evaluate_test(run.trained, run.prepared).collect()}
        assert values["mae"] >= 0
    early = df.filter("t < 50")
    fitted = N.fit_model(early, task, "seasonal_naive", {"period": 4})
    got = {r.k: r.prediction for r in fitted.predict(df).collect()}
    assert [got[k] for k in range(50, 60)] == [rows[46 + (k - 50) % 4][2] for k in range(50, 60)]
    assert got[3] is None and got[10] == rows[6][2]
