"""Quantiles, running totals, ranks and frames against pandas, with one value in a third of
all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions.prefix import prefix_sums, row_positions, value_ranks, with_halo
from tabloom.functions.quantiles import exact_quantiles, grouped_quantiles, kth_smallest
from tabloom.functions.scalar import chi2_quantile, norm_ppf
from tabloom.operators.profile import hash_sample


@pytest.fixture(scope="module")
def hot():
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=3000) * 50, 1)
    v[rng.random(3000) < 0.35] = 7.5
    return pd.DataFrame({
        "id": np.arange(3000), "v": v, "w": rng.integers(1, 9, 3000),
        "g": np.where(rng.random(3000) < 0.6, "a", "b"),
    })


PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("bound", [10, 100, 10_000])
def test_quantiles_narrow_exactly(spark, hot, bound):
    got = exact_quantiles(spark.createDataFrame(hot), ["v", "w"], PROBS, exact_rows=bound)
    for c in ("v", "w"):
        assert np.allclose(got[c], np.quantile(hot[c], PROBS))


def test_quantiles_ignore_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert exact_quantiles(df, ["v"], [0.5])["v"] == [2.0]
    assert exact_quantiles(df.filter("v > 9 and not isnan(v)"), ["v"], [0.5])["v"] == [None]


def test_kth_smallest(spark, hot):
    got = kth_smallest(spark.createDataFrame(hot), "v", [0, 1500, 2999])
    assert got == [np.sort(hot.v)[k] for k in (0, 1500, 2999)]


def test_grouped_quantiles(spark, hot):
    got = grouped_quantiles(spark.createDataFrame(hot), ["g"], "v", [0.1, 0.9], ["lo", "hi"]).toPandas()
    want = hot.groupby("g").v.quantile([0.1, 0.9]).unstack()
    got = got.set_index("g").sort_index()
    assert np.allclose(got[["lo", "hi"]], want.to_numpy())


def test_positions_with_a_frequent_value(spark, hot):
    got = row_positions(spark.createDataFrame(hot), "v", tie="id", total="n").toPandas()
    want = hot.sort_values(["v", "id"]).reset_index(drop=True)
    got = got.sort_values("pos")
    assert (got.pos.to_numpy() == np.arange(3000)).all() and (got.n == 3000).all()
    assert (got.id.to_numpy() == want.id.to_numpy()).all()


def test_running_totals_per_group(spark, hot):
    got = prefix_sums(
        spark.createDataFrame(hot), "v", {"before": F.col("w")}, by=["g"], tie="id",
        totals={"total": F.col("w")},
    ).toPandas().set_index("id").sort_index()
    ordered = hot.sort_values(["g", "v", "id"])
    ordered["before"] = ordered.groupby("g").w.cumsum() - ordered.w
    assert (got.before == ordered.set_index("id").before.sort_index()).all()
    assert (got.total == hot.set_index("id").groupby("g").w.transform("sum")).all()


def test_string_order(spark):
    names = [f"Customer#{i:06d}" for i in range(500)] + ["Customer#", "Ä", "zz"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = row_positions(df, "name").toPandas().sort_values("pos").name.tolist()
    assert got == sorted(names, key=lambda s: s.encode())


@pytest.mark.parametrize("parts", [4, 300])
def test_one_string_in_a_third_of_the_rows_is_split(spark, parts):
    from tabloom.functions import prefix

    rng = np.random.default_rng(8)
    urls = [f"https://example.org/{'a' * (i % 5)}/{'page' * (i % 3)}{i % 700}" for i in range(1500)]
    urls += ["https://example.org/home"] * 800 + [None] * 20 + ["Ä", "", "x" * 400] * 3
    rng.shuffle(urls)
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, url string")
    tagged = prefix._ranges(df, "url", "id", False, parts)
    sizes = tagged.groupBy("__code", "__sub").count().collect()
    assert max(r["count"] for r in sizes) < 800 / min(parts, 64) + 2400 / parts * 3
    got = prefix_sums(df, "url", {"pos": F.lit(1).cast("long")}, tie="id", parts=parts).toPandas().sort_values("pos")
    want = sorted(range(len(urls)), key=lambda i: (urls[i] is not None, (urls[i] or "").encode(), i))
    assert got.id.tolist() == want and got.pos.tolist() == list(range(len(urls)))


def test_strings_break_ties_of_numbers(spark):
    df = spark.createDataFrame([(i % 2, f"k{(i * 37) % 500:03d}") for i in range(500)], "v int, k string")
    got = row_positions(df, "v", tie="k").toPandas().sort_values("pos")
    assert list(zip(got.v, got.k)) == sorted(zip(got.v, got.k))


def test_ranks_with_a_frequent_value(spark, hot):
    got = value_ranks(spark.createDataFrame(hot), {"v": ("lv", "ev"), "w": ("lw", "ew")})
    got = got.toPandas().set_index("id").sort_index()
    for c in "vw":
        rank = got[f"l{c}"] + (got[f"e{c}"] + 1) / 2
        assert (rank == hot.set_index("id")[c].rank()).all()


def test_frames_cross_block_borders(spark, hot):
    placed = spark.createDataFrame(hot.assign(pos=hot.groupby("g").cumcount()))
    rows, w, home = with_halo(placed, ["g"], before=3, after=2, block=1)
    got = rows.withColumn("s", F.sum("v").over(w.rowsBetween(-3, 2))).filter(home).toPandas()
    assert len(got) == 3000
    for _, part in got.groupby("g"):
        v = part.sort_values("pos")
        x = v.v.to_numpy()
        want = [x[max(0, i - 3) : i + 3].sum() for i in range(len(x))]
        assert np.allclose(v.s, want)


def test_hash_sample_is_the_smallest_hashes(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    from tabloom.functions.hashing import unit_hash

    want = [r.k for r in df.orderBy(unit_hash("k", seed=4)).limit(50).collect()]
    assert sorted(r.k for r in hash_sample(df, "k", 50, seed=4).collect()) == sorted(want)


def test_normal_and_chi_square(spark):
    from statistics import NormalDist

    p = [1e-9, 0.01, 0.3, 0.5, 0.97, 0.999999]
    got = [r.z for r in spark.createDataFrame([(x,) for x in p], "p double").select(norm_ppf(F.col("p")).alias("z")).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(x) for x in p], rtol=1e-7, atol=1e-8)
    assert chi2_quantile(0.999, 2) == pytest.approx(-2 * np.log(0.001))
    assert chi2_quantile(0.95, 1) == pytest.approx(3.841458820694124)


def _positions(df, order, tie, known=None):
    got = row_positions(df, order, tie=tie, out="__p", total="__n").toPandas()
    want = got.sort_values([known or order, tie], kind="stable").reset_index(drop=True)
    return (want["__p"] == range(len(want))).all()


def test_positions_of_large_integers_and_decimals(spark):
    base = 1 << 60
    df = spark.range(3000).select((F.lit(base) + (F.col("id") * 7919) % 1500).alias("v"), (3000 - F.col("id")).alias("id"))
    assert _positions(df, "v", "id")
    assert _positions(df.withColumn("v", (F.col("v") / 1000).cast("decimal(30,3)") + F.col("id").cast("decimal(20,0)")), "v", "id")


def test_positions_across_summer_time_and_below_a_second(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        start = 1730610000  # two hours before the clocks go back
        df = spark.range(4000).select(
            F.timestamp_micros(F.lit(start * 1_000_000) + (F.col("id") * 7919) % 4000 * 3_600_007).alias("t"), "id")
        assert _positions(df.withColumn("u", F.unix_micros("t")), "t", "id", "u")
        assert _positions(df.withColumn("t", F.col("t").cast("timestamp_ntz")), "t", "id")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_a_frequent_time_is_split(spark):
    from tabloom.functions.prefix import _ranges

    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit("2024-01-05 00:00:00")).otherwise(
            F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"), F.lit(" 01:00:00")))
        .cast("timestamp").alias("t"), "id")
    assert _positions(df, "t", "id")
    parts = _ranges(df, "t", "id", False, 16).groupBy("__code", "__sub").count()
    assert parts.agg(F.max("count")).first()[0] <= 1500


def test_ranks_take_more_tasks_as_rows_grow(spark, monkeypatch):
    from tabloom.functions import prefix

    monkeypatch.setattr(prefix, "RANK_ROWS", 40)
    rows = [(i, float(i * 37 % 997), float(i * i % 211)) for i in range(1500)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    ranked = prefix.value_ranks(df, {"a": ("la", "ea"), "b": ("lb", "eb")})
    for r in ranked.collect():
        assert r["la"] == sum(x[1] < r["a"] for x in rows) and r["ea"] == sum(x[1] == r["a"] for x in rows)
        assert r["lb"] == sum(x[2] < r["b"] for x in rows) and r["eb"] == sum(x[2] == r["b"] for x in rows)
    assert "REPARTITION_BY_NUM" in ranked._jdf.queryExecution().toString()


def test_wide_medians_and_moments_of_one_pass(spark, monkeypatch):
    import numpy as np

    import tabloom.functions.quantiles as quantiles
    from tabloom.operators.profile import moments

    monkeypatch.setattr(quantiles, "FEW", 20)
    x = np.random.default_rng(3).normal(0, 1, (500, 40))
    x[:, 1], x[:3, 2], x[5, 3], x[6, 4], x[7:300, 5] = 2.5, (np.inf, -np.inf, -0.0), np.nan, 1e-300, -7.0
    names = [f"c{j}" for j in range(40)]
    rows = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in x], ", ".join(f"{c} double" for c in names))
    got = quantiles.exact_quantiles(rows.repartition(5), names, [0.25, 0.5], exact_rows=20)
    with np.errstate(invalid="ignore"):
        want = np.nanquantile(x, [0.25, 0.5], axis=0)
    assert np.allclose([got[c] for c in names], want.T, rtol=1e-12)
    sql = rows.drop("c2").repartition(5)
    names.remove("c2")
    full = x[~np.isnan(x).any(1)][:, [j for j in range(40) if j != 2]]
    n, mean, cov = moments(sql, names)
    assert n == 499 and np.allclose(mean, full.mean(0)) and np.allclose(cov, np.cov(full.T))
