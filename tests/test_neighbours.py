"""The exact neighbour join against brute force: cells, blocks, copies, groups, and gaps."""

import numpy as np
import pytest

from tabloom.functions import neighbours as B
from tabloom.operators import cleaning as C
from tabloom.operators import metrics as M


def brute(points, queries, k, skip_self):
    out = {}
    for i, v in queries:
        near = sorted((float(np.sqrt(((np.asarray(v) - np.asarray(w)) ** 2).sum())), j) for j, w in points if not (skip_self and i == j))
        out[i] = [j for _, j in near[:k]]
    return out


def found(df):
    got = {}
    for r in df.orderBy("place").collect():
        got.setdefault(r["k"], []).append(r["neighbour"])
    return got


@pytest.mark.parametrize("skip_self", [True, False])
def test_cells_blocks_and_copies(spark, monkeypatch, skip_self):
    monkeypatch.setattr(B, "CELL_ROWS", 12)
    monkeypatch.setattr(B, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 3)) * 20
    x = [(centres[i % 6] + rng.normal(size=3)).round(2).tolist() for i in range(150)]
    x += [[1.0, 2.0, 3.0]] * 80  # a third of all rows
    rows = list(enumerate(x))
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(5)
    assert found(B.nearest(df, df, "k", "v", 4, skip_self=skip_self)) == brute(rows, rows, 4, skip_self)


def test_cells_leave_out_most_pairs(spark, monkeypatch):
    monkeypatch.setattr(B, "CELL_ROWS", 50)
    pairs = {}
    for n in (500, 2000):
        rng = np.random.default_rng(2)
        rows = [(i, rng.uniform(size=2).tolist()) for i in range(n)]
        df = spark.createDataFrame(rows, "k long, v array<double>")
        asked = []
        cut = B.cut
        monkeypatch.setattr(B, "cut", lambda d: (lambda out: (asked.append(out.count()) if "block" in out.columns else None, out)[1])(cut(d)))
        assert found(B.nearest(df, df, "k", "v", 3, skip_self=True)) == brute(rows, rows, 3, True)
        monkeypatch.setattr(B, "cut", cut)
        pairs[n] = sum(asked)
    assert pairs[2000] < 6 * pairs[500] and pairs[2000] < 2000 * 40 / 4


def test_groups_and_short_sides(spark):
    rows = [(i, i % 3, [float(i)] if i % 3 else [float(i), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, g int, v array<double>")
    got = {}
    for r in B.nearest(df, df.filter("k < 8"), "k", "v", 5, skip_self=True, by="g").collect():
        got.setdefault((r["k"], r["g"]), []).append((r["place"], r["neighbour"]))
    for i, g, v in rows:
        near = sorted((abs(v[0] - w[0]), j) for j, h, w in rows if h == g and j != i and j < 8)
        assert [j for _, j in sorted(got.get((i, g), []))] == [j for _, j in near[:5]]
    assert B.nearest(df, df.limit(0), "k", "v", 5, skip_self=False).count() == 0


def test_imputation_with_many_gap_patterns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 4))
    x[rng.uniform(size=x.shape) < 0.3] = np.nan
    x[5] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)],
                               "k int, a double, b double, c double, d double")
    got = {r.k: r[1:] for r in C.impute(df, ["a", "b", "c", "d"], "knn", key="k").collect()}
    for i, row in enumerate(x):
        for j in range(4):
            want = row[j]
            if np.isnan(want):
                near = []
                for o, other in enumerate(x):
                    both = ~np.isnan(row) & ~np.isnan(other)
                    if both.any() and not np.isnan(other[j]):
                        near.append((round(float(np.sqrt(((row - other)[both] ** 2).sum() * 4 / both.sum())), 9), o, other[j]))
                want = np.mean([v for *_, v in sorted(near)[:5]]) if near else np.nanmean(x[:, j])
            assert got[i][j] == pytest.approx(want)


def test_trustworthiness_with_ties(spark):
    rng = np.random.default_rng(7)
    high = rng.integers(0, 3, size=(40, 3)).astype(float)
    low = high[:, :1] + rng.normal(size=(40, 1))
    df = spark.createDataFrame([(i, h.tolist(), w.tolist()) for i, (h, w) in enumerate(zip(high, low))],
                               "k long, x array<double>, z array<double>")
    d = lambda m: np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
    a, b, k, n, lost = d(high), d(low), 5, 40, 0
    for i in range(n):
        rank = {j: r for r, (_, j) in enumerate(sorted((a[i, j], j) for j in range(n) if j != i), 1)}
        for _, j in sorted((b[i, j], j) for j in range(n) if j != i)[:k]:
            lost += max(0, rank[j] - k)
    got = M.trustworthiness(df, "k", "x", "z", k=k).first()[0]
    assert got == pytest.approx(1 - lost * 2 / (n * k * (2 * n - 3 * k - 1)))


def test_blocks_meet_in_single_precision_but_far_from_the_origin_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(B, "CELL_ROWS", 20)
    monkeypatch.setattr(B, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(3)
    x = 1e6 + rng.normal(size=(300, 5)).round(3)
    x[100:140] = x[7]
    rows = list(enumerate(x.tolist()))
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(4)
    assert found(B.nearest(df, df, "k", "v", 6, skip_self=True)) == brute(rows, rows, 6, True)
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.allclose(B.distances(x, x), apart, rtol=1e-9, atol=0)
    assert B.nearest_row(x[100:140], x)[0].tolist() == [7] * 40


def test_a_pair_of_blocks_costs_a_product_not_an_array_of_differences(monkeypatch):
    import tracemalloc

    x = np.random.default_rng(4).normal(size=(400, 256))
    tracemalloc.start()
    B.distances(x, x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12_000_000  # differences of all coordinates: 30 MB a time


def test_small_cells_share_a_block(spark):
    cells = B._Cells({0: (np.arange(40), np.arange(40.0).reshape(-1, 1))})
    cells.measure([{"cell": c, "n": 1000, "near": 0.0, "far": 1.0} for c in range(40)])
    assert cells.blocks == 5 and sorted(set(cells.first)) == list(range(5))


def test_a_side_without_rows_has_no_vectors():
    import pyarrow as pa

    assert B._rows(pa.array([], pa.list_(pa.float64()))).shape == (0, 0)
    assert B._rows(pa.array([[1.0, 2.0]])).tolist() == [[1.0, 2.0]]


@pytest.mark.parametrize("skip_self", [True, False])
def test_where_no_cell_can_be_excluded_visits_are_not_shuffled(spark, monkeypatch, skip_self):
    for name, value in (("CELL_ROWS", 10), ("BLOCK_ROWS", 10), ("QUERY_ROWS", 64), ("ROUNDS", (2, None))):
        monkeypatch.setattr(B, name, value, raising=False)
    rng = np.random.default_rng(5)
    points = [(f"p{i}", i % 2, rng.integers(0, 4, size=12 + i % 2).astype(float).tolist()) for i in range(400)]
    asked = points[:150]
    schema = "k string, g int, v array<double>"
    df, q = spark.createDataFrame(points, schema).repartition(3), spark.createDataFrame(asked, schema)
    kept, cut = [], B.cut
    monkeypatch.setattr(B, "cut", lambda d: (lambda out: (kept.append(out.count()) if "block" in out.columns else None, out)[1])(cut(d)))
    rows = B.nearest(q, df, "k", "v", 5, skip_self=skip_self, by="g").collect()
    got = {k: [r["neighbour"] for r in sorted((r for r in rows if r["k"] == k), key=lambda r: r["place"])] for k, *_ in asked}
    for g in (0, 1):
        some = lambda t: [(k, v) for k, h, v in t if h == g]  # noqa: E731, B023
        want = brute(some(points), some(asked), 5, skip_self)
        assert {k: got[k] for k in want} == want
    assert len(rows) == 5 * len(asked) and max(kept) <= 4 * len(asked)  # before: almost all of 20 blocks a query


def test_trustworthiness_shuffles_no_copies_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "QUERY_ROWS", 30, raising=False)
    monkeypatch.setattr(M, "BLOCK_ROWS", 40, raising=False)
    rng = np.random.default_rng(8)
    x = 1000 + rng.integers(0, 3, size=(200, 4)) + rng.integers(-8, 8, size=(200, 1)) / 8  # differences are exact
    z = x[:, :2] + rng.normal(size=(200, 2))
    df = spark.createDataFrame([(f"r{i:03}", h.tolist(), w.tolist()) for i, (h, w) in enumerate(zip(x, z))],
                               "k string, x array<double>, z array<double>").repartition(3)
    told = M.trustworthiness(df, "k", "x", "z")
    a, b, n, lost = *(np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1)) for m in (x, z)), 200, 0
    for i in range(n):
        rank = {j: r for r, (_, j) in enumerate(sorted((a[i, j], j) for j in range(n) if j != i), 1)}
        lost += sum(max(0, rank[j] - 5) for _, j in sorted((b[i, j], j) for j in range(n) if j != i)[:5])
    assert told.first()[0] == pytest.approx(1 - lost * 2 / (n * 5 * (2 * n - 16)))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan  # blocks meet where they are kept
