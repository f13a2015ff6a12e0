"""What a search and a rule model leave in the shared folder."""

import os

import numpy as np
from pyspark.sql import functions as F

from tabloom import session as S
from tabloom.functions import neighbours as B
from tabloom.operators import association as R


def test_a_search_keeps_its_last_state_only(spark, tmp_path, monkeypatch):
    for name, value in (("CELL_ROWS", 10), ("BLOCK_ROWS", 10), ("QUERY_ROWS", 64)):
        monkeypatch.setattr(B, name, value, raising=False)
    monkeypatch.setattr(S, "shared_folder", lambda spark: str(tmp_path))
    vectors = np.random.default_rng(6).normal(size=(120, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "k long, v array<double>")
    assert B.nearest(df, df, "k", "v", 3, skip_self=True).count() == 360
    assert [name.split("-")[0] for name in os.listdir(tmp_path)] == ["state"]


def test_baskets_are_stored_as_items_not_as_rows_of_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "shared_folder", lambda spark: str(tmp_path))
    baskets = spark.range(40_000).select(F.col("id").alias("basket"), F.explode(F.array(*[
        F.concat(F.lit("an item with a long name "), (F.col("id") % m).cast("string")) for m in (3, 5, 7)])).alias("item")).distinct()
    rules = spark.createDataFrame(
        [([f"an item with a long name {i}"], ["new"], 0.1, 0.5, 1.1) for i in range(7)],
        "antecedent array<string>, consequent array<string>, support double, confidence double, lift double")
    assert R.recommend(baskets, rules).count() == 40_000
    held = [os.path.join(at, f) for at, _, files in os.walk(tmp_path) for f in files]
    assert 0 < sum(map(os.path.getsize, held)) < 2_000_000
