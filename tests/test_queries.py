"""Registered queries against their SQL oracles at the smallest scale. A cross-section runs by
default; TABLOOM_ALL_QUERIES=1 runs every query."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tabloom.session import TABLES

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "schema_report", "corr_spearman", "cramers_v", "fix_dtypes", "run_cleaning", "split_stratified",
    "cv_kfold", "encode_ordinal", "ts_residual", "ts_acf", "ts_pacf", "forecast_frame", "mine_rules",
    "recommend", "metric_pr_auc", "metric_roc_auc", "calibration", "confusion", "error_by_quantile",
    "silhouette_rows", "metric_trustworthiness", "fit_lof", "fit_ridge", "cv_scores", "dataset_hash",
    "stream_score", "scan_csv", "dataset_hash_zones", "cv_group_even", "encode_target", "impute_knn",
    "impute_bayesian_one_gap", "fit_association", "pca_axes", "error_views_anomaly",
)
NAMES = sorted(entry.oracle_sql()) if os.environ.get("TABLOOM_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted([tuple(str(clean(r[i])) for i in order) for r in rows])


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(want.fetchall(), names)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 4
