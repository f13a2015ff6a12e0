"""Queries for sources, sinks, versions, advice and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import advice as V
from tabloom.operators import cleaning as C
from tabloom.operators import features as X
from tabloom.operators.profile import iqr_fences
from tabloom.plans.cleaning_queries import CLEANED, MESSY_CUSTOMER, messy_customer, messy_doubled
from tabloom.plans.fixtures import HOLED_CUSTOMER, holed_customer
from tabloom.plans.registry import query, rounded
from tabloom.session import scratch_dir, table
from tabloom.sources import files as S
from tabloom.sources import versions as W

_ORDERS = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _dropped_csv(spark, df, sep: str) -> str:
    path = f"{scratch_dir(spark, 'text')}/table"
    df.write.option("header", True).option("sep", sep).csv(path)
    return path


@query("scan_csv", f"""SELECT c_custkey::BIGINT AS c_custkey, CASE WHEN lower(trim(balance)) NOT IN ('', 'n/a') THEN trim(balance)::DOUBLE END AS balance,
CASE WHEN trim(segment) <> '?' THEN trim(segment) END AS segment, CASE WHEN nation <> 'NULL' THEN nation::BIGINT END AS nation FROM {MESSY_CUSTOMER}""")
def scan_csv(spark, sf):
    return S.scan_csv(spark, _dropped_csv(spark, messy_customer(spark, sf), ","))


@query("scan_csv_schema", _ORDERS)
def scan_csv_schema(spark, sf):
    o = orders(spark, sf)
    return S.scan_csv(spark, _dropped_csv(spark, o, ","), schema=o.schema)


@query("scan_tsv", _ORDERS)
def scan_tsv(spark, sf):
    o = orders(spark, sf)
    return S.scan_tsv(spark, _dropped_csv(spark, o, "\t"), schema=o.schema)


@query("scan_parquet", "SELECT * FROM customer")
def scan_parquet(spark, sf):
    return S.scan(spark, f"{sf}/customer.parquet")


_SQL = """SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"""


@query("scan_sql_query", _SQL)
def scan_sql_query(spark, sf):
    return S.scan_sql(spark, _SQL, {n: table(spark, sf, n) for n in ("orders", "customer")})


@query("scan_sample", "SELECT * FROM nation")
def scan_sample(spark, sf):
    return S.scan_sample(spark, "nations", {"nations": f"{sf}/nation.parquet"})


@query("sink_version", _ORDERS)
def sink_version(spark, sf):
    root = scratch_dir(spark, "versions")
    W.write_version(orders(spark, sf), root, 1)
    return spark.read.parquet(f"{W.version_path(root, 1)}/data")


@query("read_version", f"""SELECT 'o_orderkey' AS "column", 'bigint' AS dtype, count(DISTINCT o_orderkey) AS "unique" FROM orders
UNION ALL SELECT 'o_orderstatus', 'string', count(DISTINCT o_orderstatus) FROM orders
UNION ALL SELECT 'o_totalprice', 'double', count(DISTINCT o_totalprice) FROM orders
UNION ALL SELECT 'o_orderpriority', 'string', count(DISTINCT o_orderpriority) FROM orders""")
def read_version(spark, sf):
    root = scratch_dir(spark, "versions")
    W.write_version(orders(spark, sf), root, 7)
    assert not W.read_version(spark, root, 7).isEmpty()
    return W.read_version_info(spark, root, 7).select("column", "dtype", "unique")


def digest_sql(source: str, columns: dict[str, str]) -> str:
    """`columns` maps the sorted column names to their types."""
    head = "".join(f"{len(t)}:{t}" for c, kind in columns.items() for t in (c, kind))
    texts = [f"epoch_us({c})" if kind == "timestamp" else c for c, kind in columns.items()]
    parts = ", ".join(f"coalesce(length(CAST({e} AS VARCHAR)) || ':' || CAST({e} AS VARCHAR), '-')" for e in texts)
    half = "CAST(sum(CAST('0x' || substr(m, {}, 16) AS UBIGINT)) AS VARCHAR)"
    return f"""SELECT count(*) AS rows, {half.format(1)} || '-' || {half.format(17)} AS digest
FROM (SELECT md5(concat_ws('|', '{head}', {parts})) AS m FROM {source})"""


@query("dataset_hash", digest_sql("orders", {
    "o_orderkey": "bigint", "o_orderpriority": "string", "o_orderstatus": "string", "o_totalprice": "double"}))
def dataset_hash(spark, sf):
    return W.dataset_hash(orders(spark, sf))


@query("dataset_hash_zones", digest_sql("(SELECT event_id, ts FROM events)", {"event_id": "bigint", "ts": "timestamp"}))
def dataset_hash_zones(spark, sf):
    """A table of moments, digested under another time zone."""
    e = table(spark, sf, "events").select("event_id", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp"))).alias("ts"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        return spark.createDataFrame(W.dataset_hash(e).collect(), "rows bigint, digest string")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@query("replay_steps", digest_sql(CLEANED, {
    "balance": "double", "c_custkey": "bigint", "nation": "bigint", "segment": "string"}))
def replay_steps(spark, sf):
    done = W.replay(messy_doubled(spark, sf), [
        ("dedupe", {}), ("fix_dtypes", {}), ("drop_missing_target", {"target": "segment"}),
        ("impute", {"columns": ["balance"], "strategy": "median"}),
        ("impute", {"columns": ["nation"], "strategy": "mode"}),
        ("treat_outliers", {"columns": ["balance"], "op": "winsorize"}),
    ], {f.__name__: f for f in (C.dedupe, C.fix_dtypes, C.drop_missing_target, C.impute, C.treat_outliers)})
    return W.dataset_hash(done)


@query("sink_csv", _ORDERS)
def sink_csv(spark, sf):
    o = orders(spark, sf)
    path = W.write_csv(o, f"{scratch_dir(spark, 'csv')}/orders")
    return spark.read.option("header", True).schema(o.schema).csv(path)


# advice -------------------------------------------------------------------------------------------


@query("data_advice", f"""SELECT 'c_acctbal' AS subject, 'imputation needed' AS finding, (count(*) - count(c_acctbal))::DOUBLE AS statistic FROM {HOLED_CUSTOMER}
UNION ALL SELECT 'c_nationkey', 'imputation needed', count(*) - count(c_nationkey) FROM {HOLED_CUSTOMER}
UNION ALL SELECT 'c_name', 'high cardinality', count(DISTINCT c_name) FROM {HOLED_CUSTOMER}
UNION ALL SELECT 'table', 'boosting before neural', count(*) FROM {HOLED_CUSTOMER} HAVING count(*) < 50000
UNION ALL SELECT 'c_mktsegment', 'imbalanced metrics', round(min(n) / sum(n), 6) FROM (SELECT count(*) AS n FROM {HOLED_CUSTOMER} WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment) HAVING min(n) / sum(n) < 0.2
UNION ALL SELECT 'value', unnest(['prefer MAE', 'log transform']), round(s, 6) FROM (SELECT skewness(value) AS s FROM events) WHERE abs(s) > 1""")
def data_advice(spark, sf):
    a = V.data_advice(holed_customer(spark, sf), target="c_mktsegment", task_type="multiclass")
    e = table(spark, sf, "events").select("user_id", "value")
    b = V.data_advice(e, target="value", task_type="regression")
    return rounded(a.unionByName(b.filter(F.col("subject") == "value")))


@query("suggest_task", """SELECT 'o_orderdate' AS target, 'forecasting' AS task UNION ALL SELECT 'o_orderstatus', CASE count(DISTINCT o_orderstatus) WHEN 2 THEN 'binary' ELSE 'multiclass' END FROM orders
UNION ALL SELECT 'o_totalprice', CASE count(DISTINCT o_totalprice) WHEN 2 THEN 'binary' ELSE 'regression' END FROM orders
UNION ALL SELECT 'quality', CASE count(DISTINCT quality) WHEN 2 THEN 'binary' ELSE 'multiclass' END FROM labels
UNION ALL SELECT 'label', CASE WHEN count(DISTINCT label) = 2 THEN 'binary' WHEN count(DISTINCT label) <= 20 THEN 'multiclass' ELSE 'regression' END FROM embeddings""")
def suggest_task(spark, sf):
    targets = [("orders", "o_orderdate"), ("orders", "o_orderstatus"), ("orders", "o_totalprice"),
               ("labels", "quality"), ("embeddings", "label")]
    rows = [(c, V.suggest_task(table(spark, sf, t), c)) for t, c in targets]
    return spark.createDataFrame(rows, "target string, task string")


# streaming ----------------------------------------------------------------------------------------


@query("stream_score", """SELECT event_id, round((least(greatest(value, lo), hi) - a) / s, 6) AS scaled, (value > hi)::INTEGER AS flagged FROM events,
(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)),
(SELECT avg(value) AS a, stddev_pop(value) AS s FROM events)""")
def stream_score(spark, sf):
    from tabloom.streaming.score import score_available
    e = table(spark, sf, "events")
    fences, scaler = iqr_fences(e, ["value"]), X.fit_scaler(e, ["value"], "standard")
    done = score_available(spark, sf, "events.parquet", [
        lambda df: df.select("event_id", "value", (F.col("value") > fences["value"][1]).cast("int").alias("flagged")),
        lambda df: C.clip(df, fences), lambda df: X.scale(df, scaler),
    ], scratch_dir(spark, "stream-score"))
    return done.select("event_id", F.round("value", 6).alias("scaled"), "flagged")
