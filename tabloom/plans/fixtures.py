"""Views over the driver tables shared by several queries, each in Spark and in SQL.

The tables hold no missing values, sentinels or duplicates, so these are put in by a hash
of the row key, the same way on both sides. Every view keeps all rows of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.hashing import unit_hash, unit_hash_sql
from tabloom.session import table

H = unit_hash_sql


def holed_customer(spark: SparkSession, sf: str) -> DataFrame:
    """customer with missing balances, nations and segments."""
    c = table(spark, sf, "customer")
    return c.select(
        "c_custkey", "c_name",
        F.when(unit_hash("c_custkey", seed=1) >= 0.1, F.col("c_nationkey")).alias("c_nationkey"),
        F.when(unit_hash("c_custkey", seed=2) >= 0.15, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(unit_hash("c_custkey", seed=3) >= 0.05, F.col("c_mktsegment")).alias("c_mktsegment"),
    )


HOLED_CUSTOMER = f"""(SELECT c_custkey, c_name,
  CASE WHEN {H('c_custkey', seed=1)} >= 0.1 THEN c_nationkey END AS c_nationkey,
  CASE WHEN {H('c_custkey', seed=2)} >= 0.15 THEN c_acctbal END AS c_acctbal,
  CASE WHEN {H('c_custkey', seed=3)} >= 0.05 THEN c_mktsegment END AS c_mktsegment
FROM customer)"""


def messy_customer(spark: SparkSession, sf: str) -> DataFrame:
    """customer as text: padded cells, sentinel strings, a column with one kind of junk."""
    c = table(spark, sf, "customer")
    h = unit_hash("c_custkey", seed=4)
    return c.select(
        "c_custkey",
        F.when(h < 0.1, " N/A ").when(h < 0.15, "").otherwise(
            F.concat(F.lit("  "), F.format_string("%.2f", "c_acctbal"), F.lit(" "))
        ).alias("balance"),
        F.when(h < 0.2, "?").otherwise(F.concat(F.lit(" "), F.col("c_mktsegment"))).alias("segment"),
        F.when(h > 0.9, "NULL").otherwise(F.col("c_nationkey").cast("string")).alias("nation"),
    )


MESSY_CUSTOMER = f"""(SELECT c_custkey,
  CASE WHEN h < 0.1 THEN ' N/A ' WHEN h < 0.15 THEN '' ELSE '  ' || printf('%.2f', c_acctbal) || ' ' END AS balance,
  CASE WHEN h < 0.2 THEN '?' ELSE ' ' || c_mktsegment END AS segment,
  CASE WHEN h > 0.9 THEN 'NULL' ELSE CAST(c_nationkey AS VARCHAR) END AS nation
FROM (SELECT *, {H('c_custkey', seed=4)} AS h FROM customer))"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with a binary truth and a score that is a fixed formula of the row, coarse
    enough to have ties: stands in for a scored model output."""
    l = table(spark, sf, "lineitem")
    p = F.floor((F.col("l_discount") * 4 + F.col("l_quantity") / 100 + F.col("l_tax")) * 50) / 64
    return l.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_key"),
        (F.col("l_returnflag") == "R").cast("int").alias("truth"),
        F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"),
        "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount",
    )


SCORED = """(SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_key,
  CAST(l_returnflag = 'R' AS INTEGER) AS truth,
  least(greatest(floor((l_discount * 4 + l_quantity / 100 + l_tax) * 50) / 64, 0.0), 1.0) AS p,
  l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount
FROM lineitem)"""


def classed(spark: SparkSession, sf: str) -> DataFrame:
    """Three-class truth and a predicted class."""
    s = scored(spark, sf)
    return s.select(
        "row_key", F.col("l_returnflag").alias("truth"),
        F.when(F.col("p") > 0.6, "R").when(F.col("p") > 0.35, "A").otherwise("N").alias("prediction"),
        F.col("l_linestatus").alias("segment"),
    )


CLASSED = f"""(SELECT row_key, l_returnflag AS truth,
  CASE WHEN p > 0.6 THEN 'R' WHEN p > 0.35 THEN 'A' ELSE 'N' END AS prediction,
  l_linestatus AS segment FROM {SCORED})"""


def regressed(spark: SparkSession, sf: str) -> DataFrame:
    """Price with a prediction that is a fixed formula of quantity and discount."""
    s = scored(spark, sf)
    return s.select(
        "row_key", F.col("l_extendedprice").alias("truth"),
        (F.col("l_quantity") * 1500 * (1 - F.col("l_discount"))).alias("prediction"),
        "l_returnflag", "l_linestatus",
    )


REGRESSED = f"""(SELECT row_key, l_extendedprice AS truth,
  l_quantity * 1500 * (1 - l_discount) AS prediction, l_returnflag, l_linestatus FROM {SCORED})"""


def daily_events(spark: SparkSession, sf: str) -> DataFrame:
    """Daily totals of the events per type: five series."""
    e = table(spark, sf, "events")
    return e.groupBy("event_type", F.unix_date(F.to_date("ts")).alias("day")).agg(
        F.round(F.sum("value"), 4).alias("y"), F.count("*").alias("n_events")
    )


DAILY_EVENTS = """(SELECT event_type, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day,
  round(sum(value), 4) AS y, count(*) AS n_events FROM events GROUP BY 1, 2)"""


def basket_items(spark: SparkSession, sf: str) -> DataFrame:
    """One row per line: the order is the basket, the brand of the part is the item."""
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return l.join(p, l.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("basket"), F.col("p_brand").alias("item")
    )


BASKET_ITEMS = """(SELECT l_orderkey AS basket, p_brand AS item
FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings with the label as the cluster."""
    e = table(spark, sf, "embeddings")
    return e.select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vector"),
        F.col("label").alias("cluster"),
    )


VECTORS = """(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector, label AS cluster FROM embeddings)"""


def vector_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings with one column per dimension: e1 ..."""
    v = vectors(spark, sf)
    width = v.select(F.max(F.size("vector"))).first()[0]
    return v.select(
        "vec_id", "cluster", *[F.col("vector")[i].alias(f"e{i + 1}") for i in range(width)]
    )


# Long form of the same: one row per vector and dimension.
VECTOR_CELLS = f"""(SELECT vec_id, cluster, unnest(range(1, len(vector) + 1)) AS d, unnest(vector) AS x
FROM {VECTORS})"""
