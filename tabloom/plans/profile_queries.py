"""Queries for schema, missing values and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.hashing import unit_hash_sql
from tabloom.functions.scalar import chi2_quantile, to_number
from tabloom.operators import profile as P
from tabloom.plans.fixtures import (
    HOLED_CUSTOMER, MESSY_CUSTOMER, VECTOR_CELLS, holed_customer, messy_customer, vector_columns,
)
from tabloom.plans.registry import query, rounded
from tabloom.session import table

# Column name, Spark type name and SQL kind rule of the customer view.
_CUSTOMER = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
             ("c_acctbal", "double"), ("c_mktsegment", "string")]


def _kind_sql(c: str, kind: str) -> str:
    if kind == "string":
        return f"CASE WHEN count(DISTINCT {c}) <= 20 THEN 'categorical' ELSE 'text' END"
    return "any_value('datetime')" if kind.startswith("timestamp") else "any_value('numeric')"


def _per_column(columns, source: str, body) -> str:
    return " UNION ALL ".join(f"SELECT {body(c, k)} FROM {source}" for c, k in columns)


_ORDERS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
           ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
           ("o_orderpriority", "string")]


@query("infer_kind", _per_column(_ORDERS, "orders", lambda c, k:
       f"'{c}' AS \"column\", {_kind_sql(c, k)} AS kind"))
def infer_kind(spark, sf):
    return P.infer_kind(table(spark, sf, "orders"))


SCHEMA_REPORT = _per_column(_CUSTOMER, HOLED_CUSTOMER, lambda c, k:
    f"'{c}' AS \"column\", '{k}' AS dtype, {_kind_sql(c, k)} AS kind, count(*) - count({c}) AS missing,"
    f" round((count(*) - count({c})) / count(*)::DOUBLE, 4) AS missing_pct, count(DISTINCT {c}) AS \"unique\"")


@query("schema_report", SCHEMA_REPORT)
def schema_report(spark, sf):
    return P.schema_report(holed_customer(spark, sf))


@query("feature_columns", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def feature_columns(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(*P.feature_columns(c, target="c_mktsegment", eval_labels="c_acctbal"))


@query("categorical_cardinalities", """
SELECT * FROM (SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS "unique" FROM orders
UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders
UNION ALL SELECT 'o_orderdate', count(DISTINCT o_orderdate) FROM orders) WHERE "unique" <= 20""")
def categorical_cardinalities(spark, sf):
    return P.categorical_cardinalities(table(spark, sf, "orders"))


_MISSING = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM {HOLED_CUSTOMER}"
    for c, _ in _CUSTOMER)


@query("missing_counts", f"SELECT * FROM ({_MISSING}) WHERE missing > 0")
def missing_counts(spark, sf):
    return P.missing_counts(holed_customer(spark, sf))


@query("columns_with_missing",
       f"SELECT \"column\" FROM ({_MISSING}) WHERE missing > 0 AND \"column\" <> 'c_mktsegment'")
def columns_with_missing(spark, sf):
    return P.columns_with_missing(holed_customer(spark, sf), exclude=["c_mktsegment"])


@query("to_numeric_coerce",
       f"SELECT c_custkey, TRY_CAST(trim(balance) AS DOUBLE) AS balance FROM {MESSY_CUSTOMER}")
def to_numeric_coerce(spark, sf):
    return messy_customer(spark, sf).select("c_custkey", to_number(F.trim("balance")).alias("balance"))


@query("dropna_complete", f"""SELECT c_custkey, c_nationkey, c_acctbal FROM {HOLED_CUSTOMER}
WHERE c_nationkey IS NOT NULL AND c_acctbal IS NOT NULL""")
def dropna_complete(spark, sf):
    c = holed_customer(spark, sf).select("c_custkey", "c_nationkey", "c_acctbal")
    return P.dropna_complete(c, ["c_nationkey", "c_acctbal"])


def describe_sql(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}::DOUBLE), 6) AS mean,
        round(stddev_samp({c}::DOUBLE), 6) AS std, round(min({c}::DOUBLE), 6) AS min,
        round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50,
        round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75, round(max({c}::DOUBLE), 6) AS max FROM {source}"""
        for c in columns)


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_numeric", describe_sql("lineitem", _LINE))
def describe_numeric(spark, sf):
    return rounded(P.describe_numeric(table(spark, sf, "lineitem"), _LINE))


def pearson_sql(source: str, columns, digits=6) -> str:
    from itertools import combinations
    return " UNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}::DOUBLE, {b}::DOUBLE), {digits}) AS r FROM {source}"
        for a, b in combinations(columns, 2))


def rank_sql(source: str, a: str, b: str) -> str:
    return (f"(SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,"
            f" rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb"
            f" FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


def spearman_sql(source: str, columns, digits=6) -> str:
    from itertools import combinations
    return " UNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr(ra, rb), {digits}) AS r"
        f" FROM {rank_sql(source, a, b)}" for a, b in combinations(columns, 2))


@query("corr_pearson", pearson_sql("lineitem", _LINE))
def corr_pearson(spark, sf):
    return rounded(P.corr_pearson(table(spark, sf, "lineitem"), _LINE))


_HOLED = ["c_custkey", "c_nationkey", "c_acctbal"]


@query("corr_spearman",
       spearman_sql("lineitem", _LINE) + " UNION ALL " + spearman_sql(HOLED_CUSTOMER, _HOLED))
def corr_spearman(spark, sf):
    full = P.corr_spearman(table(spark, sf, "lineitem"), _LINE)
    return rounded(full.unionByName(P.corr_spearman(holed_customer(spark, sf), _HOLED)))


def chi_sql(source: str, a: str, b: str) -> str:
    """Textbook chi-square over all cells, empty ones included."""
    return f"""(WITH t AS (SELECT {a} AS x, {b} AS y, count(*) AS n FROM {source}
      WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
    rx AS (SELECT x, sum(n) AS r FROM t GROUP BY 1), cy AS (SELECT y, sum(n) AS c FROM t GROUP BY 1),
    g AS (SELECT sum(n) AS total FROM t)
    SELECT sum((coalesce(n, 0) - r * c / total::DOUBLE) ** 2 / (r * c / total::DOUBLE)) AS chi2,
      any_value(total) AS total, count(DISTINCT rx.x) AS nx, count(DISTINCT cy.y) AS ny
    FROM rx CROSS JOIN cy CROSS JOIN g LEFT JOIN t ON t.x = rx.x AND t.y = cy.y)"""


_CATS = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query("cramers_v", " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(sqrt(chi2 / (total * (least(nx, ny) - 1))), 6) AS v"
    f" FROM {chi_sql('lineitem', a, b)}"
    for a, b in [(_CATS[0], _CATS[1]), (_CATS[0], _CATS[2]), (_CATS[1], _CATS[2])]))
def cramers_v(spark, sf):
    return rounded(P.cramers_v(table(spark, sf, "lineitem"), _CATS))


@query("chi_square", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(chi2, 4) AS chi2, (nx - 1) * (ny - 1) AS dof FROM {chi_sql('lineitem', f, 'l_returnflag')}"
    for f in ("l_linestatus", "l_linenumber")))
def chi_square(spark, sf):
    df = P.chi_square(table(spark, sf, "lineitem"), "l_returnflag", ["l_linestatus", "l_linenumber"])
    return rounded(df, 4)


CLASS_COUNTS = f"""SELECT c_mktsegment, count(*) AS count,
round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM {HOLED_CUSTOMER}
WHERE c_mktsegment IS NOT NULL GROUP BY 1"""


@query("class_counts", CLASS_COUNTS)
def class_counts(spark, sf):
    return rounded(P.class_counts(holed_customer(spark, sf), "c_mktsegment"))


@query("crosstab", """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F",
count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P"
FROM orders GROUP BY 1""")
def crosstab(spark, sf):
    return P.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("class_balance", """WITH c AS (SELECT toxic, count(*) AS count FROM labels GROUP BY 1),
f AS (SELECT *, count / sum(count) OVER () AS fraction FROM c)
SELECT toxic, count, round(fraction, 6) AS fraction, round(min(fraction) OVER (), 6) AS minority_fraction,
min(fraction) OVER () < 0.2 AS imbalanced FROM f""")
def class_balance(spark, sf):
    return rounded(P.class_balance(table(spark, sf, "labels"), "toxic"))


@query("target_stats", """SELECT 'toxic' AS target, round(min(n) / sum(n), 6) AS minority_fraction, 0.0::DOUBLE AS target_skew
FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)
UNION ALL SELECT 'value', NULL, round(skewness(value), 6) FROM events""")
def target_stats(spark, sf):
    a = P.target_stats(table(spark, sf, "labels"), "toxic", classification=True)
    b = P.target_stats(table(spark, sf, "events"), "value", classification=False)
    out = a.select(F.lit("toxic").alias("target"), "*").unionByName(
        b.select(F.lit("value").alias("target"), "*"))
    return rounded(out)


_SKEW = ["o_totalprice", "o_custkey"]


@query("skew", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(skewness({c}::DOUBLE), 6) AS skew FROM orders" for c in _SKEW))
def skew(spark, sf):
    return rounded(P.skew(table(spark, sf, "orders"), _SKEW))


@query("skew_hint", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CASE WHEN abs(skewness({c}::DOUBLE)) > 1 THEN '|skew| = ' ||
    printf('%.2f', abs(skewness({c}::DOUBLE))) || ' > 1: try a log transform' END AS hint FROM events"""
    for c in ("value", "user_id")))
def skew_hint(spark, sf):
    return P.skew_hint(table(spark, sf, "events"), ["value", "user_id"])


def histogram_sql(source: str, c: str, bins: int, right_closed: bool) -> str:
    at = f"({c} - lo) / w"
    b = f"greatest(ceil({at}), 1)" if right_closed else f"floor({at}) + 1"
    return f"""WITH m AS (SELECT min({c}) AS lo, (max({c}) - min({c})) / {bins} AS w FROM {source}),
    k AS (SELECT least({b}, {bins})::INTEGER AS bin, count(*) AS n FROM {source}, m WHERE {c} IS NOT NULL GROUP BY 1)
    SELECT r.bin::INTEGER AS bin, round(lo + (r.bin - 1) * w, 4) AS lower, round(lo + r.bin * w, 4) AS upper,
    coalesce(n, 0) AS count FROM range(1, {bins + 1}) r(bin) CROSS JOIN m LEFT JOIN k ON k.bin = r.bin"""


@query("target_histogram", histogram_sql("orders", "o_totalprice", 30, True))
def target_histogram(spark, sf):
    return rounded(P.target_histogram(table(spark, sf, "orders"), "o_totalprice"), 4)


@query("regression_report", f"""
SELECT 'skew' AS part, 0 AS bin, round(skewness(o_totalprice), 4) AS value FROM orders
UNION ALL SELECT 'histogram', bin, count::DOUBLE FROM ({histogram_sql('orders', 'o_totalprice', 30, True)})""")
def regression_report(spark, sf):
    r = P.regression_report(table(spark, sf, "orders"), "o_totalprice", ["o_custkey"])
    a = r["skew"].select(F.lit("skew").alias("part"), F.lit(0).alias("bin"), F.col("skew").alias("value"))
    b = r["histogram"].select(F.lit("histogram"), "bin", F.col("count").cast("double"))
    return rounded(a.union(b), 4)


ZSCORE = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, (SELECT count(*) FROM {{t}}, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM {{t}})"
    f" WHERE abs(({c} - m) / s) > 3) AS flagged" for c in ("value", "user_id"))


@query("zscore_flags", ZSCORE.format(t="events"))
def zscore_flags(spark, sf):
    return P.zscore_flags(table(spark, sf, "events"), ["value", "user_id"])


IQR = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1)) AS below,
    count(*) FILTER ({c} > q3 + 1.5 * (q3 - q1)) AS above FROM events,
    (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM events)"""
    for c in ("value", "user_id"))


@query("iqr_flags", IQR)
def iqr_flags(spark, sf):
    return P.iqr_flags(table(spark, sf, "events"), ["value", "user_id"])


_CHI2 = chi2_quantile(0.999, 2)
MAHALANOBIS = f"""WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my,
  var_samp(l_quantity) + 1e-9 AS sxx, var_samp(l_extendedprice) + 1e-9 AS syy,
  covar_samp(l_quantity, l_extendedprice) AS sxy FROM lineitem),
d AS (SELECT (syy * (l_quantity - mx) ** 2 - 2 * sxy * (l_quantity - mx) * (l_extendedprice - my)
  + sxx * (l_extendedprice - my) ** 2) / (sxx * syy - sxy * sxy) AS d2 FROM lineitem, m)
SELECT round(avg(sqrt(d2)), 5) AS mean_distance, round(max(sqrt(d2)), 5) AS max_distance,
count(*) FILTER (d2 > {_CHI2!r}) AS flagged, round({_CHI2!r}::DOUBLE, 5) AS threshold FROM d"""


@query("mahalanobis", MAHALANOBIS)
def mahalanobis(spark, sf):
    return rounded(P.mahalanobis(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]), 5)


@query("correlation_groups", """SELECT 'l_quantity' AS lead, 'l_extendedprice' AS member,
round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem
HAVING abs(corr(l_quantity, l_extendedprice)) >= 0.7""")
def correlation_groups(spark, sf):
    return rounded(P.correlation_groups(table(spark, sf, "lineitem"), _LINE))


_VIF = ("l_quantity", "l_extendedprice", "l_discount")
_VIF_SQL = """WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac,
corr(l_extendedprice, l_discount) AS bc FROM lineitem),
d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM c)
SELECT 'l_quantity' AS feature, round((1 - bc * bc) / det, 6) AS vif FROM d
UNION ALL SELECT 'l_extendedprice', round((1 - ac * ac) / det, 6) FROM d
UNION ALL SELECT 'l_discount', round((1 - ab * ab) / det, 6) FROM d"""


@query("vif", _VIF_SQL)
def vif(spark, sf):
    return rounded(P.vif(table(spark, sf, "lineitem"), _VIF))


_EIGEN2 = """WITH m AS (SELECT var_samp(l_quantity) AS a, var_samp(l_discount) AS c,
covar_samp(l_quantity, l_discount) AS b FROM lineitem),
e AS (SELECT (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS e1,
(a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS e2 FROM m)"""


@query("scree", _EIGEN2 + """
SELECT 'PC1' AS component, round(e1, 5) AS eigenvalue, round(e1 / (e1 + e2), 5) AS explained_variance,
round(e1 / (e1 + e2), 5) AS cumulative FROM e
UNION ALL SELECT 'PC2', round(e2, 5), round(e2 / (e1 + e2), 5), 1.0 FROM e""")
def scree(spark, sf):
    return rounded(P.scree(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"]), 5)


@query("components_for_90", _EIGEN2 + """
SELECT CASE WHEN e1 / (e1 + e2) >= 0.9 THEN 1 ELSE 2 END::BIGINT AS components FROM e""")
def components_for_90(spark, sf):
    return P.components_for(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"])


@query("scree_wide")
def scree_wide(spark, sf):
    v = vector_columns(spark, sf)
    return rounded(P.scree(v, [c for c in v.columns if c.startswith("e")]), 5)


_H0 = unit_hash_sql("o_orderkey", seed=0)


@query("eda_sample", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_H0}, o_orderkey LIMIT 10000")
def eda_sample(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return P.hash_sample(o, "o_orderkey", 10_000)


@query("background_sample", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_H0}, o_orderkey LIMIT 100")
def background_sample(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return P.hash_sample(o, "o_orderkey", 100)


@query("base_report", f"""
SELECT 'rows' AS part, '' AS a, '' AS b, count(*)::DOUBLE AS value FROM {HOLED_CUSTOMER}
UNION ALL SELECT 'columns', '', '', 5
UNION ALL SELECT 'missing', "column", '', missing::DOUBLE FROM ({_MISSING}) WHERE missing > 0
UNION ALL SELECT 'pearson', "left", "right", r FROM ({pearson_sql(HOLED_CUSTOMER, _HOLED, 4)})
UNION ALL SELECT 'spearman', "left", "right", r FROM ({spearman_sql(HOLED_CUSTOMER, _HOLED, 4)})
UNION ALL SELECT 'mean', "column", '', round(mean, 4) FROM ({describe_sql(HOLED_CUSTOMER, _HOLED)})
UNION ALL SELECT 'median', "column", '', round(p50, 4) FROM ({describe_sql(HOLED_CUSTOMER, _HOLED)})""")
def base_report(spark, sf):
    from tabloom.operators.reports import base_report as report, long_report
    return rounded(long_report(report(holed_customer(spark, sf)), {
        "rows": ("shape", None, None, "rows"), "columns": ("shape", None, None, "columns"),
        "missing": ("missing", "column", None, "missing"),
        "pearson": ("pearson", "left", "right", "r"),
        "spearman": ("spearman", "left", "right", "r"),
        "mean": ("describe", "column", None, "mean"), "median": ("describe", "column", None, "p50"),
    }), 4)
