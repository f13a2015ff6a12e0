"""Queries for cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.hashing import unit_hash, unit_hash_sql
from tabloom.functions.scalar import BLANKS, SENTINELS, clean_text, join_items, norm_ppf
from tabloom.operators import cleaning as C
from tabloom.operators import profile as P
from tabloom.plans.fixtures import HOLED_CUSTOMER, MESSY_CUSTOMER, holed_customer, messy_customer
from tabloom.plans.registry import query, rounded
from tabloom.session import table

_SENTINELS = ", ".join(f"'{s}'" for s in SENTINELS)


def _clean_sql(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) NOT IN ({_SENTINELS}) THEN trim({c}) END"


def doubled(spark, sf):
    """lineitem with a hash-chosen tenth of its rows repeated."""
    l = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    return l.unionAll(l.filter(unit_hash("l_orderkey", "l_linenumber", seed=5) < 0.1))


DOUBLED = f"""(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM lineitem
WHERE {unit_hash_sql('l_orderkey', 'l_linenumber', seed=5)} < 0.1)"""


@query("dedupe", f"SELECT DISTINCT * FROM {DOUBLED}")
def dedupe(spark, sf):
    return C.dedupe(doubled(spark, sf))


@query("duplicates_removed", f"""SELECT count(*) AS rows_before,
(SELECT count(*) FROM (SELECT DISTINCT * FROM {DOUBLED})) AS rows_after,
count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {DOUBLED})) AS removed FROM {DOUBLED}""")
def duplicates_removed(spark, sf):
    return C.duplicates_removed(doubled(spark, sf))


@query("str_trim_lower_isin", f"SELECT c_custkey, {_clean_sql('segment')} AS segment FROM {MESSY_CUSTOMER}")
def str_trim_lower_isin(spark, sf):
    return messy_customer(spark, sf).select("c_custkey", clean_text("segment").alias("segment"))


FIXED = f"""(SELECT c_custkey, CAST({_clean_sql('balance')} AS DOUBLE) AS balance,
{_clean_sql('segment')} AS segment, CAST({_clean_sql('nation')} AS BIGINT) AS nation FROM {MESSY_CUSTOMER})"""


@query("fix_dtypes", f"SELECT * FROM {FIXED}")
def fix_dtypes(spark, sf):
    return C.fix_dtypes(messy_customer(spark, sf))


def messy_doubled(spark, sf):
    m = messy_customer(spark, sf)
    return m.unionAll(m.filter(unit_hash("c_custkey", seed=6) < 0.2))


@query("dedupe_fix", f"SELECT DISTINCT * FROM {FIXED}")
def dedupe_fix(spark, sf):
    return C.fix_dtypes(C.dedupe(messy_doubled(spark, sf)))


@query("drop_missing_target", f"SELECT c_custkey, c_acctbal FROM {HOLED_CUSTOMER} WHERE c_acctbal IS NOT NULL")
def drop_missing_target(spark, sf):
    c = holed_customer(spark, sf).select("c_custkey", "c_acctbal")
    return C.drop_missing_target(c, "c_acctbal")


@query("impute_median_mean", f"""SELECT c_custkey,
round(coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM {HOLED_CUSTOMER})), 6) AS c_acctbal,
round(coalesce(c_nationkey, (SELECT avg(c_nationkey) FROM {HOLED_CUSTOMER})), 6) AS c_nationkey
FROM {HOLED_CUSTOMER}""")
def impute_median_mean(spark, sf):
    c = holed_customer(spark, sf).select("c_custkey", "c_acctbal", "c_nationkey")
    return rounded(C.impute(C.impute(c, ["c_acctbal"], "median"), ["c_nationkey"], "mean"))


@query("impute_mode", f"""SELECT c_custkey, coalesce(c_mktsegment, (SELECT c_mktsegment FROM {HOLED_CUSTOMER}
WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS c_mktsegment FROM {HOLED_CUSTOMER}""")
def impute_mode(spark, sf):
    return C.impute(holed_customer(spark, sf).select("c_custkey", "c_mktsegment"), ["c_mktsegment"], "mode")


@query("impute_constant", f"""SELECT c_custkey, coalesce(c_mktsegment, 'UNKNOWN') AS c_mktsegment FROM {HOLED_CUSTOMER}""")
def impute_constant(spark, sf):
    c = holed_customer(spark, sf).select("c_custkey", "c_mktsegment")
    return C.impute(c, ["c_mktsegment"], "constant", fill_value="UNKNOWN")


def gapped_parts(spark, sf):
    """part sizes and prices with gaps, for the multivariate fills."""
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey",
        F.when(unit_hash("p_partkey", seed=7) >= 0.1, F.col("p_size").cast("double")).alias("size"),
        F.when(unit_hash("p_partkey", seed=8) >= 0.1, F.col("p_retailprice") / 100).alias("price"),
    )


GAPPED_PARTS = f"""(SELECT p_partkey, CASE WHEN {unit_hash_sql('p_partkey', seed=7)} >= 0.1 THEN p_size::DOUBLE END AS size,
CASE WHEN {unit_hash_sql('p_partkey', seed=8)} >= 0.1 THEN p_retailprice / 100 END AS price FROM part)"""


@query("impute_knn", f"""WITH p AS MATERIALIZED (SELECT * FROM {GAPPED_PARTS}),
s AS (SELECT p_partkey, avg(v) AS v FROM (SELECT a.p_partkey, b.size AS v, row_number() OVER (
  PARTITION BY a.p_partkey ORDER BY sqrt(2 * (a.price - b.price) ** 2), b.p_partkey) AS place
  FROM p a JOIN p b ON a.size IS NULL AND b.size IS NOT NULL AND a.price IS NOT NULL AND b.price IS NOT NULL)
  WHERE place <= 5 GROUP BY 1),
r AS (SELECT p_partkey, avg(v) AS v FROM (SELECT a.p_partkey, b.price AS v, row_number() OVER (
  PARTITION BY a.p_partkey ORDER BY sqrt(2 * (a.size - b.size) ** 2), b.p_partkey) AS place
  FROM p a JOIN p b ON a.price IS NULL AND b.price IS NOT NULL AND a.size IS NOT NULL AND b.size IS NOT NULL)
  WHERE place <= 5 GROUP BY 1)
SELECT p_partkey, round(coalesce(p.size, s.v, (SELECT avg(size) FROM p)), 5) AS size,
round(coalesce(p.price, r.v, (SELECT avg(price) FROM p)), 5) AS price
FROM p LEFT JOIN s USING (p_partkey) LEFT JOIN r USING (p_partkey)""")
def impute_knn(spark, sf):
    return rounded(C.impute(gapped_parts(spark, sf), ["size", "price"], "knn", key="p_partkey"), 5)


@query("impute_iterative")
def impute_iterative(spark, sf):
    return rounded(C.impute(gapped_parts(spark, sf), ["size", "price"], "iterative"), 5)


# With gaps in one column only, the fill is the plain regression on the other column.
@query("impute_iterative_one_gap", f"""WITH p AS (SELECT p_partkey, size, p_retailprice / 100 AS price FROM {GAPPED_PARTS} JOIN part USING (p_partkey)),
f AS (SELECT regr_slope(size, price) AS b, regr_intercept(size, price) AS a FROM p)
SELECT p_partkey, round(coalesce(size, a + b * price), 4) AS size FROM p, f""")
def impute_iterative_one_gap(spark, sf):
    gaps = gapped_parts(spark, sf).select("p_partkey", "size")
    full = table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 100).alias("price"))
    rows = gaps.join(full, "p_partkey")
    filled = C.fit_iterative(rows, ["size", "price"], estimator="least_squares").apply(rows)
    return rounded(filled.select("p_partkey", "size"), 4)


# The same with a prior on the slope, whose precisions are found step by step.
@query("impute_bayesian_one_gap", f"""WITH RECURSIVE p AS MATERIALIZED (SELECT p_partkey, size, p_retailprice / 100 AS price FROM {GAPPED_PARTS} JOIN part USING (p_partkey)),
m AS (SELECT regr_sxx(size, price) AS xx, regr_sxy(size, price) AS xy, regr_syy(size, price) AS yy, count(size) AS n, avg(size) AS my,
  avg(price) FILTER (size IS NOT NULL) AS mx FROM p),
s AS (SELECT 0 AS i, 1 / (yy / n + 2.220446049250313e-16) AS noise, 1.0::DOUBLE AS prior, NULL::DOUBLE AS b, false AS done FROM m
  UNION ALL SELECT i + 1, (n - used + 2e-6) / (greatest(0, yy - 2 * w * xy + w * w * xx) + 2e-6), (used + 2e-6) / (w * w + 2e-6), w,
    coalesce(abs(w - b) < 1e-3, false)
  FROM (SELECT *, xy / (xx + prior / noise) AS w, noise * xx / (prior + noise * xx) AS used FROM s, m WHERE NOT done AND i < 300)),
f AS (SELECT xy / (xx + prior / noise) AS b, my, mx FROM s, m ORDER BY i DESC LIMIT 1)
SELECT p_partkey, round(coalesce(size, my + b * (price - mx)), 4) AS size FROM p, f""")
def impute_bayesian_one_gap(spark, sf):
    gaps = gapped_parts(spark, sf).select("p_partkey", "size")
    full = table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 100).alias("price"))
    filled = C.impute(gaps.join(full, "p_partkey"), ["size", "price"], "iterative")
    return rounded(filled.select("p_partkey", "size"), 4)


_FENCES = f"""(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events))"""


@query("outlier_flag", f"""SELECT event_id, value, value < lo OR value > hi AS value_outlier FROM events, {_FENCES}""")
def outlier_flag(spark, sf):
    return C.treat_outliers(table(spark, sf, "events").select("event_id", "value"), ["value"], "flag")


@query("outlier_clip", f"""SELECT event_id, round(least(greatest(value, lo), hi), 6) AS value FROM events, {_FENCES}""")
def outlier_clip(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return rounded(C.treat_outliers(e, ["value"], "clip"))


@query("outlier_winsorize", """SELECT event_id, round(least(greatest(value, lo), hi), 6) AS value FROM events,
(SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events)""")
def outlier_winsorize(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return rounded(C.treat_outliers(e, ["value"], "winsorize"))


_OPTIONS = C.CleaningOptions(
    target="segment", task_type="multiclass", imputations=(("balance", "median"), ("nation", "mode")),
    outlier_columns=("balance",), outlier_op="winsorize",
)

_DROPPED = f"(SELECT * FROM (SELECT DISTINCT * FROM {FIXED}) WHERE segment IS NOT NULL)"
_FILLED = f"""(SELECT c_custkey, segment,
coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM {_DROPPED})) AS balance,
coalesce(nation, (SELECT nation FROM {_DROPPED} WHERE nation IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS nation
FROM {_DROPPED})"""
CLEANED = f"""(SELECT c_custkey, segment, nation, least(greatest(balance, lo), hi) AS balance FROM {_FILLED},
(SELECT quantile_cont(balance, 0.01) AS lo, quantile_cont(balance, 0.99) AS hi FROM {_FILLED}))"""


@query("run_cleaning", f"SELECT c_custkey, segment, nation, round(balance, 6) AS balance FROM {CLEANED}")
def run_cleaning(spark, sf):
    return rounded(C.run_cleaning(messy_doubled(spark, sf), _OPTIONS).frame)


@query("run_cleaning_ops", f"""WITH n AS (SELECT (SELECT count(*) FROM {MESSY_CUSTOMER}) + (SELECT count(*) FROM customer
  WHERE {unit_hash_sql('c_custkey', seed=6)} < 0.2) AS raw, (SELECT count(*) FROM customer) AS uniq,
  (SELECT count(*) FROM {_DROPPED}) AS kept)
SELECT 1 AS step, 'dedupe' AS op, raw AS rows_before, uniq AS rows_after FROM n
UNION ALL SELECT 2, 'fix_dtypes', uniq, uniq FROM n
UNION ALL SELECT 3, 'drop_rows', uniq, kept FROM n
UNION ALL SELECT 4, 'impute', kept, kept FROM n
UNION ALL SELECT 5, 'impute', kept, kept FROM n
UNION ALL SELECT 6, 'outlier_treatment', kept, kept FROM n""")
def run_cleaning_ops(spark, sf):
    report = C.run_cleaning(messy_doubled(spark, sf), _OPTIONS).report
    return report.select("step", "op", "rows_before", "rows_after")


@query("run_cleaning_report", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype,
    {"CASE WHEN count(DISTINCT segment) <= 20 THEN 'categorical' ELSE 'text' END" if t == 'string' else "any_value('numeric')"} AS kind,
    count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*)::DOUBLE, 4) AS missing_pct,
    count(DISTINCT {c}) AS "unique" FROM {CLEANED}"""
    for c, t in (("c_custkey", "bigint"), ("segment", "string"), ("nation", "bigint"), ("balance", "double"))))
def run_cleaning_report(spark, sf):
    return P.schema_report(C.run_cleaning(messy_doubled(spark, sf), _OPTIONS).frame)


# scalar functions ----------------------------------------------------------------------------


@query("str_join_items", """SELECT o_orderkey, array_to_string(list_sort([o_orderpriority, o_orderstatus]), ' + ')
|| ' => ' || o_orderstatus AS rule FROM orders""")
def str_join_items(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.concat_ws(
        " => ", join_items(F.array("o_orderpriority", "o_orderstatus")), "o_orderstatus").alias("rule"))


@query("array_subset", """WITH b AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS held FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(held, ',') AS held,
array_to_string(list_sort(list_filter(held, lambda x: x NOT IN ('A', 'R'))), ',') AS rest,
list_contains(held, 'A') AND list_contains(held, 'R') AS has_both FROM b""")
def array_subset(spark, sf):
    b = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("l_returnflag")).alias("held"))
    wanted = F.array(F.lit("A"), F.lit("R"))
    return b.select(
        "l_orderkey", F.array_join("held", ",").alias("held"),
        F.array_join(F.array_sort(F.array_except("held", wanted)), ",").alias("rest"),
        (F.size(F.array_intersect("held", wanted)) == 2).alias("has_both"))


@query("math_log1p", """SELECT o_orderkey, round(ln(1 + o_totalprice), 8) AS logged,
round(o_totalprice, 4) AS restored FROM orders""")
def math_log1p(spark, sf):
    from tabloom.operators.features import TargetTransform
    t = TargetTransform("log")
    o = table(spark, sf, "orders").select("o_orderkey", t.apply(F.col("o_totalprice")).alias("logged"))
    return o.select("o_orderkey", F.round("logged", 8).alias("logged"),
                    F.round(t.invert(F.col("logged")), 4).alias("restored"))


@query("math_round_abs_sqrt_exp", """SELECT event_id, round(abs(value - 20), 4) AS a, round(sqrt(abs(value)), 6) AS r,
round(exp(value / 1000), 8) AS odds FROM events""")
def math_round_abs_sqrt_exp(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", F.round(F.abs(v - 20), 4).alias("a"), F.round(F.sqrt(F.abs(v)), 6).alias("r"),
        F.round(F.exp(v / 1000), 8).alias("odds"))


@query("norm_ppf")
def norm_ppf_query(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.round(norm_ppf(F.greatest(unit_hash("o_orderkey", seed=9), F.lit(1e-12))), 6).alias("z"))
