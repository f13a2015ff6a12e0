"""Queries for baskets, itemsets, rules and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.hashing import unit_hash, unit_hash_sql
from tabloom.functions.scalar import join_items, rule_text
from tabloom.operators import association as A
from tabloom.plans.fixtures import BASKET_ITEMS, basket_items
from tabloom.plans.registry import query
from tabloom.session import cut, table

SUPPORT, CONFIDENCE, LIFT = 0.0036, 0.16, 1.02


def baskets(spark, sf):
    return A.baskets_from_long(basket_items(spark, sf), "basket", "item")


B = f"(SELECT DISTINCT basket, item FROM {BASKET_ITEMS})"
_PAIRS = f"""(WITH b AS MATERIALIZED (SELECT * FROM {B}), n AS (SELECT count(DISTINCT basket) AS n FROM b)
SELECT [item] AS items, count(*) / any_value(n) AS support FROM b, n GROUP BY item
UNION ALL SELECT [x.item, y.item], count(*) / any_value(n) FROM b x JOIN b y USING (basket), n WHERE x.item < y.item GROUP BY x.item, y.item
UNION ALL SELECT [x.item, y.item, z.item], count(*) / any_value(n) FROM b x JOIN b y USING (basket) JOIN b z USING (basket), n
WHERE x.item < y.item AND y.item < z.item GROUP BY x.item, y.item, z.item)"""
ITEMSETS = f"(SELECT * FROM {_PAIRS} WHERE support >= {SUPPORT})"
RULES = f"""(WITH i AS MATERIALIZED (SELECT * FROM {ITEMSETS}), parts AS (
SELECT support, list_filter(items, lambda x, j: (mask >> (j - 1)) & 1 = 1) AS antecedent,
list_filter(items, lambda x, j: (mask >> (j - 1)) & 1 = 0) AS consequent
FROM i, range(1, 7) r(mask) WHERE len(items) >= 2 AND mask <= (1 << len(items)) - 2)
SELECT antecedent, consequent, round(p.support, 6) AS support, round(p.support / a.support, 6) AS confidence,
round(p.support / a.support / c.support, 6) AS lift FROM parts p JOIN i a ON a.items = antecedent JOIN i c ON c.items = consequent
WHERE p.support / a.support >= {CONFIDENCE} AND p.support / a.support / c.support >= {LIFT})"""
_TEXT = "array_to_string(antecedent, ' + ') AS antecedent, array_to_string(consequent, ' + ') AS consequent"


def rules(spark, sf):
    return A.mine_rules(baskets(spark, sf), min_support=SUPPORT, min_confidence=CONFIDENCE, min_lift=LIFT)


def texts(df):
    return df.withColumns({c: join_items(F.col(c)) for c in ("antecedent", "consequent")})


@query("baskets_from_wide", f"""SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter([
CASE WHEN {unit_hash_sql('o_orderkey', seed=11)} > 0.3 THEN o_orderstatus END,
CASE WHEN {unit_hash_sql('o_orderkey', seed=12)} > 0.3 THEN o_orderpriority END], lambda x: x IS NOT NULL))), ' + ') AS items
FROM orders WHERE {unit_hash_sql('o_orderkey', seed=11)} > 0.3 OR {unit_hash_sql('o_orderkey', seed=12)} > 0.3""")
def baskets_from_wide(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(unit_hash("o_orderkey", seed=11) > 0.3, F.col("o_orderstatus")).alias("a"),
        F.when(unit_hash("o_orderkey", seed=12) > 0.3, F.col("o_orderpriority")).alias("b"))
    wide = A.baskets_from_wide(o, ["a", "b"])
    return wide.select("o_orderkey", join_items(F.col("items")).alias("items"))


ITEM_FREQUENCY = f"""SELECT item, count(*) AS count, round(count(*) / (SELECT count(DISTINCT basket) FROM {B}), 4) AS frequency FROM {B} GROUP BY 1"""
BASKET_SIZES = f"SELECT size, count(*) AS baskets FROM (SELECT count(*) AS size FROM {B} GROUP BY basket) GROUP BY 1"


@query("item_frequency", ITEM_FREQUENCY)
def item_frequency(spark, sf):
    return A.item_frequency(baskets(spark, sf))


@query("basket_sizes", BASKET_SIZES)
def basket_sizes(spark, sf):
    return A.basket_sizes(baskets(spark, sf))


@query("association_report", f"""SELECT 'item_frequency' AS part, item AS a, count::DOUBLE AS value FROM ({ITEM_FREQUENCY})
UNION ALL SELECT 'basket_sizes', size::VARCHAR, baskets::DOUBLE FROM ({BASKET_SIZES})""")
def association_report(spark, sf):
    from tabloom.operators.reports import long_report
    return long_report(A.association_report(baskets(spark, sf)), {
        "item_frequency": ("item_frequency", "item", None, "count"),
        "basket_sizes": ("basket_sizes", "size", None, "baskets"),
    }).drop("b")


@query("mine_itemsets", f"SELECT array_to_string(items, ' + ') AS items, len(items)::INTEGER AS size, round(support, 6) AS support FROM {ITEMSETS}")
def mine_itemsets(spark, sf):
    found = A.mine_itemsets(baskets(spark, sf), SUPPORT)
    return found.select(join_items(F.col("items")).alias("items"), F.size("items").alias("size"),
                        F.round("support", 6).alias("support"))


@query("join_subset", f"""WITH b AS MATERIALIZED (SELECT * FROM {B}), n AS (SELECT count(DISTINCT basket) AS n FROM b)
SELECT x.item AS a, y.item AS b, count(*) AS baskets FROM b x JOIN b y USING (basket), n WHERE x.item < y.item
GROUP BY 1, 2 HAVING count(*) / any_value(n) >= {SUPPORT}""")
def join_subset(spark, sf):
    b = baskets(spark, sf)
    pairs = A.mine_itemsets(b, SUPPORT, max_len=2).filter(F.size("items") == 2)
    n = b.select("basket").distinct().count()
    return pairs.select(F.col("items")[0].alias("a"), F.col("items")[1].alias("b"),
                        F.round(F.col("support") * n).cast("long").alias("baskets"))


@query("mine_rules", f"SELECT {_TEXT}, support, confidence, round(lift + 1e-8, 4) AS lift FROM {RULES}")
def mine_rules(spark, sf):
    return texts(rules(spark, sf)).withColumn("lift", F.round(F.col("lift") + 1e-8, 4))


@query("rule_order", f"SELECT {_TEXT}, support, confidence, round(lift + 1e-8, 4) AS lift FROM {RULES}")
def rule_order(spark, sf):
    return texts(A.order_rules(rules(spark, sf))).withColumn("lift", F.round(F.col("lift") + 1e-8, 4))


@query("filter_rules", f"SELECT {_TEXT}, support, confidence, lift FROM {RULES} WHERE support >= 0.004 AND confidence >= 0.18 AND lift >= 1.05")
def filter_rules(spark, sf):
    return texts(A.filter_rules(rules(spark, sf), min_support=0.004, min_confidence=0.18, min_lift=1.05))


@query("rule_stats", f"SELECT round(avg(support), 6) AS support, round(avg(confidence), 6) AS confidence, round(avg(lift), 6) AS lift FROM {RULES}")
def rule_stats(spark, sf):
    return A.rule_stats(rules(spark, sf))


@query("rule_nodes", f"SELECT DISTINCT unnest(list_concat(antecedent, consequent)) AS item FROM {RULES}")
def rule_nodes(spark, sf):
    return A.rule_nodes(rules(spark, sf))


_MATCH = f"""(WITH b AS MATERIALIZED (SELECT * FROM {B}), h AS (SELECT basket, list(item) AS held FROM b GROUP BY 1),
u AS MATERIALIZED (SELECT * FROM {RULES})
SELECT basket, held, u.* FROM h JOIN u ON list_has_all(held, antecedent))"""


@query("join_rule_basket", f"""SELECT basket, array_to_string(antecedent, ' + ') || ' => ' || array_to_string(consequent, ' + ') AS rule, round(lift + 1e-8, 4) AS lift FROM {_MATCH}""")
def join_rule_basket(spark, sf):
    found = A.matching_rules(baskets(spark, sf), cut(rules(spark, sf)))
    return found.select("basket", rule_text(F.col("antecedent"), F.col("consequent")).alias("rule"),
                        F.round(F.col("lift") + 1e-8, 4).alias("lift"))


_CAND = f"""(SELECT basket, item, max(score) AS score FROM (SELECT basket, held, unnest(consequent) AS item,
round(lift * confidence, 6) AS score FROM {_MATCH}) WHERE NOT list_contains(held, item) GROUP BY 1, 2)"""
_TOP = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY basket ORDER BY score DESC, item) AS place FROM {_CAND}) WHERE place <= 5)"


def recommended(spark, sf):
    return A.recommend(baskets(spark, sf), cut(rules(spark, sf)))


@query("top_recommend", f"SELECT basket, item, score, place::INTEGER AS place FROM {_TOP}")
def top_recommend(spark, sf):
    return recommended(spark, sf).select("basket", "item", "score", "place")


@query("recommend", f"SELECT basket, string_agg(item, ', ' ORDER BY place) AS items FROM {_TOP} GROUP BY 1")
def recommend(spark, sf):
    return A.recommended_text(recommended(spark, sf))


_ORDER = "ORDER BY lift DESC, confidence DESC, support DESC, antecedent, consequent"


@query("explain_rules", f"""WITH u AS MATERIALIZED (SELECT * FROM {RULES})
SELECT 'edge' AS part, array_to_string(antecedent, ' + ') AS a, array_to_string(consequent, ' + ') AS b, lift AS value FROM u
UNION ALL SELECT 'table', array_to_string(antecedent, ' + '), array_to_string(consequent, ' + '), support FROM u
UNION ALL SELECT 'point', array_to_string(antecedent, ' + ') || ' => ' || array_to_string(consequent, ' + '), '', confidence FROM u""")
def explain_rules(spark, sf):
    from tabloom.operators.reports import long_report
    return long_report(A.explain_rules(cut(rules(spark, sf))), {
        "edge": ("edges", "source", "target", "lift"), "table": ("table", "antecedent", "consequent", "support"),
        "point": ("points", "rule", None, "confidence"),
    })
