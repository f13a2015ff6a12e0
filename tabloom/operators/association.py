"""Frequent itemsets, association rules and recommendations.

A basket table is long: one row per (basket, item)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions.scalar import is_missing, join_items, rule_text
from tabloom.operators.profile import type_of
from tabloom.operators.store import Parts, TableModel
from tabloom.session import cut, stored

MAX_LEN = 3
BROADCAST_RULES = 100_000
#: An item in more baskets than this is split into parts when it is not joined by broadcast.
HEAVY_BASKETS, MAX_PARTS = 1_000_000, 10_000


def baskets_from_wide(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`items`: the distinct non-missing cells of each row as text; empty rows are dropped."""
    cells = F.array(*[
        F.when(~is_missing(F.col(f"`{c}`"), type_of(df, c)), F.col(f"`{c}`").cast("string"))
        for c in columns
    ])
    items = F.array_distinct(F.array_compact(cells))
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, items.alias("items")).filter(F.size("items") > 0)


def baskets_from_long(df: DataFrame, basket: str, item: str) -> DataFrame:
    """Distinct (basket, item) rows with the item as text."""
    return (
        df.select(F.col(basket).alias("basket"), F.col(item).cast("string").alias("item"))
        .na.drop().dropDuplicates()
    )


def item_frequency(baskets: DataFrame) -> DataFrame:
    """Baskets per item and their share."""
    total = baskets.select("basket").distinct().count() or 1
    return baskets.groupBy("item").agg(F.count("*").alias("count")).withColumn(
        "frequency", F.round(F.col("count") / F.lit(total), 4)
    )


def basket_sizes(baskets: DataFrame) -> DataFrame:
    """How many baskets hold how many items."""
    sizes = baskets.groupBy("basket").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("baskets"))


def _needed(n: int, support: float) -> int:
    """Smallest count whose share of n reaches the support."""
    count = max(1, int(support * n))
    while count / n < support:
        count += 1
    while count > 1 and (count - 1) / n >= support:
        count -= 1
    return count


def mine_itemsets(baskets: DataFrame, min_support: float, *, max_len: int = MAX_LEN) -> DataFrame:
    """(items, support): sorted itemsets up to `max_len` items, level by level.

    The rows are shuffled once, into one array of items per basket. Infrequent items leave first; a
    basket becomes the array of its frequent item codes, stored once. Per
    level the frequent sets of the level before go to the tasks as a prefix tree, whose siblings are the
    candidates; a task counts them in bitmaps of baskets, a block at a time, and sends one count per
    candidate that it met. Frequent sets of k items number at most the mean of (size over k) over baskets
    divided by the support, whatever the number of baskets, so they may be held in one place."""
    rows = baskets.groupBy("basket").agg(F.collect_set("item").alias("items")).persist()
    try:
        return _mined(rows, min_support, max_len)
    finally:
        rows.unpersist()


def _coded(baskets: DataFrame, names: Sequence[str]) -> DataFrame:
    """The codes of the frequent items of each basket that has more than one."""
    shared = baskets.sparkSession.sparkContext.broadcast(list(names))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for batch in batches:
            lists = batch.column(0)
            codes = pc.index_in(lists.flatten().cast(pa.string()), value_set=known)
            kept = codes.is_valid().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())[kept]
            sizes = np.bincount(owner, minlength=len(lists))
            many = sizes > 1
            flat = codes.drop_null().to_numpy()[many[owner]]
            ends = np.concatenate(([0], np.cumsum(sizes[many]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))], ["codes"])

    return baskets.select("items").mapInArrow(code, "codes array<int>")


def _mined(baskets: DataFrame, min_support: float, max_len: int) -> DataFrame:
    spark = baskets.sparkSession
    n = baskets.count()
    schema = "items array<string>, support double"
    if not n:
        return spark.createDataFrame([], schema)
    need = _needed(n, min_support)
    counted = baskets.select(F.explode("items").alias("item")).groupBy("item").count().filter(F.col("count") >= need).collect()
    found = {r["item"]: r["count"] for r in counted}
    names = sorted(found)
    counts = [((i,), found[name]) for i, name in enumerate(names)]
    if len(names) > 1 and max_len > 1:
        blocks = cut(_coded(baskets, names))
        level = [sets for sets, _ in counts]
        for _ in range(2, max_len + 1):
            grown = _grown(blocks, level, len(names), need)
            level = [sets for sets, _ in grown]
            counts += grown
            if len(level) < 2:
                break
    return spark.createDataFrame([([names[i] for i in sets], c / n) for sets, c in counts], schema)


def _grown(blocks: DataFrame, level: list[tuple[int, ...]], width: int, need: int) -> list[tuple[tuple[int, ...], int]]:
    """The frequent sets with one item more than those of `level`, and their counts."""
    tree: dict[tuple[int, ...], list[int]] = {}
    for sets in sorted(level):
        tree.setdefault(sets[:-1], []).append(sets[-1])
    tree = {prefix: last for prefix, last in tree.items() if len(last) > 1}
    first = np.cumsum([0, *[len(last) * (len(last) - 1) // 2 for last in tree.values()]])
    if not first[-1]:
        return []
    shared = blocks.sparkSession.sparkContext.broadcast([
        (prefix, np.array(last)) for prefix, last in tree.items()])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(first[-1], np.int64)
        for batch in batches:
            lists = batch.column(0)
            rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            bits = np.zeros((width, -(-len(lists) // 64) * 64), bool)
            bits[lists.flatten().to_numpy(), rows] = True
            bits = np.packbits(bits, axis=1).view(np.uint64)
            for at, (prefix, last) in zip(first, shared.value):
                both = bits[last]
                for item in prefix:
                    both = both & bits[item]
                for i in range(len(last) - 1):
                    more = len(last) - 1 - i
                    totals[at:at + more] += np.bitwise_count(both[i] & both[i + 1:]).sum(axis=1, dtype=np.int64)
                    at += more
        met = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(totals[met])], ["at", "n"])

    summed = blocks.mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    counts = {r["at"]: r["n"] for r in summed.filter(F.col("n") >= need).collect()}
    pairs = ((prefix, a, b) for prefix, last in tree.items() for i, a in enumerate(last) for b in last[i + 1:])
    return [((*prefix, a, b), counts[at]) for at, (prefix, a, b) in enumerate(pairs) if at in counts]


def mine_rules(
    baskets: DataFrame, *, min_support: float = 0.1, min_confidence: float = 0.3,
    min_lift: float = 1.0, max_len: int = MAX_LEN,
) -> DataFrame:
    """Rules with any split of a frequent itemset into antecedent and consequent."""
    itemsets = cut(mine_itemsets(baskets, min_support, max_len=max_len))
    size = F.size("items")
    masks = F.explode(F.sequence(F.lit(1), (F.pow(F.lit(2.0), size) - 2).cast("int")))
    parts = itemsets.filter(size >= 2).withColumn("mask", masks).select(
        "support",
        F.expr("filter(items, (x, i) -> (shiftright(mask, i) & 1) = 1)").alias("antecedent"),
        F.expr("filter(items, (x, i) -> (shiftright(mask, i) & 1) = 0)").alias("consequent"),
    )
    known = lambda side: itemsets.select(
        F.col("items").alias(side), F.col("support").alias(f"{side}_support")
    )
    rules = parts.join(known("antecedent"), "antecedent").join(known("consequent"), "consequent")
    confidence = F.col("support") / F.col("antecedent_support")
    scored = rules.withColumn("confidence", confidence).withColumn(
        "lift", F.col("confidence") / F.col("consequent_support")
    )
    return scored.filter((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift)).select(
        "antecedent", "consequent",
        *[F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")],
    )


def order_rules(rules: DataFrame) -> DataFrame:
    """Best first: lift, confidence, support, then the items."""
    return rules.orderBy(
        F.desc("lift"), F.desc("confidence"), F.desc("support"), "antecedent", "consequent"
    )


def filter_rules(
    rules: DataFrame, *, min_support: float = 0.0, min_confidence: float = 0.0, min_lift: float = 0.0
) -> DataFrame:
    return rules.filter(
        (F.col("support") >= min_support) & (F.col("confidence") >= min_confidence)
        & (F.col("lift") >= min_lift)
    )


def rule_stats(rules: DataFrame) -> DataFrame:
    """Mean support, confidence and lift; zeros for an empty rule set."""
    return rules.agg(*[
        F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in ("support", "confidence", "lift")
    ])


def rule_nodes(rules: DataFrame) -> DataFrame:
    offered = "consequent" if "consequent" in rules.columns else F.array("item")
    items = F.explode(F.array_union("antecedent", offered))
    return rules.select(items.alias("item")).distinct()


def _indexed(baskets: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Baskets with the rule items they hold, and the rules under their rarest antecedent item, `lead`.
    Where the rules are too many to broadcast, leads that are in many baskets are split by a hash of
    the basket: `part` of a basket is one of the parts of the lead."""
    usable = rules.filter(F.size("antecedent") > 0)
    nodes = rule_nodes(usable)
    few = nodes.count() <= BROADCAST_RULES
    known = baskets.join(F.broadcast(nodes) if few else nodes, "item")
    held = stored(known.groupBy("basket").agg(F.collect_set("item").alias("held")))
    seen = held.select(F.explode("held").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    numbered = usable.withColumn("__rule", F.monotonically_increasing_id())
    sought = numbered.select("__rule", F.explode("antecedent").alias("item")).join(F.broadcast(seen) if few else seen, "item", "left")
    rarest = sought.groupBy("__rule").agg(F.min_by("item", F.struct(F.coalesce("n", F.lit(0)), "item")).alias("lead"))
    return held, numbered.join(rarest, "__rule").drop("__rule")


def _met(baskets: DataFrame, rules: DataFrame) -> DataFrame:
    """(basket, held, rule columns) of rules whose whole antecedent is in the basket. `rules` must not
    change between scans."""
    held, index = _indexed(baskets, rules)
    if rules.count() <= BROADCAST_RULES:
        met = held.withColumn("lead", F.explode("held")).join(F.broadcast(index), "lead")
    else:
        many = held.withColumn("lead", F.explode("held"))
        heavy = many.groupBy("lead").agg(F.count("*").alias("n")).filter(F.col("n") > HEAVY_BASKETS)
        heavy = heavy.select("lead", F.least(F.ceil(F.col("n") / HEAVY_BASKETS), F.lit(MAX_PARTS)).cast("int").alias("parts"))
        split = lambda df: df.join(F.broadcast(heavy), "lead", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        left = split(many).withColumn("part", F.pmod(F.xxhash64("basket"), F.col("parts")).cast("int")).drop("parts")
        right = split(index).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        met = left.join(right, ["lead", "part"]).drop("part")
    whole = (F.size("antecedent") == 1) | (F.size(F.array_except("antecedent", "held")) == 0)
    return met.filter(whole).drop("lead")


def matching_rules(baskets: DataFrame, rules: DataFrame) -> DataFrame:
    """(basket, held, rule columns) for every rule whose whole antecedent is in the basket.
    Only items that occur in a rule are collected, so `held` is no longer than the rule
    vocabulary; a basket meets a rule through the rarest item of its antecedent."""
    return _met(baskets, cut(rules))


def _score(lift: str = "lift", confidence: str = "confidence") -> Column:
    return F.round(F.col(lift) * F.col(confidence), 6)


def recommend(baskets: DataFrame, rules: DataFrame, *, top: int = 5) -> DataFrame:
    """The best rule per candidate item and the `top` items per basket. A basket has at most
    as many candidates as there are distinct consequent items. Every (rule, offered item) is numbered
    once, best first, so that baskets compare numbers, not rules."""
    offers = rules.withColumn("item", F.explode("consequent")).withColumn("score", _score()).withColumn(
        "rule", F.concat_ws(" => ", join_items(F.col("antecedent")), F.col("item")))
    best_first = [F.desc(c) for c in ("score", "lift", "confidence", "support", "rule")]
    offers = cut(offers.orderBy(*best_first).withColumn("rank", F.monotonically_increasing_id()))
    met = _met(baskets, offers.select("antecedent", "item", "rank"))
    new = met.filter(~F.array_contains("held", F.col("item")))
    best = new.groupBy("basket", "item").agg(F.min("rank").alias("rank"))
    told = offers.select("rank", "score", "lift", "confidence", "support", "rule")
    best = best.join(F.broadcast(told) if offers.count() <= BROADCAST_RULES else told, "rank")
    w = Window.partitionBy("basket").orderBy(F.desc("score"), "item")
    ranked = best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)
    return ranked.select("basket", "item", "score", "lift", "confidence", "support", "rule", "place")


def recommended_text(recommended: DataFrame) -> DataFrame:
    """One comma-separated text per basket, best item first."""
    return recommended.groupBy("basket").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("place", "item"))), lambda r: r["item"]
    ), ", ").alias("items"))


def explain_rules(rules: DataFrame) -> dict[str, DataFrame]:
    """Rule network, lift/confidence points and rule table, all rules in rule order."""
    names = [join_items(F.col("antecedent")), join_items(F.col("consequent"))]
    best = order_rules(rules)
    return {
        "nodes": rule_nodes(rules),
        "edges": best.select(
            names[0].alias("source"), names[1].alias("target"), "lift", "confidence"),
        "points": rules.select(
            "confidence", "lift", "support", rule_text(F.col("antecedent"), F.col("consequent")).alias("rule")),
        "table": best.select(
            names[0].alias("antecedent"), names[1].alias("consequent"), "support", "confidence", "lift"),
    }


def association_report(baskets: DataFrame) -> dict[str, DataFrame]:
    return {"item_frequency": item_frequency(baskets), "basket_sizes": basket_sizes(baskets)}


def item_rows(df: DataFrame, key: str, columns: Sequence[str], *, distinct: bool = True) -> DataFrame:
    """(basket, item) rows of a table with one basket per row: cells are items, a cell that holds
    an array holds several. Mining takes repeated rows as well."""
    lists = [c for c in columns if type_of(df, c) == "array"]
    wide = df.select(F.col(f"`{key}`").alias("basket"), *[F.col(f"`{c}`") for c in columns])
    single = [c for c in columns if c not in lists]
    parts = [wide.select("basket", F.explode(F.col(f"`{c}`").cast("array<string>")).alias("item")) for c in lists]
    if single:
        parts.append(baskets_from_wide(wide.select("basket", *[F.col(f"`{c}`") for c in single]), single)
                     .select("basket", F.explode("items").alias("item")))
    rows = reduce(DataFrame.unionByName, parts).na.drop()
    return rows.dropDuplicates() if distinct else rows


@dataclass(frozen=True)
class RuleModel(TableModel):
    """Mined rules; it recommends items for baskets."""

    rules: DataFrame
    columns: tuple[str, ...]

    def parts(self, spark: SparkSession) -> Parts:
        return Parts({"rules": self.rules}, {}, {"columns": list(self.columns)})

    @classmethod
    def of(cls, parts: Parts) -> RuleModel:
        return cls(parts.tables["rules"], tuple(parts.values["columns"]))

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        """Adds the best five items that the basket does not hold, as one text; empty where there is none."""
        told = recommended_text(recommend(item_rows(df, key, self.columns), self.rules))
        told = told.select(F.col("basket").alias("__basket"), F.col("items").alias("__items"))
        return df.join(told, df[key].eqNullSafe(told["__basket"]), "left").select(
            *[F.col(f"`{c}`") for c in df.columns], F.coalesce("__items", F.lit("")).alias("prediction"))


def fit_rules(df: DataFrame, key: str, columns: Sequence[str], params: Mapping[str, Any]) -> RuleModel:
    rules = mine_rules(item_rows(df, key, columns, distinct=False), **params)
    return RuleModel(cut(rules), tuple(columns))
