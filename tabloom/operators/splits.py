"""Train/test splits and cross-validation folds as columns.

Randomness is a hash of the row key. Exact sizes come from order statistics of that hash:
a split is then one comparison per row, with no shuffle and no stored index lists."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.hashing import unit_hash
from tabloom.functions.prefix import prefix_sums, row_positions
from tabloom.functions.quantiles import kth_smallest
from tabloom.session import cut

TEST_SIZE = 0.2
FOLDS = 5
EXACT_GROUPS = 200


def _side(test: Column) -> Column:
    return F.when(test, "test").otherwise("train")


def _cuts(df: DataFrame, keys: Sequence[str], seed: int | str, ranks: Sequence[int]) -> list[float]:
    hashed = df.select(unit_hash(*keys, seed=seed).alias("h")).persist()  # each row is hashed once
    try:
        return kth_smallest(hashed, "h", ranks)
    finally:
        hashed.unpersist()


def split_none(df: DataFrame) -> DataFrame:
    return df.withColumn("split", F.lit("train"))


def split_random(df: DataFrame, key: str, *, test_size: float = TEST_SIZE, seed: int = 0) -> DataFrame:
    """ceil(test_size * rows) test rows: those with the smallest hashes."""
    held = math.ceil(df.count() * test_size)
    if held < 1:
        return split_none(df)
    (edge,) = _cuts(df, [key], seed, [held - 1])
    return df.withColumn("split", _side(unit_hash(key, seed=seed) <= edge))


def split_grouped(df: DataFrame, group: str, *, test_size: float = TEST_SIZE, seed: int = 0) -> DataFrame:
    """Whole groups on one side; ceil(test_size * groups) groups are test."""
    groups = df.select(group).distinct()
    held = math.ceil(groups.count() * test_size)
    (edge,) = _cuts(groups, [group], seed, [held - 1])
    return df.withColumn("split", _side(unit_hash(group, seed=seed) <= edge))


def split_stratified(
    df: DataFrame, key: str, label: str, *, test_size: float = TEST_SIZE, seed: int = 0
) -> DataFrame:
    """round(test_size * rows) test rows of every class."""
    placed = row_positions(
        df.withColumn("__h", unit_hash(key, seed=seed)), "__h", by=[label], tie=key,
        out="__pos", total="__n", uniform=True,
    )
    test = F.col("__pos") < F.round(F.col("__n") * test_size)
    return placed.withColumn("split", _side(test)).drop("__h", "__pos", "__n")


def split_chronological(
    df: DataFrame, time: str, key: str, *, test_size: float = TEST_SIZE
) -> DataFrame:
    """The earliest floor((1 - test_size) * rows) rows train, the rest test; equal times by key."""
    placed = row_positions(df, time, tie=key, out="__pos", total="__n")
    keep = F.least(F.floor(F.col("__n") * F.lit(1.0 - test_size)), F.col("__n") - 1)
    return placed.withColumn("split", _side(F.col("__pos") >= keep)).drop("__pos", "__n")


def cv_kfold(df: DataFrame, key: str, *, folds: int = FOLDS, seed: int = 0) -> DataFrame:
    """Folds of equal size (to one row) in hash order."""
    n = df.count()
    sizes = [n // folds + (1 if i < n % folds else 0) for i in range(folds)]
    ends = [sum(sizes[: i + 1]) - 1 for i in range(folds - 1)]
    h = unit_hash(key, seed=seed)
    fold = F.lit(0)
    for edge in _cuts(df, [key], seed, ends):
        fold = fold + (h > edge).cast("int")
    return df.withColumn("fold", fold)


def cv_stratified(df: DataFrame, key: str, label: str, *, folds: int = FOLDS, seed: int = 0) -> DataFrame:
    placed = row_positions(
        df.withColumn("__h", unit_hash(key, seed=seed)), "__h", by=[label], tie=key, out="__pos", uniform=True
    )
    return placed.withColumn("fold", (F.col("__pos") % folds).cast("int")).drop("__h", "__pos")


def cv_group(df: DataFrame, group: str, *, folds: int = FOLDS, seed: int = 0) -> DataFrame:
    """Groups never cross folds; folds are even in groups, not in rows."""
    return df.withColumn("fold", F.floor(unit_hash(group, seed=seed) * folds).cast("int"))


def cv_group_even(df: DataFrame, group: str, *, folds: int = FOLDS, seed: int = 0) -> DataFrame:
    """Groups never cross folds; folds are even in rows. Groups of more than 1 / EXACT_GROUPS of a fold (so
    at most folds * EXACT_GROUPS of them) are placed one by one, largest first, into the emptiest fold. The
    others follow in hash order and fill what the folds lack, so a border is off by less than one small
    group. A missing group is a group."""
    sizes = cut(df.groupBy(F.col(f"`{group}`").alias("__group")).agg(F.count("*").alias("__n")))
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    large = F.col("__n") > total / (folds * EXACT_GROUPS)
    loads, placed = [0] * folds, []
    for r in sizes.filter(large).orderBy(F.desc("__n"), "__group").collect():
        fold = loads.index(min(loads))
        loads[fold] += r["__n"]
        placed.append((r["__group"], fold))
    edges = _fill_edges(loads, total - sum(loads))
    rest = prefix_sums(sizes.filter(~large).withColumn("__h", unit_hash("__group", seed=seed)), "__h",
                       {"__before": F.col("__n")}, tie="__group", uniform=True)
    fold = sum(((F.col("__before") >= e).cast("int") for e in edges), F.lit(0))
    small = rest.select(F.col("__group").alias("__small"), fold.alias("__fold_small"))
    kind = sizes.schema["__group"].dataType.simpleString()
    first = df.sparkSession.createDataFrame(placed, f"__large {kind}, __fold_large int")
    own = F.col(f"`{group}`")
    out = df.join(F.broadcast(first), own.eqNullSafe(F.col("__large")), "left")
    out = out.join(small, own.eqNullSafe(F.col("__small")), "left")
    return out.withColumn("fold", F.coalesce("__fold_large", "__fold_small")).select(*df.columns, "fold")


def _fill_edges(loads: Sequence[int], rest: int) -> list[int]:
    """Where the running total of the other rows goes on to the next fold, when they fill the folds up
    to one level."""
    ordered, level = sorted(loads), 0.0
    for m in range(1, len(loads) + 1):
        level = (rest + sum(ordered[:m])) / m
        if m == len(loads) or level <= ordered[m]:
            break
    rooms = [max(0.0, level - n) for n in loads]
    return [math.floor(sum(rooms[: i + 1]) + 1e-6) for i in range(len(loads) - 1)]


def cv_time(df: DataFrame, time: str, key: str, *, folds: int = FOLDS) -> DataFrame:
    """Block 0 is the initial history; fold f validates block f and trains on blocks below."""
    placed = row_positions(df, time, tie=key, out="__pos", total="__n")
    size = F.floor(F.col("__n") / (folds + 1))
    first = F.col("__n") - size * folds
    block = F.when(F.col("__pos") < first, 0).otherwise(F.floor((F.col("__pos") - first) / size) + 1)
    return placed.withColumn("block", block.cast("int")).drop("__pos", "__n")


def cv_shuffle(
    df: DataFrame, key: str, *, repeats: int = FOLDS, train_size: float = 0.7, seed: int = 0
) -> DataFrame:
    """train_0 ...: membership of floor(train_size * rows) train rows in each repeat."""
    kept = math.floor(df.count() * train_size)
    out = {}
    for r in range(repeats):
        salt = f"{seed}:{r}"
        (edge,) = _cuts(df, [key], salt, [kept - 1])
        out[f"train_{r}"] = (unit_hash(key, seed=salt) <= edge).cast("int")
    return df.withColumns(out)


def backtest_cuts(
    sizes: DataFrame, n: str = "n", *, splits: int = 3, min_train: float = 0.4
) -> DataFrame:
    """One row per group and fold: rows before `train_end` train, rows up to `test_end` test.
    Groups that are too short get no fold."""
    first = F.greatest(F.lit(2), F.floor(F.col(n) * F.lit(min_train)))
    usable = F.col(n) - first
    size = F.greatest(F.lit(1), F.floor(usable / splits))
    cuts = sizes.filter((F.col(n) >= 4) & (usable >= splits)).withColumn(
        "fold", F.explode(F.expr(f"sequence(0, {splits - 1})"))
    )
    start = first + F.col("fold") * size
    end = F.when(F.col("fold") == splits - 1, F.col(n)).otherwise(start + size)
    return cuts.withColumns({"train_end": start.cast("long"), "test_end": end.cast("long")})


def validation_split(
    df: DataFrame, key: str, *, label: str | None = None, fraction: float = 0.1, seed: int = 0
) -> DataFrame:
    """Boolean `validation`. Every class (the whole table without a label) gives its quota,
    round(fraction * rows) but never its last row, in hash order of the key."""
    placed = row_positions(
        df.withColumn("__h", unit_hash(key, seed=seed)), "__h", by=[label] if label else [],
        tie=key, out="__pos", total="__n", uniform=True,
    )
    quota = F.least(F.round(F.col("__n") * fraction), F.col("__n") - 1)
    return placed.withColumn("validation", F.col("__pos") < quota).drop("__h", "__pos", "__n")
