"""Exact quantiles (linear interpolation) whose memory does not grow with the data."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.prefix import prefix_sums

EXACT_ROWS = 250_000
EXACT_TOTAL = 2_000_000
#: Bins of a range in one pass (a power of two), and values of a range that are fetched.
BIN_BITS, FEW = 11, 1000


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    *,
    exact_rows: int = EXACT_ROWS,
) -> dict[str, list[float | None]]:
    """Quantiles of several columns, missing values ignored.

    Up to `exact_rows` values the exact aggregate is used. Beyond, each wanted order statistic is
    enclosed in narrower and narrower ranges by counting the values of their bins. Every pass is
    one count for all columns without a shuffle of rows."""
    columns = list(columns)
    if not columns:
        return {}
    exact_rows = min(exact_rows, max(1, EXACT_TOTAL // len(columns)))
    values = df.selectExpr(*[f"{_value_text(c)} AS v{i}" for i, c in enumerate(columns)])
    sizes = values.selectExpr(*[f"count(v{i}) AS n{i}" for i in range(len(columns))]).first()
    out: dict[str, list[float | None]] = {}
    small = [i for i in range(len(columns)) if 0 < sizes[i] <= exact_rows]
    large = [i for i in range(len(columns)) if sizes[i] > exact_rows]
    if small:
        wanted = ", ".join(f"{float(p)!r}D" for p in probs)
        row = values.selectExpr(*[f"percentile(v{i}, array({wanted})) AS q{i}" for i in small]).first()
        for at, i in enumerate(small):
            out[columns[i]] = [float(v) for v in row[at]]
    if large:
        ranks = {(i, k) for i in large for p in probs for k in _around(sizes[i], p)}
        found = _order_statistics(values, {i: sizes[i] for i in large}, sorted(ranks), exact_rows)
        for i in large:
            picked = []
            for p in probs:
                low, high = _around(sizes[i], p)
                share = (sizes[i] - 1) * p - low
                a, b = found[(i, low)], found[(i, high)]
                picked.append(a if share == 0 else a + (b - a) * share)
            out[columns[i]] = picked
    for c in columns:
        out.setdefault(c, [None] * len(probs))
    return out


def kth_smallest(df: DataFrame, column: str, ranks: Sequence[int]) -> list[float]:
    """The values at the given zero-based ranks; missing values are not ranked."""
    values = df.select(_value(column).alias("v0"))
    n = values.agg(F.count("v0")).first()[0]
    found = _order_statistics(values, {0: n}, sorted({(0, k) for k in ranks}), EXACT_ROWS)
    return [found[(0, k)] for k in ranks]


def _value_text(c: str) -> str:
    x = f"CAST(`{c}` AS DOUBLE)"
    return f"CASE WHEN NOT isnan({x}) THEN {x} END"


def _value(c: str) -> Column:
    return F.expr(_value_text(c))


def _around(n: int, p: float) -> tuple[int, int]:
    low = math.floor((n - 1) * p)
    return low, min(low + 1, n - 1)


def _places(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles; both zeros are one."""
    bits = (np.asarray(x, float) + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def _value_at(place: int) -> float:
    bits = np.array([place], np.int64)
    return float((bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(float)[0])


def _cut(ranges: list[tuple[int, int, int]], batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Number of each range (column, lowest and highest place) and the offsets of the values inside it."""
    held: dict[int, np.ndarray] = {}
    for r, (i, low, high) in enumerate(ranges):
        if i not in held:
            held[i] = _places(batch.column(f"v{i}").drop_null().to_numpy()).view(np.uint64)
        offset = held[i] - np.uint64(low % 2**64)
        yield r, offset[offset <= np.uint64(high - low)]


def _shift(low: int, high: int) -> int:
    return max(0, (high - low).bit_length() - BIN_BITS)


def _bins(values: DataFrame, ranges: list[tuple[int, int, int]]) -> np.ndarray:
    """How many values lie in each of the equal bins of each range."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ranges), 1 << BIN_BITS), np.int64)
        for batch in batches:
            for r, offset in _cut(ranges, batch):
                bins = (offset >> np.uint64(_shift(*ranges[r][1:]))).astype(np.int64)
                total[r] += np.bincount(bins, minlength=1 << BIN_BITS)
        r, b = np.nonzero(total)
        yield pa.record_batch([pa.array(r), pa.array(b), pa.array(total[r, b])], ["r", "b", "n"])

    counted = values.mapInArrow(count, "r bigint, b bigint, n bigint").groupBy("r", "b").agg(F.sum("n").alias("n"))
    out = np.zeros((len(ranges), 1 << BIN_BITS), np.int64)
    for r, b, n in counted.collect():
        out[r, b] = n
    return out


def _offsets(values: DataFrame, ranges: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """The sorted offsets of the few values of each range."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, offset in _cut(ranges, batch):
                yield pa.record_batch([pa.array(np.full(len(offset), r)), pa.array(offset.view(np.int64))], ["r", "offset"])

    found: list[list[int]] = [[] for _ in ranges]
    for r, offset in values.mapInArrow(pick, "r bigint, offset bigint").collect():
        found[r].append(offset)
    return [np.sort(np.array(x, np.int64).view(np.uint64)) for x in found]


def _order_statistics(values, sizes, ranks, exact_rows):
    """Values at (column, rank). Doubles are placed on the integers in their order. A range of places with an open
    rank is cut into equal bins, tasks count the values of each, and the bin that holds the rank is the next range,
    until few values are left in it, which are fetched. A pass serves all columns."""
    columns = sorted({i for i, _ in ranks})
    values = values.select(*[f"v{i}" for i in columns])
    ends = values.selectExpr(*[f"{f}(v{i})" for i in columns for f in ("min", "max")]).first()
    ends = _places(np.array(ends, float)).reshape(-1, 2).tolist()
    # ranges: how many values they hold, and the ranks asked for with their place inside
    state = {(i, *ends[j]): (sizes[i], [(k, k) for c, k in ranks if c == i]) for j, i in enumerate(columns)}
    found: dict[tuple[int, int], float] = {}
    while state:
        for i, low, high in [r for r in state if r[1] == r[2]]:
            found |= {(i, k): _value_at(low) for k, _ in state.pop((i, low, high))[1]}
        many = [r for r, (n, _) in state.items() if n > min(FEW, exact_rows)]
        if not many:
            break
        for (i, low, high), counts in zip(many, _bins(values, many)):
            upto, width = np.cumsum(counts), 1 << _shift(low, high)
            for k, at in state.pop((i, low, high))[1]:
                b = int(np.searchsorted(upto, at, side="right"))
                inner = (i, low + b * width, min(high, low + (b + 1) * width - 1))
                state.setdefault(inner, (int(counts[b]), []))[1].append((k, int(at - (upto[b] - counts[b]))))
    rest = list(state)
    for (i, low, high), offsets in zip(rest, _offsets(values, rest) if rest else []):
        found |= {(i, k): _value_at(low + int(offsets[at])) for k, at in state[(i, low, high)][1]}
    return found


def grouped_quantiles(
    df: DataFrame, by: Sequence[str], column: str, probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """One row per group with exact quantiles; a group may be of any size."""
    work = df.select(*by, _value(column).alias("__v")).filter(F.col("__v").isNotNull())
    distinct = work.groupBy(*by, "__v").agg(F.count("*").alias("__c"))
    placed = prefix_sums(
        distinct, "__v", {"__before": F.col("__c")}, by=by, totals={"__n": F.col("__c")}
    )
    holds = lambda at: (at >= F.col("__before")) & (at < F.col("__before") + F.col("__c"))
    aggs = []
    for p, name in zip(probs, names):
        at = (F.col("__n") - 1) * F.lit(float(p))
        low = F.floor(at)
        weight = F.when(holds(low), 1 - (at - low)).otherwise(0.0) + F.when(
            holds(low + 1), at - low
        ).otherwise(0.0)
        aggs.append(F.sum(F.col("__v") * weight).alias(name))
    return placed.groupBy(*by).agg(*aggs)
