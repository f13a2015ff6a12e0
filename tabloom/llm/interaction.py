"""How filters act on one another: what each removes alone, after others, and in fairness.

Every document gets a bit mask of the filters that it fails. Rows are summed by part and mask
before anything else, so a part that holds most rows is a few numbers per task. From the masks of
a part come the removals of all 2 ** k coalitions (documents that fail at least one member);
differences of coalitions are the counts of every step of every order, and a constrained least
squares fit over the coalitions gives each filter's fair share (Shapley value) in exact rationals.

Defined cases: a null text is empty, a null part is the empty string; rows count one by one, also
where they repeat; a null id is neither smaller nor larger than another id; rows with the same id
and text are no copies of each other; of several labels of one id any 1 counts; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

#: The heuristic filters, by bit: short, repetitive, shouting, markup, copy of an earlier document.
LETTERS = "ABCDE"
COPY = 1 << 4
MIN_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 50, 65, 5
CAPITALS, MARKS = bytes(range(0x41, 0x5B)), b"#$%&*|"
CONTINUED = bytes(range(0x80, 0xC0))


def text_mask(text: bytes) -> int:
    """Bits of the filters that look at one text only."""
    words = text.split()  # splits at the bytes 09-0D and 20
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, CONTINUED))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < DISTINCT_SHARE * len(words)) << 1
        | (100 * capitals > CAPITAL_SHARE * points) << 2
        | (len(text.translate(None, MARKS)) < len(text)) << 3
    )


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             part_col: str = "source") -> DataFrame:
    """One row per id, text and part: id, part, mask of the failed filters, and number of rows.
    Texts leave their task as digests only."""
    kind = docs.schema[id_col].dataType

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for value in batch.column("text"):
                text = value.as_py()
                masks.append(text_mask(text))
                digests.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
                ["id", "part", "mask", "digest"])

    seen = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        as_bytes(text_col).alias("text"),
    ).mapInArrow(look, f"id {kind.simpleString()}, part string, mask int, digest binary")
    # the id is part of every key below, so that a text with very many copies stays spread
    rows = seen.groupBy("id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).where(F.col("id").isNotNull())
    first = first.withColumn("first", F.lit(True))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["digest", "id"], "left").select(
        "id", "part", F.when(copy, F.col("mask").bitwiseOR(COPY)).otherwise(F.col("mask")).alias("mask"), "n")


def shares(gains: list[int], k: int) -> list[Fraction]:
    """The additive shares that fit the coalition values best under the Shapley kernel and add up
    to the value of the full coalition: normal equations with one multiplier, solved in rationals."""
    full = (1 << k) - 1
    if k == 1:
        return [Fraction(gains[full])]
    grid = [[Fraction(0)] * (k + 2) for _ in range(k + 1)]
    for coalition in range(1, full):
        size = coalition.bit_count()
        weight = Fraction(k - 1, math.comb(k, size) * size * (k - size))
        members = [i for i in range(k) if coalition >> i & 1]
        for i in members:
            for j in members:
                grid[i][j] += weight
            grid[i][-1] += weight * gains[coalition]
    for i in range(k):
        grid[i][k] = grid[k][i] = Fraction(1)
    grid[k][-1] = Fraction(gains[full])
    for i in range(k + 1):
        lead = next(r for r in range(i, k + 1) if grid[r][i])
        grid[i], grid[lead] = grid[lead], grid[i]
        grid[i] = [x / grid[i][i] for x in grid[i]]
        for r in range(k + 1):
            if r != i and grid[r][i]:
                grid[r] = [x - grid[r][i] * y for x, y in zip(grid[r], grid[i], strict=True)]
    return [grid[i][-1] for i in range(k)]


def coalition_values(cells: list[tuple[int, int]], k: int) -> list[int]:
    """Removals of every coalition, from (mask, count) cells."""
    return [sum(n for mask, n in cells if mask & s) for s in range(1 << k)]


def interactions(masks: DataFrame, letters: str, outcomes: tuple[str, ...] = ()) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, one loss per
    outcome column, and `shapley`, the filter's share times the number of orders. `masks` has part,
    mask and the counts n and outcomes; `letters` names the filters by bit."""
    k = len(letters)
    names = ["n", *outcomes]
    sums = masks.groupBy("part", "mask").agg(*[F.sum(c).cast("bigint").alias(c) for c in names])
    cells = sums.groupBy("part").agg(F.collect_list(F.struct("mask", *names)).alias("cells"))
    columns = ["kept", "removed", "redundant", "unique_fails", *[f"{c}_lost" for c in outcomes], "shapley"]
    orders = list(itertools.permutations(range(k)))
    labels = ["".join(letters[i] for i in order) for order in orders for _ in order]
    steps = list(range(1, k + 1)) * len(orders)

    def report(part: str, rows: list[dict]) -> pa.RecordBatch:
        gains = {c: coalition_values([(r["mask"], r[c]) for r in rows], k) for c in names}
        total, all_of, v = sum(r["n"] for r in rows), (1 << k) - 1, gains["n"]
        fair = [x * math.factorial(k) for x in shares(v, k)]
        out: dict[str, list[int]] = {c: [] for c in columns}
        for order in orders:
            before = 0
            for i in order:
                after = before | 1 << i
                here = v[after] - v[before]
                values = [total - v[after], here, v[1 << i] - here, v[all_of] - v[all_of ^ 1 << i],
                          *[gains[c][after] - gains[c][before] for c in outcomes], int(fair[i])]
                for c, x in zip(columns, values, strict=True):
                    out[c].append(x)
                before = after
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(steps)), pa.array(labels), pa.array(steps, pa.int32()),
             *[pa.array(out[c], pa.int64()) for c in columns]],
            ["part", "filter_order", "step", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield report(row["part"], row["cells"])

    kinds = ", ".join(f"{c} bigint" for c in columns)
    return cells.mapInArrow(run, f"part string, filter_order string, step int, {kinds}")


def with_outcomes(rows: DataFrame, labels: DataFrame, outcomes: dict[str, str],
                  id_col: str = "doc_id") -> DataFrame:
    """Add, per outcome, the rows whose id is labelled 1 in the given column."""
    known = labels.groupBy(F.col(f"`{id_col}`").alias("id")).agg(
        *[F.max((F.col(f"`{c}`") == 1).cast("bigint")).alias(out) for out, c in outcomes.items()])
    return rows.join(known, "id", "left").withColumns(
        {out: F.coalesce(F.col(out), F.lit(0)) * F.col("n") for out in outcomes})


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The heuristic filters on documents, with the labelled good and toxic rows that they lose."""
    rows = with_outcomes(failures(docs), labels, {"good": "quality", "toxic": "toxic"})
    return interactions(rows, LETTERS, ("good", "toxic"))
