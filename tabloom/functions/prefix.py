"""Running totals and row positions over an order, without a single-partition window.

The order column is cut into ranges at approximate quantiles; every quantile value also
gets a range of its own, so rows sharing one frequent value can be split further by the
tie-break column. Range totals (at most a few per shuffle partition) give each range its
offset, and an ordinary window inside the range does the rest. Ranges are computed from
values, so recomputing a lost partition gives the same layout.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_TIE_PARTS = 64
MAX_RANK_PARTS = 2_000
#: Rows of a task that ranks values, and ranges for it, several so that hashing deals them evenly.
RANK_ROWS, RANGES_OF_TASK = 250_000, 8
TREE_EDGES = 200
FEW_VALUES = 180
#: Sampled rows for one range of a string column, and the characters of an edge.
EDGE_SAMPLE, EDGE_CHARS = 40, 256


def order_number(df: DataFrame, name: str) -> Column | None:
    """The value as a number in its own exact type, or None where it is no number."""
    kind = df.schema[name].dataType.typeName()
    c = F.col(f"`{name}`")
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{name}`)")
    if kind == "date":
        return F.unix_date(c).cast("bigint")
    if kind in ("byte", "short", "integer", "long"):
        return c.cast("bigint")
    if kind == "decimal":
        return c
    if kind in ("float", "double"):
        return c.cast("double")
    return None


def _approx_edges(number: Column, parts: int) -> Column:
    shares = ", ".join(f"{i / parts!r}D" for i in range(1, parts))
    return F.percentile_approx(number, F.expr(f"array({shares})"), F.lit(max(1000, 20 * parts)))


def _apart(values: Sequence) -> list:
    """Sorted values that also differ as doubles."""
    return [v for _, v in sorted({float(v): v for v in values}.items())]


def _edges(df: DataFrame, numbers: Sequence[tuple[Column, int]]) -> list[list]:
    """Approximate quantile edges of several columns, in one pass."""
    cut_up = [i for i, (_, parts) in enumerate(numbers) if parts > 1]
    row = df.agg(*[_approx_edges(*numbers[i]) for i in cut_up]).first() if cut_up else []
    out: list[list] = [[] for _ in numbers]
    for i, found in zip(cut_up, row):
        out[i] = _apart(found or [])
    return out


def _search(edges: Sequence[float], low: int, high: int) -> str:
    """A balanced tree of comparisons: how many edges do not exceed the value."""
    if low == high:
        return str(low)
    mid = (low + high) // 2
    return f"IF(__x < {edges[mid]!r}D, {_search(edges, low, mid)}, {_search(edges, mid + 1, high)})"


def _literal(value) -> str:
    if isinstance(value, Decimal):
        return f"{value:f}BD"
    return f"{value}L" if isinstance(value, int) else f"{value!r}D"


def _tag(df: DataFrame, number: Column, edges: Sequence, out: str) -> DataFrame:
    """Range of a value: odd codes are open ranges between edges, even codes single edges. The
    edge is found among doubles; whether the value is the edge, or just beside it, is decided on the
    exact numbers."""
    if not edges:
        return df.withColumn(out, F.lit(1))
    rough = [float(e) for e in edges]
    with_x = df.withColumn("__n", number).withColumn("__x", F.col("__n").cast("double"))
    if len(edges) <= TREE_EDGES:
        placed = with_x.withColumn("__b", F.expr(_search(rough, 0, len(edges))))
    else:
        splits = [float("-inf"), *rough, float("inf")]
        placed = Bucketizer(splits=splits, inputCol="__x", outputCol="__b").transform(with_x)
    b = F.col("__b").cast("int")
    edge = F.element_at(F.expr(f"array({', '.join(map(_literal, edges))})"), F.greatest(b, F.lit(1)))
    code = (
        F.when(b == 0, 1).when(F.col("__n") < edge, 2 * b - 1).when(F.col("__n") == edge, 2 * b)
        .otherwise(2 * b + 1)
    )
    return placed.withColumn(out, code.cast("int")).drop("__n", "__x", "__b")


def _is_text(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() == "string"


def _text_edges(df: DataFrame, name: str, parts: int) -> list[str]:
    """Strings that cut the column into about `parts` ranges: every n-th string of a sorted hash sample of
    rows, in byte order. A string that fills a range of its own is among them; longer ones are cut to
    EDGE_CHARS, which still is a place in the order."""
    if parts < 2:
        return []
    place = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(F.substring(f"`{name}`", 1, EDGE_CHARS).alias("s"), place.alias("h")).filter(F.col("s").isNotNull())
    found = sorted((r["s"].encode() for r in rows.orderBy("h", "s").limit(EDGE_SAMPLE * parts).collect()))
    return [v.decode() for v in sorted({found[i * len(found) // parts] for i in range(1, parts)})] if found else []


def _below(value: Column, edges: Sequence[str], first: int) -> Column:
    """`first` and the number of edges that do not exceed the value, by a balanced tree."""
    if not edges:
        return F.lit(first)
    mid = len(edges) // 2
    return F.when(value < F.lit(edges[mid]), _below(value, edges[:mid], first)).otherwise(
        _below(value, edges[mid + 1 :], first + mid + 1))


def _tag_text(df: DataFrame, name: str, edges: Sequence[str], out: str) -> DataFrame:
    """Range of a string, coded as in `_tag`. Many edges are searched in two steps, so that a row
    is compared with a few of them."""
    if not edges:
        return df.withColumn(out, F.lit(1))
    value = F.col(f"`{name}`")
    if len(edges) <= TREE_EDGES:
        b, last = _below(value, edges, 0), F.array(*map(F.lit, edges))
        placed = df.withColumn("__b", b).withColumn("__edge", F.element_at(last, F.greatest("__b", F.lit(1))))
    else:
        step = math.ceil(math.sqrt(len(edges)))
        groups = [list(edges[i : i + step]) for i in range(0, len(edges), step)]
        chosen = _below(value, [g[0] for g in groups], 0)
        table = F.array(*[F.array(*map(F.lit, g)) for g in groups])
        placed = df.withColumn("__g", chosen).withColumn("__of", F.element_at(table, F.greatest("__g", F.lit(1))))
        inside = F.size(F.filter("__of", lambda e: e <= value))
        placed = placed.withColumn("__b", F.when(F.col("__g") == 0, 0).otherwise((F.col("__g") - 1) * step + inside))
        placed = placed.withColumn("__edge", F.element_at("__of", F.greatest(inside, F.lit(1)))).drop("__g", "__of")
    b = F.col("__b").cast("int")
    code = F.when(value.isNull(), 0).when(b == 0, 1).when(value == F.col("__edge"), 2 * b).otherwise(2 * b + 1)
    return placed.withColumn(out, code.cast("int")).drop("__b", "__edge")


def _placed(df: DataFrame, columns: Sequence[tuple[str, int, str]]) -> tuple[DataFrame, list[bool]]:
    """Tag columns with the range of their value: (column, ranges, name of the tag). Also whether each
    could be cut."""
    numbers = [(c, parts, out, order_number(df, c)) for c, parts, out in columns]
    found = iter(_edges(df, [(n, parts) for _, parts, _, n in numbers if n is not None]))
    cut_up = []
    for c, parts, out, number in numbers:
        if number is not None:
            edges = next(found)
            df = _tag(df, number, edges, out)
        else:
            edges = _text_edges(df.drop(*[o for _, _, o in columns]), c, parts) if _is_text(df, c) else []
            df = _tag_text(df, c, edges, out)
        cut_up.append(bool(edges))
    return df, cut_up


def _ranges(
    df: DataFrame, order: str, tie: str | None, uniform: bool, parts: int | None
) -> DataFrame:
    parts = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if uniform:
        code = F.floor(F.col(order) * parts).cast("int")
        return df.withColumn("__code", code).withColumn("__sub", F.lit(1))
    wanted = [(order, parts, "__code"), *([(tie, min(parts, MAX_TIE_PARTS), "__sub")] if tie else [])]
    tagged, cut_up = _placed(df, wanted)
    if not tie or not all(cut_up):
        return tagged.withColumn("__sub", F.lit(1))
    one_value = (F.col("__code") % 2 == 0) & (F.col("__code") > 0)
    return tagged.withColumn("__sub", F.when(one_value, F.col("__sub")).otherwise(F.lit(1)))


def prefix_sums(
    df: DataFrame,
    order: str,
    sums: Mapping[str, Column],
    *,
    by: Sequence[str] = (),
    tie: str | None = None,
    totals: Mapping[str, Column] | None = None,
    uniform: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Add, per group `by`, the total of each expression over the rows strictly before the
    current one in (`order`, `tie`) order, and the group totals. `uniform` says that
    `order` is a uniform number in [0, 1), which saves the pass that finds the ranges."""
    totals = dict(totals or {})
    code, sub = "__code", "__sub"
    tagged = _ranges(df, order, tie, uniform, parts)

    keys = [*by, code, sub]
    pieces = tagged.groupBy(*keys).agg(
        *[F.sum(e).alias(f"__p{i}") for i, e in enumerate(sums.values())],
        *[F.sum(e).alias(f"__t{i}") for i, e in enumerate(totals.values())],
    )
    before = Window.partitionBy(*by).orderBy(code, sub).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = pieces.select(
        *[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)],
        *[
            F.coalesce(F.sum(f"__p{i}").over(before), F.lit(0)).alias(f"__o{i}")
            for i in range(len(sums))
        ],
        *[F.sum(f"__t{i}").over(whole).alias(f"__w{i}") for i in range(len(totals))],
    )
    match = reduce(
        lambda a, b: a & b,
        [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)],
    )
    inside = (
        Window.partitionBy(*keys)
        .orderBy(order, *([tie] if tie else []))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = tagged.select(
        "*",
        *[
            F.coalesce(F.sum(e).over(inside), F.lit(0)).alias(f"__l{i}")
            for i, e in enumerate(sums.values())
        ],
    )
    return local.join(offsets, match).select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"__o{i}") + F.col(f"__l{i}")).alias(o) for i, o in enumerate(sums)],
        *[F.col(f"__w{i}").alias(o) for i, o in enumerate(totals)],
    )


def value_ranks(df: DataFrame, columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add, for each column, the number of rows with a smaller and with the same value,
    under the two given names. A value that fills a range of its own takes both from the
    range totals, so a frequent value needs no window and its rows spread over tasks.
    Ranges and range totals of all columns come from two passes over the input; the totals
    (at most two per range) go into the plan as literals. Ranges and tasks grow with the rows: a task
    of the windows holds about RANK_ROWS of them, up to MAX_RANK_PARTS ranges."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = math.ceil(df.count() / RANK_ROWS)
    parts = min(MAX_RANK_PARTS, max(usual, RANGES_OF_TASK * tasks if tasks > usual else 1))
    names = list(columns)
    numbers = [order_number(df, c) for c in names]
    row = df.agg(
        *[F.approx_count_distinct(n) for n in numbers],
        *[F.max(F.abs(n.cast("double"))) for n in numbers],
        *[_approx_edges(n, max(parts, 2)) for n in numbers],
    ).first()
    # a column with few values makes each value a range of its own and needs no window
    # (its values are told apart as doubles, so they must be exact there)
    exact = [df.schema[c].dataType.typeName() != "decimal" and (row[len(names) + i] or 0) < 2.0**53
             for i, c in enumerate(names)]
    few = {i for i in range(len(names)) if row[i] <= FEW_VALUES and exact[i]}
    edges = [_apart(found or []) for found in row[2 * len(names) :]]
    tagged = df
    for i in range(len(names)):
        if i not in few:
            tagged = _tag(tagged, numbers[i], edges[i], f"__code{i}")
    cells = F.explode(F.array(*[
        F.struct(
            F.lit(i).alias("i"),
            (numbers[i] if i in few else F.col(f"__code{i}")).cast("double").alias("at"),
        )
        for i in range(len(names))
    ]))
    counts: list[dict[float, int]] = [{} for _ in names]
    for r in tagged.select(cells.alias("c")).groupBy("c.i", "c.at").count().collect():
        counts[r["i"]][r["at"]] = r["count"]
    for i in few:
        edges[i] = sorted(counts[i])
        counts[i] = {2.0 * at + 2: counts[i][v] for at, v in enumerate(edges[i])}
        tagged = _tag(tagged, numbers[i], edges[i], f"__code{i}")
    out = tagged
    for i, (c, (less, equal)) in enumerate(columns.items()):
        here = [counts[i].get(float(at), 0) for at in range(2 * len(edges[i]) + 3)]
        below = [0, *itertools.accumulate(here)][:-1]
        code, sub = F.col(f"__code{i}"), f"__sub{i}"
        pick = lambda xs: F.element_at(F.expr(f"array({', '.join(f'{x}L' for x in xs)})"), code + 1)
        if i in few:
            out = out.withColumns({less: pick(below), equal: pick(here)}).drop(f"__code{i}")
            continue
        whole = code % 2 == 0
        salt = F.pmod(F.xxhash64(*[F.col(f"`{n}`") for n in df.columns]), F.lit(MAX_TIE_PARTS))
        out = out.withColumn(sub, F.when(whole, salt.cast("int")).otherwise(F.lit(-1)))
        if tasks > usual:
            out = out.repartition(tasks, f"__code{i}", sub)
        inside = Window.partitionBy(f"__code{i}", sub)
        upto = inside.orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        same = Window.partitionBy(f"__code{i}", sub, c)
        out = out.withColumns({
            "__le": F.count("*").over(upto), "__eq": F.count("*").over(same),
        })
        out = out.withColumns({
            less: pick(below) + F.when(whole, 0).otherwise(F.col("__le") - F.col("__eq")),
            equal: F.when(whole, pick(here)).otherwise(F.col("__eq")),
        }).drop("__le", "__eq", sub, f"__code{i}")
    return out


def row_positions(
    df: DataFrame,
    order: str,
    *,
    by: Sequence[str] = (),
    tie: str | None = None,
    out: str = "pos",
    total: str | None = None,
    uniform: bool = False,
) -> DataFrame:
    """Zero-based position of each row in its group, optionally with the group size."""
    one = F.lit(1).cast("long")
    return prefix_sums(
        df, order, {out: one}, by=by, tie=tie, uniform=uniform,
        totals={total: one} if total else None,
    )


def with_halo(
    df: DataFrame,
    series: Sequence[str],
    *,
    pos: str = "pos",
    before: int = 0,
    after: int = 0,
    block: int = 100_000,
) -> tuple[DataFrame, Window, Column]:
    """Cut every series into blocks of consecutive positions and copy the few rows that a
    frame of `before`/`after` rows needs from the neighbouring blocks. Gives the frame, a
    window for it, and the condition that keeps the original rows."""
    block = max(block, 4 * (before + after + 1))
    first = F.floor((F.col(pos) - after) / block)
    last = F.floor((F.col(pos) + before) / block)
    out = df.withColumn("__block", F.explode(F.sequence(first, last)))
    window = Window.partitionBy(*series, "__block").orderBy(pos)
    home = F.col("__block") == F.floor(F.col(pos) / block)
    return out, window, home
