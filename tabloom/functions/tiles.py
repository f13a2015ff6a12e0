"""Block-wise work between two keyed sets of vectors.

Both sides are cut into blocks by a hash of the key; every (left block, right block) pair
is one bounded Arrow task that yields partial results per left row, never pairs of rows.
The work is quadratic by nature of the operators that use it (sums of distances, ranks); it spreads
evenly because blocks are cut by hash. Neighbour search is in `neighbours`.

`tiles` shuffles a copy of each block per block that it meets, `streamed` none: a task keeps a few blocks
of the left side and reads the blocks of the right side one after the other from the checkpoint.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block; a smaller table is still cut into LEAST blocks, which tasks share.
BLOCK_ROWS, LEAST = 16_384, 6


def _blocks(rows: int, block_rows: int) -> int:
    return max(1, math.ceil(rows / block_rows), min(LEAST, rows // 1024))


def tiles(
    left: DataFrame,
    right: DataFrame,
    key: str,
    fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    *,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Apply `fn(left block, right block)` to every pair of blocks."""
    n_left, n_right = _blocks(left.count(), block_rows), _blocks(right.count(), block_rows)
    right = right.select(*[F.col(f"`{c}`").alias(c) for c in right.columns])
    home = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("__a", home(n_left)).withColumn("__b", copies(n_right))
    b = right.withColumn("__b", home(n_right)).withColumn("__a", copies(n_left))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return fn(x, y)

    return a.groupBy("__a", "__b").cogroup(b.groupBy("__a", "__b")).applyInPandas(run, schema)


def packed(df: DataFrame, part: Column, parts: int) -> DataFrame:
    """(part, data): the rows of each of the `parts` parts as one value, an Arrow stream. Rows are shuffled once,
    and a part has a partition of its own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if len(b)]
        if found:
            sink, rows = pa.BufferOutputStream(), pa.Table.from_batches(found).combine_chunks()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows)
            yield pa.RecordBatch.from_arrays(
                [rows["__part"].chunk(0)[:1], pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "data"])

    numbered = df.withColumn("__part", part.cast("int")).repartitionById(parts, F.col("__part"))
    return numbered.mapInArrow(pack, "part int, data binary")


def streamed(
    left: DataFrame, right: DataFrame,
    start: Callable[[pa.Table], tuple[Callable[[int, Callable[[], pa.Table]], None], Callable[[], pa.Table]]], schema: str,
) -> DataFrame:
    """Meet every block of `left` with every block of `right`, both `packed`, the right one checkpointed as well.

    `start(rows)` begins a left block and returns two functions: the first is called once per right block, with its
    number and a function that opens it; the second, at the end, gives the rows of the result. The plan is a
    Cartesian product of blocks whose right side is one stream, so no row is shuffled or stored for a pair, and a
    left block is finished by one task."""
    blocks = right.coalesce(1).select(F.col("part").alias("__b"), F.col("data").alias("__y"))
    pairs = blocks.hint("shuffle_replicate_nl").crossJoin(left.select(F.col("part").alias("__a"), F.col("data").alias("__x")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for i, (a, b) in enumerate(zip(batch["__a"].to_pylist(), batch["__b"].to_pylist())):
                if a not in held:  # a copy, as the batch goes
                    held[a] = start(_opened(pa.py_buffer(batch["__x"][i].as_py())))
                held[a][0](b, lambda at=i, batch=batch: _opened(batch["__y"][at].as_buffer()))
        for a in list(held):
            yield from held.pop(a)[1]().to_batches()

    return pairs.mapInArrow(run, schema)


def _opened(data: pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().drop_columns("__part")


def matrix(series: pd.Series) -> np.ndarray:
    return np.asarray(series.tolist(), dtype=float) if len(series) else np.empty((0, 0))
