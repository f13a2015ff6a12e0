"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

#: Lower-cases A-Z and turns every byte outside `[0-9a-z\x80-\xff]` into a space; the length stays.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def as_bytes(column: str) -> Column:
    """UTF-8 bytes of a text column; null is empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).cast("binary")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))) % modulus


def stored(df: DataFrame, prefix: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: cuts the lineage and
    outlives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark, prefix)}/part"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def docs_of(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(lengths: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Cut consecutive rows into slices of about `budget` bytes (at least one row each)."""
    out, start, total = [], 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > budget:
            out.append((start, i))
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        out.append((start, len(lengths)))
    return out


def word_spans(folded: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every run without spaces."""
    inside = np.concatenate(([False], np.frombuffer(folded, np.uint8) != 0x20, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words above the lowest count that leaves at most `most` of them."""
    level = F.floor(F.log2("n") * 64)
    kept, low = 0, None
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        kept += row["count"]
        if kept > most:
            break
        low = row["level"]
    return counts.where(level >= low) if low is not None else counts.limit(0)


def with_groups(rows: DataFrame, groups: DataFrame, key: str, heavy: int) -> DataFrame:
    """Join every row with its group. Groups of more than `heavy` rows (so at most rows / heavy of
    them) are broadcast, so that no task gets a hot key."""
    hot = F.broadcast(groups.where(F.col("group_size") > heavy))
    cold = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(groups.where(F.col("group_size") <= heavy), key))


def bitmap(hashes: DataFrame, column: str, log2: int) -> np.ndarray:
    """2 ** log2 bits, set at the hashes modulo their number; segments of 65,536 bits are made in
    tasks, and the whole has at most 2 ** log2 / 8 bytes."""
    place = F.pmod(F.col(column), F.lit(1 << log2))
    spots = hashes.select(F.shiftright(place, 16).alias("segment"), F.pmod(place, F.lit(1 << 16)).alias("bit")).distinct()

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 16, np.uint8)
        bits[table.column("bit").to_numpy()] = 1
        return pa.table({"segment": table.column("segment").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    out = np.zeros((1 << log2) // 8, np.uint8)
    for row in spots.groupBy("segment").applyInArrow(pack, "segment bigint, bits binary").collect():
        out[row["segment"] << 13:(row["segment"] + 1) << 13] = np.frombuffer(row["bits"], np.uint8)
    return out


def marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the bits of the values are set."""
    place = values & (len(bits) * 8 - 1)
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


def prefiltered(df: DataFrame, column: str, wanted: DataFrame, log2: int = 24) -> DataFrame:
    """The rows of `df` that may have a partner in `wanted` by `column`: a bitmap of a fixed size is
    broadcast, so that a join which follows shuffles little. Rows without a partner may remain."""
    place = "__place__"
    shared = df.sparkSession.sparkContext.broadcast(
        bitmap(wanted.select(F.xxhash64(column).alias(place)), place, log2))
    names = df.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked(shared.value, batch.column(place).to_numpy()))).select(names)

    return df.withColumn(place, F.xxhash64(column)).mapInArrow(keep, df.schema)
