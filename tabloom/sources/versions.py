"""Immutable dataset versions, content digests, step replay and CSV deliverables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.profile import schema_report

Step = tuple[str, Mapping[str, Any]]


def version_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/v{version:05d}"


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write a numbered Parquet version and its schema table; never overwrites."""
    path = version_path(root, version)
    df.write.mode("errorifexists").parquet(f"{path}/data")
    written = df.sparkSession.read.parquet(f"{path}/data")
    schema_report(written).write.mode("errorifexists").json(f"{path}/schema")
    return path


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{version_path(root, version)}/data")


def read_version_info(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The schema table only, without touching the data."""
    kinds = "`column` string, dtype string, kind string, missing long, missing_pct double, `unique` long"
    return spark.read.schema(kinds).json(f"{version_path(root, version)}/schema")


def _value(df: DataFrame, name: str) -> Column:
    """A value as text that no session setting changes: timestamps as microseconds, binary as hex,
    nested values as two hashes."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if kind.typeName() == "timestamp":
        return F.unix_micros(c).cast("string")
    if kind.typeName() == "binary":
        return F.hex(c)
    if kind.typeName() == "map":
        c = F.sort_array(F.map_entries(c))
    if kind.typeName() in ("array", "struct", "map"):
        both = F.concat_ws(",", F.xxhash64(c).cast("string"), F.xxhash64(F.lit(name), c).cast("string"))
        return F.when(F.col(f"`{name}`").isNotNull(), both)
    return c.cast("string")


def _sized(text: Column) -> Column:
    """Length and text; a null has no length, so nothing else reads the same."""
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def dataset_hash(df: DataFrame) -> DataFrame:
    """(rows, digest): a digest of the content, column names and types that depends neither on row order
    nor on how the data is cut into files, nor on the time zone of the session: per row an md5 of the
    length-prefixed names, types and values, of which both halves are summed."""
    names = sorted(df.columns)
    head = "".join(f"{len(t)}:{t}" for c in names for t in (c, df.schema[c].dataType.simpleString()))
    row = F.md5(F.concat_ws("|", F.lit(head), *[_sized(_value(df, c)) for c in names]).cast("binary"))
    halves = [F.conv(F.substring(row, at, 16), 16, 10).cast("decimal(38,0)") for at in (1, 17)]
    sums = [F.coalesce(F.sum(h), F.lit(0)).cast("string") for h in halves]
    return df.agg(F.count("*").alias("rows"), F.concat_ws("-", *sums).alias("digest"))


def replay(
    df: DataFrame, steps: Sequence[Step], operations: Mapping[str, Callable[..., DataFrame]]
) -> DataFrame:
    """Fold a logged list of (operation, parameters) over the raw table."""
    unknown = [op for op, _ in steps if op not in operations]
    if unknown:
        raise ValueError(f"unknown operation '{unknown[0]}'")
    for op, params in steps:
        df = df.transform(operations[op], **params)
    return df


def write_csv(df: DataFrame, path: str) -> str:
    """One CSV part per partition, each with a header."""
    df.write.mode("errorifexists").option("header", True).csv(path)
    return path
