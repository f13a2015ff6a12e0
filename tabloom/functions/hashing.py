"""Deterministic pseudo-randomness from a row key, identical on any engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 12
SCALE = float(16**HEX_DIGITS)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unit_hash(*keys: Column | str, seed: int | str = 0) -> Column:
    """Uniform double in [0, 1) derived from the key columns and a seed."""
    text = F.concat_ws("|", *[as_col(k).cast("string") for k in keys], F.lit(str(seed)))
    digits = F.substring(F.md5(text.cast("binary")), 1, HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(SCALE)


def unit_hash_sql(*keys: str, seed: int | str = 0) -> str:
    """The same number as `unit_hash`, as DuckDB SQL text."""
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return (
        f"(CAST(CAST('0x' || substr(md5(concat_ws('|', {parts}, '{seed}')), 1, {HEX_DIGITS})"
        f" AS BIGINT) AS DOUBLE) / {SCALE:.1f})"
    )
