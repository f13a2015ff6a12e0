"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(rows: DataFrame, label: str, keys: list[str], per_label: int) -> pd.DataFrame:
    """At most `per_label` rows of each label, chosen by a hash of `keys` (the same rows at every
    run), so nothing but the sample reaches the driver. Rows without a label are left out.

    The share of each label follows from one count per label; the rows are then cut to size."""
    rows = rows.where(F.col(label).isNotNull())
    place: Column = F.pmod(F.xxhash64(*keys), F.lit(1 << 30))
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not sizes:
        return rows.limit(0).toPandas()
    keep = F.lit(False)
    for value, n in sizes.items():
        share = min(1.0, 1.15 * per_label / n + 30 / n)
        keep = keep | ((F.col(label) == F.lit(value)) & (place < int(share * (1 << 30))))
    got = rows.withColumn("__place__", place).where(keep).toPandas()
    got = got.sort_values(["__place__", *keys], kind="stable")
    return got.groupby(label, sort=True).head(per_label).drop(columns="__place__").reset_index(drop=True)
