"""Scans: delimited text, Parquet, SQL text over registered views, named samples."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tabloom.operators.cleaning import fix_dtypes
from tabloom.session import nan_to_null

TAB_SUFFIXES = (".tsv", ".txt")


def scan_delimited(
    spark: SparkSession, path: str, *, sep: str = ",", schema: StructType | str | None = None
) -> DataFrame:
    """With a schema the file is read once. Without, all columns are read as text and types
    are inferred by the same rule as `fix_dtypes`, which knows every missing-value token."""
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"')
    reader = reader.option("escape", '"').option("multiLine", False)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return fix_dtypes(reader.csv(path))


def scan_csv(spark: SparkSession, path: str, *, schema=None) -> DataFrame:
    return scan_delimited(spark, path, schema=schema)


def scan_tsv(spark: SparkSession, path: str, *, schema=None) -> DataFrame:
    return scan_delimited(spark, path, sep="\t", schema=schema)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def scan(spark: SparkSession, path: str, *, schema=None) -> DataFrame:
    """Dispatch on the file suffix; an empty table is an error."""
    lower = path.lower().rstrip("/")
    if lower.endswith(".csv"):
        df = scan_csv(spark, path, schema=schema)
    elif lower.endswith(TAB_SUFFIXES):
        df = scan_tsv(spark, path, schema=schema)
    elif lower.endswith(".parquet"):
        df = scan_parquet(spark, path)
    else:
        raise ValueError(f"unsupported file type: {path}")
    if df.isEmpty():
        raise ValueError("the dataset is empty (0 rows)")
    return df


def scan_sql(spark: SparkSession, query: str, views: Mapping[str, DataFrame]) -> DataFrame:
    """Run a SQL string over named DataFrames."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query)


def scan_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Run a SQL string inside an external database."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def scan_sample(spark: SparkSession, name: str, samples: Mapping[str, str]) -> DataFrame:
    """A bundled table by name."""
    if name not in samples:
        raise ValueError(f"unknown sample dataset '{name}'")
    return scan(spark, samples[name])
