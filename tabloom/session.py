"""Session defaults, table loading and lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session(cores: int | str = "*", app: str = "tabloom") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TABLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a value in Spark; every operator here treats it as missing."""
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.dataType.typeName() in ("double", "float"):
            c = F.when(~F.isnan(c), c).alias(field.name)
        cols.append(c)
    return df.select(*cols)


def scratch_dir(spark: SparkSession, prefix: str) -> str:
    """A fresh folder every executor can reach, in the shared folder the session names; a
    temporary folder on a single machine, an error on a cluster without a shared folder."""
    return f"{shared_folder(spark)}/{prefix}-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tabloom-")


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` once through a reliable checkpoint, so that the passes over it
    see the same rows and do not recompute it."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Like `cut`, in Parquet: smaller than a checkpoint, above all where values repeat or rows hold lists."""
    spark = df.sparkSession
    path = path or scratch_dir(spark, "rows")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of `scratch_dir` that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
