"""Streaming use of fitted, stateless steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Step = Callable[[DataFrame], DataFrame]


def apply_steps(stream: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Fitted fills, fences, scalers, encoders, model scoring and thresholds are row-wise, so
    they run on a stream as they do on a table."""
    for step in steps:
        stream = stream.transform(step)
    return stream


def score_available(
    spark: SparkSession, path: str, pattern: str, steps: Sequence[Step], out: str
) -> DataFrame:
    """Score all files now under `path` through a stream and read the result back. The sink
    and its checkpoint live under `out`, a folder that all executors share: called again with the
    same `out`, only files that came since are scored."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)
    root = out.rstrip("/")
    running = (
        apply_steps(stream, steps).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/scored")
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.parquet(f"{root}/scored")
