"""Models whose state is tables: written and read like Spark ML models.

A stored model is a folder with one Parquet table per part, the Spark ML models that it uses, and one
JSON row of plain values. Reading opens the tables without loading them; they are scanned when the
model scores."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Parts:
    """What a model is made of."""

    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    models: Mapping[str, Any] = field(default_factory=dict)
    values: Mapping[str, Any] = field(default_factory=dict)


class TableModel(MLWritable, MLReadable):
    """A model that can say its `parts` and be made `of` them again."""

    def parts(self, spark: SparkSession) -> Parts:
        raise NotImplementedError

    @classmethod
    def of(cls, parts: Parts) -> TableModel:
        raise NotImplementedError

    def write(self) -> MLWriter:
        return TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return TableReader(cls)


class TableWriter(MLWriter):
    def __init__(self, model: TableModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        parts = self.model.parts(spark)
        for name, table in parts.tables.items():
            table.write.parquet(f"{path}/tables/{name}")
        for name, model in parts.models.items():
            PipelineModel([model]).write().save(f"{path}/models/{name}")
        state = {"values": dict(parts.values), "tables": list(parts.tables), "models": list(parts.models)}
        write_json(spark, state, f"{path}/state")


class TableReader(MLReader):
    def __init__(self, kind: type[TableModel]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> TableModel:
        spark = self.sparkSession
        state = read_json(spark, f"{path}/state")
        return self.kind.of(Parts(
            {name: spark.read.parquet(f"{path}/tables/{name}") for name in state["tables"]},
            {name: PipelineModel.load(f"{path}/models/{name}").stages[0] for name in state["models"]},
            state["values"],
        ))


def write_json(spark: SparkSession, value: Any, path: str) -> None:
    """One JSON row, the last thing written: a folder without it is an unfinished write."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.text(path)


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(spark.read.text(path).first()[0])
