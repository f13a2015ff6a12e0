"""Forecasting models for the training path: one series, ordered by time and key.

A fitted model predicts every row of a frame: rows up to the end of training by looking one season (or
the lags) back in that frame, rows after it by their step from that end."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tabloom.functions.prefix import row_positions, with_halo
from tabloom.operators.predict import LagForecaster, fit_lag_boosting
from tabloom.operators.store import Parts, TableModel
from tabloom.operators.timeseries import lag_features
from tabloom.session import cut

SERIES = "__series"


def ordered(df: DataFrame, time: str, key: str, y: str | None = None) -> DataFrame:
    """The frame as one series with `pos` and `n`; rows without a value are left out."""
    rows = df.withColumn(SERIES, F.lit(0))
    if y is not None:
        rows = rows.withColumn("y", F.col(f"`{y}`").cast("double")).filter(F.col("y").isNotNull() & ~F.isnan("y"))
    return row_positions(rows, time, by=[SERIES], tie=key, out="pos", total="n")


def _end_table(spark: SparkSession, end: tuple[Any, Any], schema: StructType) -> DataFrame:
    return spark.createDataFrame([end], schema)


@dataclass(frozen=True)
class SeasonModel(TableModel):
    """Repeats the last season of the train rows (at most 366 values); a season of one value is
    the naive forecast."""

    end: tuple[Any, Any]
    season: tuple[float, ...]
    kinds: StructType

    def parts(self, spark: SparkSession) -> Parts:
        return Parts({"end": _end_table(spark, self.end, self.kinds)}, {}, {"season": list(self.season)})

    @classmethod
    def of(cls, parts: Parts) -> SeasonModel:
        table = parts.tables["end"]
        return cls(tuple(table.first()), tuple(parts.values["season"]), table.schema)

    def predict(self, df: DataFrame, time: str, key: str, target: str) -> DataFrame:
        period = len(self.season)
        placed = ordered(df, time, key).withColumn("__later", _after(time, key, self.end))
        known = placed.filter(~F.col("__later")).count()
        rows, w, home = with_halo(placed, [SERIES], before=period)
        back = F.lag(F.col(f"`{target}`").cast("double"), period).over(w)
        step = ((F.col("pos") - known) % period).cast("int")
        season = F.array(*[F.lit(v) for v in self.season])
        value = F.when(F.col("__later"), F.get(season, step)).otherwise(back)
        return rows.withColumn("prediction", value).filter(home).select(*df.columns, "prediction")


@dataclass(frozen=True)
class LagModel(TableModel):
    """Lag boosting with the train rows that its recursion starts from."""

    end: tuple[Any, Any]
    forecaster: LagForecaster
    train: DataFrame
    kinds: StructType

    def parts(self, spark: SparkSession) -> Parts:
        f = self.forecaster
        return Parts({"end": _end_table(spark, self.end, self.kinds), "train": self.train}, {"boosting": f.model},
                     {"series": list(f.series), "lags": f.lags})

    @classmethod
    def of(cls, parts: Parts) -> LagModel:
        end, values = parts.tables["end"], parts.values
        forecaster = LagForecaster(parts.models["boosting"], tuple(values["series"]), values["lags"])
        return cls(tuple(end.first()), forecaster, parts.tables["train"], end.schema)

    def predict(self, df: DataFrame, time: str, key: str, target: str) -> DataFrame:
        placed = ordered(df, time, key, target).withColumn("__later", _after(time, key, self.end))
        late, early = placed.filter("__later"), placed.filter(~F.col("__later"))
        known = early.count()
        steps = late.count()
        names = [f"y_lag_{k}" for k in range(1, self.forecaster.lags + 1)]
        lagged = lag_features(early, [SERIES], lags=self.forecaster.lags).na.drop(subset=names)
        vectors = VectorAssembler(inputCols=names, outputCol="features").transform(lagged)
        own = self.forecaster.model.transform(vectors).select(key, "prediction")
        inside = early.select(*df.columns).join(own, key, "left")
        if not steps:
            return inside.select(*df.columns, "prediction")
        ahead = self.forecaster.forecast(self.train, steps).select("step", F.col("forecast").alias("prediction"))
        outside = late.withColumn("step", (F.col("pos") - known + 1).cast("int")).join(ahead, "step", "left")
        return inside.select(*df.columns, "prediction").unionByName(outside.select(*df.columns, "prediction"))


def _after(time: str, key: str, end: tuple[Any, Any]) -> Column:
    t, k = F.col(f"`{time}`"), F.col(f"`{key}`")
    return (t > F.lit(end[0])) | ((t == F.lit(end[0])) & (k > F.lit(end[1])))


def fit_forecaster(
    name: str, train: DataFrame, time: str, key: str, target: str, params: dict[str, Any], *, seed: int = 0
) -> SeasonModel | LagModel:
    placed = ordered(train, time, key, target)
    period = 1 if name == "naive" else int(params.get("period", 1))
    last = placed.filter(F.col("pos") >= F.col("n") - period).orderBy("pos").select(time, key, "y").collect()
    if not last:
        raise ValueError("forecasting needs train rows with a value")
    end = (last[-1][0], last[-1][1])
    kinds = StructType([StructField(f"end_{part}", placed.schema[c].dataType) for part, c in (("time", time), ("key", key))])
    if name != "lag_boosting":
        return SeasonModel(end, tuple(r["y"] for r in last), kinds)
    fitted = fit_lag_boosting(
        placed.select(SERIES, "pos", "n", "y"), [SERIES], lags=int(params["lags"]),
        learning_rate=params["learning_rate"], max_iter=int(params["max_iter"]), seed=seed,
    )
    return LagModel(end, fitted, cut(placed.select(SERIES, "pos", "n", "y")), kinds)
