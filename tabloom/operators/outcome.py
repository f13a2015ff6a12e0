"""Result tables of a run, as DataFrames and as written CSV folders."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators import clusters as K
from tabloom.operators.association import order_rules
from tabloom.operators.errors import score_summary
from tabloom.operators.metrics import apply_threshold
from tabloom.operators.training import PreprocessingOptions, Trained, fit_model, pca_parts
from tabloom.functions.scalar import join_items
from tabloom.session import cut
from tabloom.sources.versions import write_csv


def outcome_supervised(
    trained: Trained, df: DataFrame, *, threshold: float = 0.5, refit_on_all: bool = False,
    options: PreprocessingOptions = PreprocessingOptions(),
) -> tuple[Trained, DataFrame]:
    """Predictions for all rows, with a label at the threshold on the positive-class
    probability of a binary model; the model may be fitted again on all rows."""
    if refit_on_all:
        trained = fit_model(df, trained.task, trained.spec.name, trained.params, options=options)
    out = trained.predict(df)
    if len(trained.labels) == 2 and f"p_{trained.labels[1]}" in out.columns:
        hit = apply_threshold(F.col(f"`p_{trained.labels[1]}`"), threshold)
        out = out.withColumn("prediction_at_threshold", hit)
    return trained, out


def outcome_unsupervised(trained: Trained, df: DataFrame) -> dict[str, DataFrame]:
    """clusters, profiles, personas / embeddings, summary / flagged, distribution."""
    kind, features = trained.task.task_type, list(trained.features.numeric)
    out = trained.predict(df)
    if kind == "clustering":
        clusters = out.withColumnRenamed("prediction", "cluster_id")
        return {
            "clusters": clusters, "profiles": K.cluster_profiles(clusters, "cluster_id", features),
            "personas": K.top_personas(clusters, "cluster_id", features),
        }
    if kind == "dimensionality_reduction":
        width = len(trained.features.names)
        gaps = F.zip_with("x", "back", lambda a, b: (a - b) * (a - b))
        error = F.aggregate(gaps, F.lit(0.0), lambda a, b: a + b) / width
        summary = pca_parts(trained, df).agg(
            F.lit(trained.extra["components"]).alias("n_components"),
            F.lit(float(sum(trained.extra["explained"]))).alias("cumulative_variance"),
            F.avg(error).alias("mean_reconstruction_error"),
        )
        return {"embeddings": out, "summary": summary}
    if kind == "anomaly_detection":
        flagged = out.withColumnRenamed("prediction", "flagged")
        return {"flagged": flagged, "score_distribution": score_summary(flagged, "score")}
    raise ValueError(f"no unsupervised outcome for task '{kind}'")


def outcome_rules(rules: DataFrame) -> dict[str, DataFrame]:
    """The rule table with items as text, best rule first."""
    texts = {c: join_items(F.col(c)) for c in ("antecedent", "consequent")}
    return {"rules": order_rules(rules).withColumns(texts)}


def package(tables: Mapping[str, DataFrame], path: str) -> list[str]:
    """Write every table of an outcome as a CSV folder; array columns become text."""
    out = []
    for name, df in tables.items():
        flat = df.select(*[
            F.to_json(F.col(f"`{f.name}`")).alias(f.name)
            if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ])
        out.append(write_csv(flat, f"{path}/{name}"))
    return out


def reconstruction_rows(trained: Trained, df: DataFrame, *, share: float = 0.8) -> DataFrame:
    """Reconstruction norm per row with the quantile threshold and whether it is above. The norms are made once;
    the passes that find the threshold read them."""
    from tabloom.functions.quantiles import exact_quantiles

    gaps = F.zip_with("x", "back", lambda a, b: (a - b) * (a - b))
    norm = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda a, b: a + b))
    rows = cut(pca_parts(trained, df).select(trained.task.key, norm.alias("error")))
    limit = exact_quantiles(rows, ["error"], [share])["error"][0]
    return rows.select("*", F.lit(limit).alias("threshold"), (F.col("error") > limit).alias("above"))


def learning_curve(trained: Trained, df: DataFrame, *, seed: int = 0) -> DataFrame:
    """Loss per iteration with the best iteration so far marked. Boosting reports training and
    held-out loss per round (`seed` is the one of the fit); models with an objective history report
    it, without a validation loss; models without iterations give an empty curve."""
    spark = df.sparkSession
    model = trained.model
    if hasattr(model, "evaluateEachIteration"):
        from tabloom.functions.hashing import unit_hash

        labels = F.array(*[F.lit(v) for v in trained.labels]) if trained.labels else None
        y = (F.array_position(labels, F.col(trained.task.target)) - 1) if trained.labels else F.col(trained.task.target)
        rows = trained.vectors(df).withColumn("label", y.cast("double"))
        held = unit_hash(trained.task.key, seed=f"validation:{seed}") < 0.1
        args = () if trained.labels else ("squared",)
        train = model.evaluateEachIteration(rows.filter(~held), *args)
        val = model.evaluateEachIteration(rows.filter(held), *args)
    else:
        summary = getattr(model, "summary", None)
        summary = summary() if callable(summary) else summary
        train = list(getattr(summary, "objectiveHistory", None) or [])
        val = [None] * len(train)
    table = [(i + 1, float(a), None if b is None else float(b)) for i, (a, b) in enumerate(zip(train, val))]
    curve = spark.createDataFrame(table, "epoch int, train_loss double, val_loss double")
    known = [r for r in table if r[2] is not None]
    best = min(known, key=lambda r: r[2])[0] if known else None
    return curve.select(
        "*", (F.col("val_loss") - F.col("train_loss")).alias("gap"), F.lit(best).cast("int").alias("best_epoch"),
        F.lit(bool(known) and known[-1][2] > min(r[2] for r in known)).alias("overfitting"),
    )
