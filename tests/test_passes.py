"""How often fits read their rows, and mining of repeated rows."""

from pyspark.sql import functions as F

from tabloom.operators import association as A
from tabloom.operators import features as X
from tabloom.operators import splits as S
from tabloom.operators import training as N

ROWS = 400


def counted(spark):
    """A table and the number of its rows read so far."""
    seen = spark.sparkContext.accumulator(0)
    df = spark.range(ROWS, numPartitions=2).select(
        "id", (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 17 * 3.0 + F.col("id") % 5).alias("y"),
        F.lit("wide").alias("unused"))

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(look, df.schema), seen


def test_features_are_fitted_in_one_read(spark):
    df, seen = counted(spark)
    fitted = X.fit_features(df, ["x"])
    assert fitted.fills == {"x": 8.0} and seen.value == ROWS


def test_a_split_hashes_its_rows_once(spark):
    df, seen = counted(spark)
    out = S.split_random(df, "id")
    assert seen.value == 2 * ROWS  # the count and the hashes
    assert out.filter("split = 'test'").count() == ROWS * 0.2


def test_training_reads_its_split_once(spark):
    df, seen = counted(spark)
    task = N.Task("regression", key="id", target="y", features=("x",))
    N.train_model(df, task, "linear_regression")
    assert seen.value <= 4 * ROWS  # two for the split, one each for the features and the train rows


def test_tuned_rows_are_read_once_after_the_split(spark):
    df, seen = counted(spark)
    task = N.Task("regression", key="id", target="y", features=("x",))
    N.tune(df, task, "ridge", trials=2)
    assert seen.value <= 5 * ROWS


def test_repeated_rows_of_a_basket_count_once(spark):
    rows = [(b, i) for b in range(20) for i in "abc"[: 1 + b % 3]]
    once = spark.createDataFrame(rows, "basket long, item string")
    mined = [sorted(map(str, A.mine_itemsets(df, 0.1).collect())) for df in (once, once.unionByName(once))]
    assert mined[0] == mined[1] and len(mined[0]) == 7
