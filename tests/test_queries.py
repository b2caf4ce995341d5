"""Every registered query against DuckDB, at the smallest scale."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry_module

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, con, name):
    assert differences(QUERIES[name](spark, sf), con, SQL[name]) is None


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["device_id", "label", "rows", "mean_a", "mean_b"]
    assert df.count() > 0


def test_training_without_sql(spark, sf):
    """Trees and network learn the separable part: well above one in three."""
    from pyspark.sql import functions as F

    from fleetair.operators import metrics, ml

    df = spark.range(600).select(
        "id", (F.col("id") % 3).cast("int").alias("label"),
        (F.col("id") % 3 + F.sin(F.col("id")) / 4).alias("x"),
        F.cos(F.col("id")).alias("y"),
    )
    unlabelled = df.withColumn("label", F.lit(-1))
    train, test = ml.stratified_split(df, "id", "label")
    cols = ["x", "y"]
    trees = ml.train_trees(train.unionByName(unlabelled), cols, rounds=4, depth=3)
    acc = metrics.accuracy(ml.predict(trees, test), "label", "predicted").first()[0]
    assert acc > 0.9
    top = ml.feature_importance(spark, trees).first()
    assert top.feature == "x"

    params = ml.fit_scaler(train, cols)
    scaled = ml.standardise(train, cols, params)
    layers = ml.train_mlp(scaled, cols, layers=[2, 8, 3], epochs=20, rate=0.02)
    scored = ml.score_readings(test, params, layers, cols)
    assert metrics.accuracy(scored, "label", "predicted").first()[0] > 0.9
