"""Splitting, scaling, training and scoring."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetair.functions.codes import class_name
from fleetair.functions.scoring import Layer, argmax_class, dense_layers
from fleetair.operators import boosting, network
from fleetair.operators.metrics import rank_features
from fleetair.schema import CLASS_NAMES, FEATURES

# Hexadecimal digits of the hash by which a label's rows are counted.
SPLIT_DIGITS = 4


def assign_split(
    df: DataFrame, id: str, label: str, frac: float = 0.2, seed: int = 42,
    digits: int = SPLIT_DIGITS,
) -> DataFrame:
    """Add ``is_test``: exactly ``ceil(frac * n)`` rows of every label.

    The rows of a label with the lowest ``md5(id || seed)`` are the test rows. A
    label can hold most of the table, so nothing ranks a whole label: counts per
    leading hash digits find the digits at which each label is cut, only the
    hashes that share them (one in 65,536 of a large label) are ranked, and every
    row is then compared with its label's last test hash. A NULL label has no
    stratum and no side. Labels may be many: they are joined, not fetched.
    """
    digest = F.md5(F.concat(F.col(id).cast("string"), F.lit(str(seed))))
    # Hexadecimal digits sort as text just as the numbers do.
    hashed = df.where(F.col(label).isNotNull()).select(
        F.col(label).cast("string").alias("_l"), digest.alias("_h"), F.col(id).alias("_id")
    ).withColumn("_b", F.substring("_h", 1, digits))

    w = Window.partitionBy("_l")
    upto = w.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hashed.groupBy("_l", "_b").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "upto": F.sum("n").over(upto),
        "take": F.ceil(F.lit(float(frac)) * F.sum("n").over(w)).cast("long"),
    })
    below = F.col("upto") - F.col("n")
    cuts = hist.where((below < F.col("take")) & (F.col("upto") >= F.col("take"))).select(
        "_l", "_b", (F.col("take") - below).alias("_need"))
    nth = F.row_number().over(Window.partitionBy("_l").orderBy("_h", "_id"))
    last = (
        hashed.join(cuts, ["_l", "_b"]).withColumn("_nth", nth).where("_nth = _need")
        .select(F.col("_l").alias("_label"), F.struct("_h", "_id").alias("_last"))
    )
    here = F.struct(digest.alias("_h"), F.col(id).alias("_id"))
    return (
        df.join(last, F.col(label).cast("string") == F.col("_label"), "left")
        .withColumn("is_test", F.when(
            F.col(label).isNotNull(), F.coalesce(here <= F.col("_last"), F.lit(False))))
        .drop("_label", "_last")
    )


def stratified_split(
    df: DataFrame, id: str, label: str, frac: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test), disjoint, the same every time for the same ids and seed."""
    split = assign_split(df, id, label, frac, seed)
    return split.where(~F.col("is_test")).drop("is_test"), split.where("is_test").drop("is_test")


def labelled(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows that can be trained on: those with one of the known classes."""
    return df.where(F.col(label).between(0, len(CLASS_NAMES) - 1))


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, mean, scale) with the population deviation, or 1 where it is 0."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)],
    )
    rows = [
        F.struct(
            F.lit(c).alias("feature"), F.col(f"m_{i}").alias("mean"),
            F.when(F.col(f"s_{i}") == 0, 1.0).otherwise(F.col(f"s_{i}")).alias("scale"),
        )
        for i, c in enumerate(cols)
    ]
    return row.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def _fitted(params: DataFrame) -> Column:
    """The parameters as one map, read with the query that uses them."""
    pair = F.struct(F.col("mean").cast("double").alias("mean"), F.col("scale").cast("double").alias("scale"))
    return params.agg(F.map_from_entries(F.collect_list(F.struct("feature", pair))).alias("p")).scalar()


def _scaled(cols: Sequence[str], fitted: Column) -> list[Column]:
    """Scaled columns. A feature without parameters, or with two rows of them, ends the query."""
    def one(c: str) -> Column:
        p = F.coalesce(F.try_element_at(fitted, F.lit(c)), F.raise_error(F.lit(f"no parameters for {c}")))
        return (F.col(c).cast("double") - p["mean"]) / p["scale"]

    return [one(c) for c in cols]


def fetched(params: DataFrame) -> DataFrame:
    """The parameters, two numbers per feature, as a table that is computed already."""
    return params.sparkSession.createDataFrame(params.collect(), params.schema)


def standardise(df: DataFrame, cols: Sequence[str], params: DataFrame) -> DataFrame:
    """(x - mean) / scale with parameters fitted on the training rows."""
    with_params = df.withColumn("_params", _fitted(params))
    return with_params.withColumns(dict(zip(cols, _scaled(cols, F.col("_params"))))).drop("_params")


def dense_score(
    df: DataFrame, features: Sequence[str] | str, layers: Sequence[Layer], out: str = "probs"
) -> DataFrame:
    """Forward pass of a dense network over columns or over one array column."""
    x = F.col(features) if isinstance(features, str) else F.array(
        *[F.col(c).cast("double") for c in features]
    )
    return df.withColumn(out, dense_layers(x, layers))


def score_readings(
    df: DataFrame, params: DataFrame, layers: Sequence[Layer], cols: Sequence[str] = FEATURES
) -> DataFrame:
    """Scale, score and decide each reading.

    A reading with a missing feature gets a NULL class and confidence and the
    name UNKNOWN.
    """
    scaled = df.withColumn("_params", _fitted(params)).withColumn("_x", F.array(*_scaled(cols, F.col("_params"))))
    scored = scaled.withColumn("_probs", dense_layers(F.col("_x"), layers))
    best, confidence = argmax_class(F.col("_probs"))
    return scored.withColumns({
        "predicted": best, "confidence": confidence, "predicted_name": class_name(best),
    }).drop("_probs", "_x", "_params")


def layers_from_table(weights: DataFrame) -> list[Layer]:
    """Layers from a weights table (layer, unit, weights, bias, act)."""
    rows = weights.orderBy("layer", "unit").collect()
    layers: dict[int, Layer] = {}
    for r in rows:
        layer = layers.setdefault(r["layer"], {"w": [], "b": [], "act": r["act"]})
        layer["w"].append(list(r["weights"]))
        layer["b"].append(r["bias"])
    return [layers[i] for i in sorted(layers)]


def _vectors(df: DataFrame, features: Sequence[str] | str, label: str) -> DataFrame:
    """``x, y`` of the labelled rows that have every feature."""
    if isinstance(features, str):
        x = F.col(features).cast("array<double>")
        complete = x.isNotNull() & ~F.exists(x, lambda v: v.isNull())
    else:
        each = [F.col(c).cast("double") for c in features]
        x = F.array(*each)
        # A condition per feature: of one that names them all, the planner keeps a copy for every
        # way to write some features as what they are computed from, 65,536 for sixteen.
        complete = reduce(lambda a, b: a & b, [v.isNotNull() for v in each], F.lit(True))
    return labelled(df, label).where(complete).select(x.alias("x"), F.col(label).cast("int").alias("y"))


def train_trees(
    df: DataFrame, features: Sequence[str], label: str = "label",
    rounds: int = 100, depth: int = 6, rate: float = 0.1,
) -> boosting.Trees:
    """Boosted trees with one softmax over the classes."""
    return boosting.train_trees(_vectors(df, features, label), features, len(CLASS_NAMES), rounds, depth, rate)


def train_mlp(
    df: DataFrame, features: Sequence[str] | str, label: str = "label",
    layers: Sequence[int] = (16, 32, 16, 3), epochs: int = 50, **options,
) -> list[Layer]:
    """A dense network of the given sizes, in the form ``dense_score`` takes."""
    return network.train_mlp(_vectors(df, features, label), layers, epochs, **options)[0]


def predict(model: boosting.Trees, df: DataFrame, label: str = "label") -> DataFrame:
    """(label, predicted) of the labelled rows that have every feature."""
    scored = _vectors(df, model.features, label).withColumn("_m", boosting.tree_margins(F.col("x"), model))
    return scored.select(F.col("y").alias("label"), argmax_class(F.col("_m"))[0].alias("predicted"))


def feature_importance(spark, model: boosting.Trees) -> DataFrame:
    """Importance per feature, the mean gain of its splits, highest first."""
    return rank_features(spark.createDataFrame(
        list(boosting.importances(model).items()), "feature string, importance double"))
