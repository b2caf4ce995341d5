"""Counts, profiles and classifier metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetair.plans.timeline import as_list


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows")).orderBy(label)


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing values per column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.unpivot([], list(cols), "feature", "missing")


def log_stats(df: DataFrame, key, line: str = "line") -> DataFrame:
    """Samples and bytes per log, each line with its newline."""
    return df.groupBy(*as_list(key)).agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum(F.octet_length(line).cast("long") + 1).alias("bytes"),
    )


def confusion_matrix(df: DataFrame, y: str, yhat: str, classes: Sequence[int]) -> DataFrame:
    """Counts with a row per true class and a column per predicted one.

    Both are filled up to ``classes``; pairs outside them are not counted.
    """
    spark = df.sparkSession
    pairs = (
        df.where(F.col(y).isin(list(classes)))
        .groupBy(F.col(y).cast("int").alias("actual"))
        .agg(*[F.count_if(F.col(yhat) == c).alias(f"pred_{c}") for c in classes])
    )
    every = spark.createDataFrame([(int(c),) for c in classes], "actual int")
    return every.join(pairs, "actual", "left").na.fill(0).orderBy("actual")


def classification_report(
    df: DataFrame, y: str, yhat: str, classes: Sequence[int]
) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, and both averages.

    One pass over the rows gives every count; the rest is arithmetic on one row.
    A zero denominator gives 0.
    """
    counts = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(y) == F.col(yhat)).alias("right"),
        *[F.count_if((F.col(y) == c) & (F.col(yhat) == c)).alias(f"tp_{c}") for c in classes],
        *[F.count_if(F.col(y) == c).alias(f"true_{c}") for c in classes],
        *[F.count_if(F.col(yhat) == c).alias(f"pred_{c}") for c in classes],
    )

    def share(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    per_class = {}
    for c in classes:
        precision = share(F.col(f"tp_{c}"), F.col(f"pred_{c}"))
        recall = share(F.col(f"tp_{c}"), F.col(f"true_{c}"))
        per_class[c] = (
            precision, recall, share(2 * precision * recall, precision + recall),
            F.col(f"true_{c}"),
        )

    def row(name, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1"), support.cast("long").alias("support"),
        )

    support = sum((m[3] for m in list(per_class.values())[1:]), per_class[classes[0]][3])

    def macro(i):
        return sum((m[i] for m in per_class.values()), F.lit(0.0)) / len(classes)

    def weighted(i):
        return share(sum((m[i] * m[3] for m in per_class.values()), F.lit(0.0)), support)

    acc = share(F.col("right"), F.col("n"))
    rows = [row(str(c), *m) for c, m in per_class.items()]
    rows.append(row("accuracy", acc, acc, acc, F.col("n")))
    rows.append(row("macro avg", *[macro(i) for i in range(3)], support))
    rows.append(row("weighted avg", *[weighted(i) for i in range(3)], support))
    return counts.select(F.explode(F.array(*rows)).alias("m")).select("m.*")


def accuracy(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(yhat)).cast("double")).alias("accuracy"))


def rank_features(df: DataFrame, value: str = "importance") -> DataFrame:
    """Features by descending value; equal values by name."""
    return df.orderBy(F.col(value).desc(), F.col("feature"))
