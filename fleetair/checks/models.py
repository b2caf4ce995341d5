"""Metrics, training and scoring queries over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetair.functions.scoring import argmax_class
from fleetair.operators import boosting, metrics, ml, network, quality
from fleetair.plans.scratch import scratch_path
from fleetair.schema import FEATURES
from fleetair.sources import adapters as ad
from fleetair.sources import logs

CLASSES = [0, 1, 2]


#: Rows of sixteen features that a vector is cut into.
PER_VECTOR = 4


def feature_rows(spark, d):
    """Each vector as four rows of sixteen entries, under the feature names."""
    cut = ad.table(spark, d, "embeddings").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PER_VECTOR - 1))))
    return cut.select(
        (F.col("vec_id") * PER_VECTOR + F.col("part")).alias("row_id"), (F.col("label") % 3).cast("int").alias("label"),
        *[F.get("embedding", F.col("part") * len(FEATURES) + i).cast("double").alias(n) for i, n in enumerate(FEATURES)])


FEATURES_SQL = f"SELECT vec_id * {PER_VECTOR} + part AS row_id, CAST(label % 3 AS INTEGER) AS label, " + ", ".join(
    f"CAST(embedding[{len(FEATURES)} * part + {i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate(FEATURES)
) + f" FROM embeddings, range({PER_VECTOR}) AS r(part)"


def weight(i, j, k):
    return ((i * 7 + j * 3 + k) % 11 - 5) / 10.0


SIZES = [16, 32, 16, 3]
ACTS = ["relu", "relu", "softmax"]
LAYERS = [
    {"w": [[weight(i, j, k) for i in range(n_in)] for j in range(n_out)],
     "b": [weight(j, k, 2) for j in range(n_out)], "act": act}
    for k, (n_in, n_out, act) in enumerate(zip(SIZES, SIZES[1:], ACTS))
]


def _list(values):
    return "[" + ", ".join(f"{v!r}e0" for v in values) + "]"


def forward_sql(x: str, source: str, keep: str) -> str:
    """The network as list arithmetic; ``x`` is a DOUBLE[] expression."""
    def layer(k, of):
        units = [f"list_dot_product({of}, {_list(w)}) + {b!r}e0" for w, b in zip(LAYERS[k]["w"], LAYERS[k]["b"])]
        if LAYERS[k]["act"] == "relu":
            units = [f"greatest({u}, 0e0)" for u in units]
        return "[" + ", ".join(units) + "]"
    return f"""
SELECT {keep}, list_transform(z, lambda v: exp(v) / list_sum(list_transform(z, lambda u: exp(u)))) AS probs FROM (
  SELECT {keep}, {layer(2, 'h2')} AS z FROM (
    SELECT {keep}, {layer(1, 'h1')} AS h2 FROM (
      SELECT {keep}, {layer(0, x)} AS h1 FROM ({source}))))"""


def m5(spark, d):
    out = ml.dense_score(feature_rows(spark, d), FEATURES, LAYERS)
    return out.select("row_id", *[
        F.round(F.get("probs", F.lit(i)), 6).alias(f"p{i}") for i in CLASSES])


RAW_X = "[" + ", ".join(FEATURES) + "]"
DENSE_SQL = f"""
SELECT row_id, round(probs[1], 6) AS p0, round(probs[2], 6) AS p1, round(probs[3], 6) AS p2
FROM ({forward_sql(RAW_X, FEATURES_SQL, 'row_id')})
"""


def with_gaps(spark, d):
    return feature_rows(spark, d).withColumn(
        "iaq", F.when(F.col("row_id") % 9 != 0, F.col("iaq")))


GAPS_SQL = f"SELECT * REPLACE (CASE WHEN row_id % 9 <> 0 THEN iaq END AS iaq) FROM ({FEATURES_SQL})"


def m6(spark, d):
    rows = with_gaps(spark, d)
    out = ml.score_readings(rows, ml.fit_scaler(rows, FEATURES), LAYERS)
    return out.select("row_id", "label", "predicted",
                      F.round("confidence", 6).alias("confidence"), "predicted_name")


_STATS = ", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in FEATURES)
_SCALED = ", ".join(f"({n} - m_{n}) / s_{n} AS {n}" for n in FEATURES)
SCORED_SQL = f"""
WITH x AS ({GAPS_SQL}),
scaled AS (SELECT row_id, {_SCALED} FROM x, (SELECT {_STATS} FROM x)),
p AS ({forward_sql(RAW_X, 'SELECT * FROM scaled WHERE iaq IS NOT NULL', 'row_id')}),
c AS (SELECT row_id, list_max(probs) AS confidence,
             CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS predicted FROM p)
SELECT row_id, label, predicted, round(confidence, 6) AS confidence,
  coalesce(CASE predicted WHEN 0 THEN 'LOW' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'HIGH' END, 'UNKNOWN') AS predicted_name
FROM x LEFT JOIN c USING (row_id)
"""


def m1(spark, d):
    return ml.assign_split(
        ad.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"),
        "o_orderkey", "o_orderpriority")


SPLIT_SQL = """
SELECT o_orderkey, o_orderpriority,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || '42'), o_orderkey)
    <= ceil(0.2e0 * count(*) OVER (PARTITION BY o_orderpriority)) AS is_test
FROM orders
"""


def m2(spark, d):
    """All rows scaled by the mean and deviation of the training rows."""
    rows = feature_rows(spark, d)
    train, _ = ml.stratified_split(rows, "row_id", "label")
    out = ml.standardise(rows, FEATURES, ml.fit_scaler(train, FEATURES))
    return out.select("row_id", *[F.round(n, 6).alias(n) for n in FEATURES])


STANDARDISE_SQL = f"""
WITH x AS ({FEATURES_SQL}),
t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(row_id || '42'), row_id)
        > ceil(0.2e0 * count(*) OVER (PARTITION BY label)) AS is_train FROM x),
p AS (SELECT {_STATS} FROM t WHERE is_train)
SELECT row_id, {", ".join(f"round(({n} - m_{n}) / s_{n}, 6) AS {n}" for n in FEATURES)} FROM x, p
"""


def a4(spark, d):
    p = ml.fit_scaler(feature_rows(spark, d), FEATURES)
    return p.select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


SCALER_SQL = " UNION ALL ".join(
    f"""SELECT '{n}' AS feature, round(avg({n}), 6) AS mean,
    round(stddev_pop({n}), 6) AS scale FROM ({FEATURES_SQL})""" for n in FEATURES
)


def s8(spark, d):
    path = scratch_path(spark, "scaler")
    logs.save_scaler_params(a4(spark, d), path)
    return logs.load_scaler_params(spark, path)


def k1(spark, d):
    p = a4(spark, d).select("feature", F.col("scale").alias("importance"))
    return metrics.rank_features(p)


def k2(spark, d):
    """Discounts and taxes take few values, so ties are common."""
    best, confidence = argmax_class(F.array("l_discount", "l_tax", F.lit(0.04)))
    return ad.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax",
        best.alias("class"), confidence.alias("confidence"))


ARGMAX_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_tax,
  CASE WHEN l_discount >= l_tax AND l_discount >= 0.04e0 THEN 0
       WHEN l_tax >= 0.04e0 THEN 1 ELSE 2 END AS class,
  greatest(l_discount, l_tax, 0.04e0) AS confidence
FROM lineitem
"""


def judged(spark, d):
    return ad.table(spark, d, "lineitem").select(
        (F.col("l_linenumber") % 3).alias("y"), (F.col("l_suppkey") % 3).cast("int").alias("yhat"))


JUDGED_SQL = "SELECT l_linenumber % 3 AS y, CAST(l_suppkey % 3 AS INTEGER) AS yhat FROM lineitem"


def a6(spark, d):
    r = metrics.classification_report(judged(spark, d), "y", "yhat", CLASSES)
    return r.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


REPORT_SQL = f"""
WITH j AS ({JUDGED_SQL}), k(c) AS (VALUES (0), (1), (2)),
m AS (SELECT c, sum((y = c AND yhat = c)::INT)::DOUBLE AS tp, sum((yhat = c)::INT) AS np, sum((y = c)::INT) AS nt
      FROM j, k GROUP BY c),
s AS (SELECT c, tp / np AS p, tp / nt AS r, 2 * tp / (np + nt) AS f, CAST(nt AS BIGINT) AS n FROM m),
a AS (SELECT avg((y = yhat)::INT) AS acc, count(*) AS n FROM j)
SELECT CAST(c AS VARCHAR) AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, n AS support FROM s
UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), n FROM a
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(n) AS BIGINT) FROM s
UNION ALL SELECT 'weighted avg', round(sum(p * n) / sum(n), 6), round(sum(r * n) / sum(n), 6),
  round(sum(f * n) / sum(n), 6), CAST(sum(n) AS BIGINT) FROM s
"""


def a2(spark, d):
    e = ad.events(spark, d).select(
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("iaq"),
        F.when(F.col("event_type") == "click", F.col("value")).alias("o3_ppb"), "value")
    return metrics.null_profile(e, ["iaq", "o3_ppb", "value"])


def learnable_rows(spark, d):
    """The rows with a class that their features decide."""
    first, second = (F.col(FEATURES[0]) + F.col(FEATURES[1]) > 0), (F.col(FEATURES[2]) - F.col(FEATURES[3]) > 0)
    return feature_rows(spark, d).withColumn("label", first.cast("int") + second.cast("int"))


def better_than_majority(scored):
    """Rows judged, and whether more of them are right than always naming the commonest label."""
    per_label = scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == F.col("predicted")).cast("int")).alias("hits"))
    return per_label.agg(F.sum("n").alias("test_rows"), (F.sum("hits") > F.max("n")).alias("beats_majority"))


def m3(spark, d):
    """All rounds at full depth; the model is saved and read before it is used."""
    train, test = ml.stratified_split(learnable_rows(spark, d), "row_id", "label")
    path = scratch_path(spark, "trees")
    boosting.save_trees(spark, ml.train_trees(train, FEATURES), path)
    model = boosting.load_trees(spark, path)
    trees = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("trees"))
    return better_than_majority(ml.predict(model, test)).crossJoin(trees)


def m4(spark, d):
    """All epochs; the weights are saved as a table and read before they are used."""
    train, test = ml.stratified_split(learnable_rows(spark, d), "row_id", "label")
    params = ml.fit_scaler(train, FEATURES)
    path = scratch_path(spark, "weights")
    network.save_layers(spark, ml.train_mlp(ml.standardise(train, FEATURES, params), FEATURES), path)
    weights = spark.read.parquet(path)
    scored = ml.score_readings(test, params, ml.layers_from_table(weights))
    units = weights.agg(F.count(F.lit(1)).alias("units"), F.sum(F.size("weights")).alias("weights"))
    return better_than_majority(scored).crossJoin(units)


_TEST_ROWS = f"""
SELECT CAST(sum(ceil(0.2e0 * n)) AS BIGINT) AS test_rows, TRUE AS beats_majority
FROM (SELECT CAST({FEATURES[0]} + {FEATURES[1]} > 0 AS INTEGER) + CAST({FEATURES[2]} - {FEATURES[3]} > 0 AS INTEGER) AS label,
        count(*) AS n FROM ({FEATURES_SQL}) GROUP BY ALL)"""


def m7(spark, d):
    """The booster of the training rows; one feature is made to follow the label."""
    rows = feature_rows(spark, d).withColumn("iaq", F.col("label") + F.col("iaq") / 4)
    train, _ = ml.stratified_split(rows, "row_id", "label")
    found = ml.feature_importance(spark, ml.train_trees(train, FEATURES))
    best, total = F.max("importance").over(Window.partitionBy()), F.sum("importance").over(Window.partitionBy())
    return found.select(  # one row per feature
        "feature", F.col("importance").between(0, 1).alias("is_share"), (F.abs(total - 1) < 1e-9).alias("adds_to_one"),
        (F.col("importance") == best).alias("is_top"))


QUERIES = {
    "a2_null_profile": a2,
    "a3_log_stats": lambda s, d: metrics.log_stats(ad.table(s, d, "documents"), ["source", "lang"], "text"),
    "a4_fit_scaler": a4,
    "a5_confusion_matrix": lambda s, d: metrics.confusion_matrix(
        judged(s, d), "y", "yhat", CLASSES),
    "a6_classification_report": a6,
    "a7_accuracy": lambda s, d: metrics.accuracy(judged(s, d), "y", "yhat").select(
        F.round("accuracy", 9).alias("accuracy")),
    "f1_select_features": lambda s, d: quality.select_features(feature_rows(s, d)),
    "k1_rank_features": k1,
    "k2_argmax_class": k2,
    "m1_stratified_split": m1,
    "m2_standardise": m2,
    "m3_train_trees": m3,
    "m4_train_mlp": m4,
    "m5_dense_score": m5,
    "m6_score_readings": m6,
    "m7_feature_importance": m7,
    "s8_save_scaler_params": s8,
}
SQL = {
    "a2_null_profile": """
SELECT 'iaq' AS feature, count(*) FILTER (event_id % 7 = 0) AS missing FROM events
UNION ALL SELECT 'o3_ppb', count(*) FILTER (event_type <> 'click') FROM events
UNION ALL SELECT 'value', 0::BIGINT FROM (SELECT 1)""",
    "a3_log_stats": """
SELECT source, lang, count(*) AS samples, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes
FROM documents GROUP BY ALL""",
    "a4_fit_scaler": SCALER_SQL,
    "a5_confusion_matrix": f"""
SELECT CAST(k AS INTEGER) AS actual, count(*) FILTER (yhat = 0) AS pred_0, count(*) FILTER (yhat = 1) AS pred_1,
       count(*) FILTER (yhat = 2) AS pred_2
FROM (VALUES (0), (1), (2)) c(k) LEFT JOIN ({JUDGED_SQL}) ON y = k
GROUP BY k""",
    "a6_classification_report": REPORT_SQL,
    "a7_accuracy": f"SELECT round(avg((y = yhat)::INT), 9) AS accuracy FROM ({JUDGED_SQL})",
    "f1_select_features": f"SELECT * EXCLUDE (row_id, label) FROM ({FEATURES_SQL})",
    "k1_rank_features": f"SELECT feature, scale AS importance FROM ({SCALER_SQL})",
    "k2_argmax_class": ARGMAX_SQL,
    "m1_stratified_split": SPLIT_SQL,
    "m2_standardise": STANDARDISE_SQL,
    "m3_train_trees": f"SELECT test_rows, beats_majority, CAST(300 AS BIGINT) AS trees FROM ({_TEST_ROWS})",
    "m4_train_mlp": f"""
SELECT test_rows, beats_majority, CAST({sum(SIZES[1:])} AS BIGINT) AS units,
  CAST({sum(a * b for a, b in zip(SIZES, SIZES[1:]))} AS BIGINT) AS weights FROM ({_TEST_ROWS})""",
    "m5_dense_score": DENSE_SQL,
    "m6_score_readings": SCORED_SQL,
    "m7_feature_importance": "SELECT unnest([" + ", ".join(f"'{n}'" for n in FEATURES)
        + "]) AS feature, TRUE AS is_share, TRUE AS adds_to_one, feature = 'iaq' AS is_top",
    "s8_save_scaler_params": SCALER_SQL,
}
