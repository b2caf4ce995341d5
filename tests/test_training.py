"""Boosted trees and the network against plain versions without Spark."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetair.checks import models
from fleetair.operators import boosting, ml, network


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(400, 4)), 2)
    y = ((x[:, 0] > 0.3).astype(int) + (x[:, 1] + 0.3 * x[:, 2] > 0)).astype(int)
    return x, y


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y = data
    return spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<double>, y int")


def plain_round(x, y, margin, cuts, depth, rate):
    """One tree per class by trying every cut at every node; its change of the margins."""
    p = np.exp(margin - margin.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    out = np.zeros_like(margin)
    for c in range(margin.shape[1]):
        g, h = p[:, c] - (y == c), np.maximum(2 * p[:, c] * (1 - p[:, c]), 1e-16)

        def grow(at, left, c=c, g=g, h=h):
            def score(some):
                return g[some].sum() ** 2 / (h[some].sum() + boosting.L2)

            best = (1e-6, None)
            for f in range(x.shape[1]):
                for cut in cuts[f]:
                    right = at & (x[:, f] >= cut)
                    rest = at & ~right
                    if min(h[right].sum(), h[rest].sum()) >= boosting.MIN_WEIGHT:
                        gain = score(right) + score(rest) - score(at)
                        if gain > best[0] + 1e-9:
                            best = (gain, (rest, right))
            if best[1] is None or not left:
                out[at, c] = -rate * g[at].sum() / (h[at].sum() + boosting.L2)
                return
            for side in best[1]:
                grow(side, left - 1)

        grow(np.ones(len(x), bool), depth)
    return margin + out


@pytest.mark.parametrize("shard", [1 << 20, 90])
def test_trees_equal_plain_trees(spark, rows, data, monkeypatch, shard):
    monkeypatch.setattr(boosting, "SHARD_ROWS", shard)
    monkeypatch.setattr(boosting, "KEEP_ROUNDS", 2)
    x, y = data
    model = boosting.train_trees(rows, list("abcd"), 3, rounds=5, depth=3, rate=0.3, bins=16)
    cuts = boosting._cuts(rows, 4, 16)
    assert all(3 < len(c) < 16 for c in cuts)
    want = np.zeros((len(x), 3))
    for _ in range(5):
        want = plain_round(x, y, want, cuts, 3, 0.3)
    assert np.allclose(model.margins(x), want)
    assert (model.margins(x).argmax(axis=1) == y).mean() > 0.9
    share = boosting.importances(model)
    assert sum(share.values()) == pytest.approx(1) and share["d"] < min(share["a"], share["b"])


def test_trees_are_saved_whole(spark, rows, data, tmp_path):
    model = boosting.train_trees(rows, list("abcd"), 3, rounds=2, depth=2)
    boosting.save_trees(spark, model, str(tmp_path / "m"))
    again = boosting.load_trees(spark, str(tmp_path / "m"))
    assert again.features == model.features and again.classes == 3
    assert (again.margins(data[0]) == model.margins(data[0])).all()
    scored = rows.select(boosting.tree_margins(F.col("x"), again).alias("m")).collect()
    assert np.allclose([r.m for r in scored], model.margins(data[0]))


def test_trees_of_one_class_and_of_constant_features(spark):
    rows = spark.createDataFrame([([1.0], 2)] * 20, "x array<double>, y int")
    model = boosting.train_trees(rows, ["a"], 3, rounds=2, depth=2)
    assert model.margins(np.array([[1.0]])).argmax() == 2
    assert (model.feature == -1).all() and boosting.importances(model) == {"a": 0.0}
    with pytest.raises(ValueError, match="no complete labelled rows"):
        boosting.train_trees(rows.where("false"), ["a"], 3)


def test_gradient_is_the_slope():
    rng, sizes = np.random.default_rng(1), (3, 5, 4, 2)
    flat = network.first_weights(sizes, 7) + rng.normal(0, 0.1, 3 * 5 + 5 + 5 * 4 + 4 + 4 * 2 + 2)
    x, y, mask = rng.normal(size=(6, 3)), rng.integers(0, 2, 6), (rng.random((6, 5)) > 0.3) / 0.7
    g, loss = network.gradient(flat, sizes, x, y, mask)
    for i in range(0, len(flat), 5):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (network.gradient(flat + s * step, sizes, x, y, mask)[1] for s in (1, -1))
        assert g[i] == pytest.approx((up - down) / 2e-6 / 6, abs=1e-6)
    assert loss > 0


@pytest.mark.parametrize("shard", [1 << 20, 90])
def test_network_learns_and_is_saved(spark, rows, data, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(network, "SHARD_ROWS", shard)
    layers, losses = network.train_mlp(rows, (4, 16, 8, 3), epochs=25, rate=0.02, dropout=0.1)
    assert len(losses) == 25 and losses[-1] < 0.5 * losses[0]
    assert [y["act"] for y in layers] == ["relu", "relu", "softmax"]
    network.save_layers(spark, layers, str(tmp_path / "w"))
    again = ml.layers_from_table(spark.read.parquet(str(tmp_path / "w")))
    assert again == layers
    hits = ml.dense_score(rows, "x", again).collect()
    assert np.mean([int(np.argmax(r.probs)) == r.y for r in hits]) > 0.85
    same, _ = network.train_mlp(rows, (4, 16, 8, 3), epochs=2)
    assert same == network.train_mlp(rows, (4, 16, 8, 3), epochs=2)[0]


def derived(plan):
    own = plan.getAllValidConstraints(plan.projectList()).size() if plan.nodeName() == "Project" else 0
    return max([own, *(derived(plan.children().apply(i)) for i in range(plan.children().size()))])


def test_planning_does_not_double_with_each_feature(spark):
    """What the planner knows of complete rows grows with the features, not with their subsets."""
    names = [f"f{i}" for i in range(9)]
    wide = spark.createDataFrame([(i, i % 3, [float(i)] * 9) for i in range(40)], "id long, label int, e array<double>")
    df = wide.select("id", "label", *[F.get("e", F.lit(i)).alias(n) for i, n in enumerate(names)])
    train, _ = ml.stratified_split(df, "id", "label")
    assert 9 < derived(ml._vectors(train, names, "label")._jdf.queryExecution().optimizedPlan()) < 50


def test_only_complete_rows_are_learned_from(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, "2", 0), (None, "2", 1), (1.5, None, 1), (nan, "3", 2), (2.0, "4", 3), (3.0, "5", None)], "a double, b string, label int")
    assert [(str(r.x), r.y) for r in ml._vectors(df, ["a", "b"], "label").collect()] == [("[1.0, 2.0]", 0), ("[nan, 3.0]", 2)]
    assert ml._vectors(df, [], "label").count() == 4


def test_planning_of_the_queries_features(spark, sf):
    rows = models.feature_rows(spark, sf).withColumn("iaq", F.col("label") + F.col("iaq") / 4)
    train, _ = ml.stratified_split(rows, "row_id", "label")
    assert 16 < derived(ml._vectors(train, models.FEATURES, "label")._jdf.queryExecution().optimizedPlan()) < 300


def test_margins_follow_each_row(spark):
    """Trees with leaves on all levels, over numbers and over bins."""
    rng = np.random.default_rng(8)
    feature, threshold, value = rng.integers(0, 4, (6, 15)), np.round(rng.normal(size=(6, 15)), 1), rng.normal(size=(6, 15))
    feature[rng.random((6, 15)) < 0.3] = feature[:, 7:] = -1
    feature[0, 0] = -1
    x = np.round(rng.normal(size=(200, 4)), 1)
    x[:3] = [[np.nan] * 4, [np.inf] * 4, [-np.inf] * 4]
    for data, cut in ((x, threshold), (rng.integers(0, 9, (200, 4)).astype(np.int16), rng.integers(1, 9, (6, 15)))):
        want = np.zeros((200, 3))
        for r, row in enumerate(data):
            for t in range(6):
                at = 0
                while feature[t, at] >= 0:
                    at = 2 * at + 1 + bool(row[feature[t, at]] >= cut[t, at])
                want[r, t % 3] += value[t, at]
        assert (boosting._margins(data, feature, cut, value, 3) == want).all()
