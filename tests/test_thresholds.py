"""Class weights, thresholds and samples of streams."""

import random

import pytest
from pyspark.sql import functions as F

from postweave.operators import learn, metrics, rows
from postweave.storage import scratch_path
from postweave.streaming.sample import StreamSample


@pytest.mark.parametrize("seed", [1, 2])
def test_curve_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    data = [(rng.randrange(101) / 100, int(rng.random() < .2)) for _ in range(300)] + [(None, 1), (1.0, 0), (0.0, 1)]
    scored = spark.createDataFrame(data, "score double, label int")
    found = {r["bin"]: r for r in metrics.precision_recall(scored, F.col("score"), bins=20).collect()}
    known = [(min(int(round(s * 20, 6)), 19), label) for s, label in data if s is not None]
    assert found.keys() == {b for b, _ in known}
    every = sum(label for _, label in known)
    for b, r in found.items():
        tp, n = (sum(x for c, x in known if c >= b), sum(c >= b for c, _ in known))
        assert (r["tp"], r["fp"], r["threshold"]) == (tp, n - tp, b / 20)
        assert r["precision"] == tp / n and r["recall"] == tp / every
    for least in (0.0, 0.5, 0.9, 1.0):
        cut = metrics.threshold_for_recall(metrics.precision_recall(scored, F.col("score"), bins=20), least)
        assert cut == max(b / 20 for b, r in found.items() if r["recall"] >= least)
    assert metrics.threshold_for_recall(metrics.precision_recall(scored.filter("false"), F.col("score")), 0.5) == 0.0


def test_rare_edges_weigh_as_much_and_are_found(spark):
    rng = random.Random(3)
    # One edge in twenty is within a label; its distances overlap with those of the others.
    data = [(i, i + 1, rng.gauss(.3 if i % 20 == 0 else .7, .15), .5, .5, int(i % 20 == 0)) for i in range(3000)]
    edges = spark.createDataFrame(data, "src int, dst int, sentence_distance double, word_distance double, "
                                        "hashtag_distance double, label int")
    weights = {r["label"]: r["w"] for r in learn.balanced_weights(edges).groupBy("label").agg(
        F.sum("weight").alias("w")).collect()}
    assert weights[0] == pytest.approx(1500) and weights[1] == pytest.approx(1500)
    train, test = edges.filter("src % 3 > 0"), edges.filter("src % 3 = 0")
    recall = {}
    for balanced in (False, True):
        scored = learn.score_edges(learn.fit_edge_classifier(train, balanced=balanced), test)
        recall[balanced] = metrics.confusion(scored).first()["recall"]
    assert recall[True] > recall[False]
    model = learn.fit_edge_classifier(train, balanced=True)
    curve = metrics.precision_recall(learn.score_edges(model, train, keep_probability=True), F.col("probability"))
    cut = metrics.threshold_for_recall(curve, 0.95)
    kept = learn.score_edges(model, test, keep_probability=True).filter(F.col("probability") >= cut)
    assert kept.filter("label = 1").count() >= 0.6 * test.filter("label = 1").count()


def test_sample_of_a_stream_equals_that_of_the_table(spark):
    posts = spark.range(500).selectExpr("id", "concat('p', id) text")
    found = StreamSample(spark, scratch_path(spark, "sample"), posts.schema, 20)
    rng = random.Random(4)
    shuffled = rng.sample(range(500), 500)
    for number in range(4):
        own = shuffled[number * 125:number * 125 + 125] if number < 3 else []
        batch = posts.filter(F.col("id").isin(own))
        found.update(batch, number)
        found.update(batch, number)
        arrived = posts.filter(F.col("id").isin(shuffled[:min(number + 1, 3) * 125]))
        assert sorted(found.sample().collect()) == sorted(rows.sample_n(arrived, 20).collect())
