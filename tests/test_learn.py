import pytest
from pyspark.sql import functions as F

from postweave.functions.vectors import cosine_distance
from postweave.operators import learn as L, metrics, rows

EDGES = "src bigint, dst bigint, sentence_distance double, word_distance double, hashtag_distance double"


def test_edge_labels_treat_two_missing_labels_as_equal(spark):
    vertices = spark.createDataFrame(
        [(1, "a", "t"), (2, "a", "t"), (3, None, "t"), (4, None, "t")], "id bigint, label string, text string")
    edges = spark.createDataFrame([(1, 2), (1, 3), (3, 4), (1, 9), (9, 1)], "src bigint, dst bigint")
    for hot_rows in (1, 1_000_000):
        out = {(r[0], r[1]): r[2] for r in L.edge_labels(edges, vertices, hot_rows).collect()}
        assert out == {(1, 2): 1, (1, 3): 0, (3, 4): 1}


@pytest.fixture(scope="module")
def labelled(spark):
    noise = F.rand(1) * 0.4
    return spark.range(400).select(
        F.col("id").alias("src"), (F.col("id") * 3 % 97).alias("dst"),
        (F.col("id") % 4 == 0).cast("int").alias("label"),
    ).withColumns({
        "sentence_distance": F.when(F.col("label") == 1, 0.2).otherwise(0.5) + noise,
        "word_distance": F.when(F.col("label") == 1, 0.1).otherwise(0.5) + noise,
        "hashtag_distance": F.when(F.col("src") % 10 == 0, None).otherwise(F.lit(0.5)),
    }).cache()


def test_edge_classifier(spark, labelled, tmp_path):
    model = L.fit_edge_classifier(labelled)
    assert (model.getNumTrees, model.getOrDefault("maxDepth"), model.getOrDefault("maxBins")) == (30, 15, 32)
    scored = L.score_edges(model, labelled)
    # Edges without a hashtag distance cannot be scored.
    assert scored.count() == 360
    assert {"rawPrediction", "probability", "features"}.isdisjoint(scored.columns)
    assert metrics.confusion(scored).first()["accuracy"] > 0.95
    L.save_model(model, str(tmp_path / "model"))
    L.save_model(model, str(tmp_path / "model"))
    again = L.score_edges(L.load_edge_classifier(str(tmp_path / "model")), labelled)
    assert sorted(again.select("src", "prediction").collect()) == sorted(
        scored.select("src", "prediction").collect())
    ranked = L.score_edges(model, labelled, keep_probability=True)
    assert metrics.auroc(ranked, F.col("probability")).first()[0] > 0.95


def test_two_features_keep_edges_without_hashtags(labelled):
    model, scores = L.search_edge_classifier(labelled, features=2, trees=(5,), depths=(4,))
    assert L.score_edges(model, labelled, 2).count() == 400
    assert len(scores) == 1 and scores[0] > 0.9


def test_topic_models(spark, vectors):
    scored = L.classify_topics(L.fit_topic_classifier(vectors), vectors)
    right = scored.filter("label_idx = prediction").count()
    assert right / scored.count() > 0.5
    clusters = L.kmeans_topics(vectors, 10)
    assert clusters.count() == vectors.count()
    assert clusters.select("cluster").distinct().count() <= 10


def test_assign_centroid(spark):
    posts = spark.createDataFrame(
        [(1, "a", [0.0, 0.0]), (2, "a", [2.0, 0.0]), (3, "b", [9.0, 9.0]), (4, "b", [9.0, 7.0]), (5, "a", [1.5, 0.0])],
        "id bigint, label string, sentence_embeddings array<float>")
    centroids = L.label_centroids(posts.filter("id < 5"))
    assert {r["label"]: (r["centroid"], r["threshold"]) for r in centroids.collect()} == {
        "a": ([1.0, 0.0], 1.0), "b": ([9.0, 8.0], 1.0)}
    # On the threshold is not within it.
    assert {r[0]: r[1] for r in L.assign_centroid(posts, centroids).collect()} == {
        1: -1, 2: -1, 3: -1, 4: -1, 5: 0}


def test_pca_spreads_most_on_the_first_axis(spark, vectors):
    axes = L.pca(vectors, extra=vectors.limit(1).withColumn("id", F.lit(10**6).cast("bigint")))
    assert axes.count() == vectors.count() + 1
    spread = axes.select(*(F.variance(F.col("pc")[i]) for i in range(3))).first()
    assert spread[0] >= spread[1] >= spread[2] > 0


def test_language_identification(spark):
    from postweave.sources import derive

    posts = derive.posts(spark, "/root/testdata/sf0.001")
    train, test = posts.filter("id % 2 = 0"), posts.filter("id % 2 = 1")
    out = L.detect_language(L.fit_language_model(train), test)
    assert out.filter("lang = language").count() / test.count() >= 0.9


def test_word_vectors_tell_topics_apart(spark):
    import random

    import numpy as np

    rng = random.Random(1)
    topics = [[f"a{i}" for i in range(8)], [f"b{i}" for i in range(8)]]
    rows = [(k, [rng.choice(topics[k % 2]) for _ in range(30)]) for k in range(300)]
    posts = spark.createDataFrame(rows + [(900, ["a1", "unknown"]), (901, [])], "id bigint, token array<string>")
    words = L.fit_word_vectors(posts, size=8, partitions=1).cache()
    found = {r["word"]: np.array(r["vector"]) / np.linalg.norm(r["vector"]) for r in words.collect()}
    same = np.mean([found["a0"] @ found[w] for w in topics[0][1:]])
    other = np.mean([found["a0"] @ found[w] for w in topics[1]])
    assert "unknown" not in found and same > other + 0.2
    embedded = {r["id"]: r["word_embeddings"] for r in L.embed_by_table(posts, words, size=8).collect()}
    assert len(embedded) == 302 and embedded[901] == [] and embedded[900][1] == [0.0] * 8
    assert np.allclose(embedded[900][0] / np.linalg.norm(embedded[900][0]), found["a1"], atol=1e-6)


def test_any_number_of_centroids(spark):
    rows = [(i, f"l{i:05d}", [float(i), 0.0]) for i in range(12_000)]
    posts = spark.createDataFrame(rows, "id bigint, label string, sentence_embeddings array<float>")
    centroids = spark.createDataFrame(
        [(label, v, 0.5) for _, label, v in rows], "label string, centroid array<double>, threshold double")
    out = {r["id"]: r["cluster"] for r in L.assign_centroid(posts.filter("id % 400 = 0"), centroids).collect()}
    assert out == {i: i for i in range(0, 12_000, 400)}
