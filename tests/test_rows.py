import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postweave import storage
from postweave.functions import vectors as V
from postweave.operators import joins, metrics, rows
from postweave.sources import tables


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(500).select((F.col("id") * 7 % 1009).alias("id"), F.lit("x").alias("text"))


def test_samples(numbers):
    first = {r[0] for r in rows.hash_sample(numbers, 0.3).select("id").collect()}
    again = {r[0] for r in rows.hash_sample(numbers.repartition(9), 0.3).select("id").collect()}
    assert first == again and 100 < len(first) < 200
    exact = [r[0] for r in rows.sample_n(numbers, 50).select("id").collect()]
    assert len(set(exact)) == 50
    assert exact == [r[0] for r in rows.sample_n(numbers.repartition(3), 50).select("id").collect()]
    assert rows.sample_n(numbers, 5000).count() == 500
    assert rows.bernoulli_sample(numbers, 1.0).count() == 500


def test_slice_and_index(numbers):
    ordered = sorted(r[0] for r in numbers.select("id").collect())
    assert [r[0] for r in rows.slice_rows(numbers, 10, 15).select("id").collect()] == ordered[10:15]
    assert rows.slice_rows(numbers, 495, 600).count() == 5
    indexed = {r["id"]: r["index"] for r in rows.row_index(numbers.repartition(6)).collect()}
    assert indexed == {x: i + 1 for i, x in enumerate(ordered)}
    assert rows.row_index(numbers.filter("false")).columns == ["id", "text", "index"]


def test_split_keeps_both_directions_together(spark):
    edges = spark.range(400).select((F.col("id") % 20).alias("src"), (F.col("id") % 23).alias("dst"))
    split = {(r[0], r[1]): r[2] for r in rows.split_edges(edges).collect()}
    assert all(split.get((b, a), s) == s for (a, b), s in split.items())
    assert 0.6 < sum(s == "train" for s in split.values()) / len(split) < 0.95


def test_filters_and_union(spark):
    posts = spark.createDataFrame(
        [(1, "a", [[1.0]]), (2, "", []), (3, None, None)],
        "id bigint, text string, hashtags_embeddings array<array<float>>")
    assert [r["id"] for r in rows.non_empty(posts).collect()] == [1]
    assert [r["id"] for r in rows.has_hashtags(posts).collect()] == [1]
    swapped = posts.select("hashtags_embeddings", "text", "id")
    assert rows.union_posts(posts, swapped, posts).count() == 9


def test_labels(spark):
    posts = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "a")], "id bigint, label string")
    assert sorted(map(tuple, rows.label_index(posts).collect())) == [("a", 0), ("b", 1)]
    assert sorted(map(tuple, rows.label_index(posts, ["z", "b", "a"]).collect())) == [
        ("a", 0), ("b", 1), ("z", 2)]
    assert rows.with_label_index(posts).count() == 3
    assert {tuple(r) for r in rows.label_counts(posts).collect()} == {("a", 2), ("b", 1), (None, 1)}


def test_describe(spark):
    df = spark.createDataFrame([(1, "x"), (3, None)], "n int, s string")
    out = {r["column"]: (r["count"], r["min"], r["max"]) for r in rows.describe(df, ["n"]).collect()}
    assert out == {"n": (2, "1", "3")}


def test_relabel_and_hydrate(spark):
    posts = spark.createDataFrame(
        [("old", 1, 2012, 1, 2, "t", "m", "h"), ("old", 2, 2012, 1, 2, "t", "m", "h")],
        "label string, id bigint, year int, month int, day int, text string, mentions string, hashtags string")
    ids = spark.createDataFrame([("new", "1"), ("gone", "5")], "label string, id string")
    assert [tuple(r) for r in joins.relabel(posts, ids).collect()] == [
        ("new", 1, 2012, 1, 2, "t", "m", "h")]
    assert [(r["label"], r["id"]) for r in joins.hydrate(ids, posts).collect()] == [("new", 1)]


def test_labelled_files_and_tables(spark, tmp_path):
    folder = tmp_path / "ids"
    folder.mkdir()
    (folder / "2012-a.ids").write_text("1\n2\n")
    (folder / "2014-b.ids").write_text("3\n")
    (folder / tables.EXCLUDED_FILE).write_text("4\n")
    found = {tuple(r) for r in tables.labelled_ids(spark, str(folder)).collect()}
    assert found == {("2012-a.ids", "1"), ("2012-a.ids", "2"), ("2014-b.ids", "3")}

    posts = tables.rows_to_frame(spark, [("a", 1, 2012, 1, 1, "t"), ("a", 2, 2012, 1, 1, ""), ("a", 3, 2013, 1, 1, None)])
    path = str(tmp_path / "posts")
    tables.save_posts(posts, path, partition="year")
    assert [r["id"] for r in tables.load_posts(spark, path).collect()] == [1]
    with pytest.raises(Exception):
        tables.save_posts(posts, path)
    tables.save_posts(posts.limit(1), path, mode="overwrite")
    assert spark.read.parquet(path).count() == 1


def test_keyword_search(spark):
    at = lambda s: datetime.datetime(2014, 1, 1, 0, 0, s)
    posts = spark.createDataFrame(
        [(1, "a cat", at(1)), (2, "cat", at(5)), (3, "dog", at(4)), (4, "cats", at(4)), (5, "cat", at(9))],
        "id bigint, text string, at timestamp_ntz")
    found = tables.keyword_search(posts, F.col("text"), F.col("at"), "cat", "2014-01-01 00:00:05", 2)
    assert [r["id"] for r in found.collect()] == [2, 4]


def test_stage_reload(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "stage")
    assert storage.load_or_compute(spark, path, compute).count() == 3
    assert storage.load_or_compute(spark, path, compute).count() == 3
    assert calls == [1]


def test_shared_folder_comes_from_the_session(spark):
    configured = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
                  or spark.conf.get("spark.sql.warehouse.dir"))
    used = storage.shared_dir(spark)
    assert used.startswith(configured.rstrip("/"))
    assert storage.scratch_path(spark, "x").startswith(used)


def test_metrics(spark):
    rng = np.random.default_rng(1)
    label, score = rng.integers(2, size=300), rng.integers(12, size=300) / 10
    df = spark.createDataFrame(
        [(int(a), float(b), int(b > 0.5)) for a, b in zip(label, score)], "label int, score double, prediction int")
    pos, neg = score[label == 1], score[label == 0]
    expected = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    assert metrics.auroc(df, F.col("score")).first()[0] == pytest.approx(expected)
    row = metrics.confusion(df).first()
    tp, fp = int(((score > .5) & (label == 1)).sum()), int(((score > .5) & (label == 0)).sum())
    assert (row["tp"], row["fp"]) == (tp, fp)
    assert row["precision"] == pytest.approx(tp / (tp + fp))
    assert metrics.confusion(df.filter("false")).first()["f1"] is None
    one = df.withColumn("score", F.lit(1.0))
    assert metrics.auroc(one, F.col("score")).first()[0] == 0.5
    many = spark.range(5000).select((F.col("id") % 2).cast("int").alias("label"), (F.col("id") * 0.001).alias("score"))
    assert metrics.auroc(many, F.col("score")).first()[0] == pytest.approx(0.5002)


def test_embedding(spark, monkeypatch):
    rows_ = [(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["c"] * 50)]
    df = spark.createDataFrame(rows_, "id int, token array<string>").coalesce(1)
    monkeypatch.setattr(V, "TOKENS_PER_BATCH", 10)

    def encoder():
        return lambda words: np.array([[ord(w), 1.0] for w in words])

    out = {r["id"]: r["word_embeddings"] for r in V.embed_tokens(df, encoder).collect()}
    assert out[1] == [[97.0, 1.0], [98.0, 1.0], [97.0, 1.0]]
    assert out[2] == [] and out[3] is None and out[4] == [[99.0, 1.0]] * 50
    means = V.embed_tokens(df, encoder).select("id", V.mean_vector(F.col("word_embeddings")).alias("m"))
    assert {r["id"]: r["m"] for r in means.collect()} == {
        1: [pytest.approx(292 / 3), 1.0], 2: None, 3: None, 4: [99.0, 1.0]}
    first = V.embed_tokens(df).filter("id = 1").select(
        V.finish_vector(F.col("word_embeddings")).alias("v")).first()["v"]
    assert len(first) == V.HASH_DIMENSIONS and max(abs(first.toArray())) <= 1


def test_scratch_is_per_application(spark):
    path = storage.scratch_path(spark, "x")
    assert spark.sparkContext.applicationId in path and path != storage.scratch_path(spark, "x")


def test_vectors_come_back_in_bounded_batches():
    rows = [["a", "b"] * 5, None, [], *[["c"] * 10] * 57]
    parts = list(V._vector_batches(iter([pa.array(rows), pa.array(rows[:0], pa.list_(pa.string()))]), V.hash_encoder(), 100))
    assert len(parts) == 6 and max(len(p.flatten()) for p in parts) <= 100
    whole = V._token_vectors(pa.array(rows), V.hash_encoder())
    assert [v for p in parts for v in p.to_pylist()] == whole.to_pylist()
