"""Learned queries return every row of their table, not only the held-out ones."""

from pyspark.sql import functions as F

import __spark_entry__ as registered
from conftest import SMALL
from postweave.operators import learn as L
from postweave.sources import derive


def test_language_id_returns_every_post(spark):
    found = registered.queries()["language_id"](spark, SMALL).collect()
    posts = derive.posts(spark, SMALL).select("id", "lang").collect()
    assert sorted((r["id"], r["lang"]) for r in found) == sorted(map(tuple, posts))
    assert all(r["accurate"] for r in found)


def test_classify_topics_returns_every_post(spark, vectors):
    found = registered.queries()["classify_topics"](spark, SMALL).collect()
    labels = sorted({r["label"] for r in vectors.select("label").collect()})
    assert sorted((r["id"], r["label"], r["label_idx"]) for r in found) == sorted(
        (r["id"], r["label"], labels.index(r["label"])) for r in vectors.select("id", "label").collect())
    assert all(r["known"] for r in found)


def test_labels_outside_the_training_posts_are_classified(vectors):
    train = vectors.filter(F.col("label") != vectors.agg(F.min("label")).first()[0])
    scored = L.classify_topics(L.fit_topic_classifier(train, vectors), vectors)
    assert scored.count() == vectors.count()
