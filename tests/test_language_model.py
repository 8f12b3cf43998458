"""Trigrams of texts are counted once, and hashed as MLlib hashes them."""

from collections import Counter

import pytest
from pyspark.ml.feature import HashingTF, NGram
from pyspark.sql import functions as F

from postweave import storage
from postweave.operators import learn as L

TEXTS = ["", "ab", "abc", "Banana banana bandana", "äöü ÄÖÜ ß İstanbul", "日本語の文 text", "a\U0001f600b\U0001f600c\U00010348",
         "zero\x00byte\x00", "x" * 5000, "line\nbreak\tand tab", "\U0001f600\U0001f600\U0001f600"]


@pytest.mark.parametrize("features", [1 << 14, 1000])
def test_trigrams_equal_those_of_mllib(spark, monkeypatch, features):
    monkeypatch.setattr(L, "SLICE_CHARACTERS", 40)
    posts = spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string").coalesce(1)
    found = {r["id"]: r["counts"] for r in L.count_trigrams(posts, ["id"], features).collect()}
    grams = NGram(n=3, inputCol="characters", outputCol="grams").transform(
        posts.withColumn("characters", F.split(F.lower("text"), "")))
    expected = HashingTF(inputCol="grams", outputCol="counts", numFeatures=features).transform(grams).collect()
    assert found == {r["id"]: r["counts"] for r in expected}


def test_texts_are_counted_once_for_training_and_detection(spark, monkeypatch):
    # Null texts have no trigrams, and are classified like the others.
    rows = [(i, "de" if i % 2 else "en", "der die das und nicht" if i % 2 else "the one that was there") for i in range(40)]
    posts = spark.createDataFrame([*rows, (40, "en", None), (40, None, None)], "id bigint, lang string, text string")
    written, real = Counter(), storage.materialize

    def noted(df, name):
        written[name] += 1
        return real(df, name)

    monkeypatch.setattr(L, "materialize", noted)
    counted = L.count_trigrams(posts)
    out = L.detect_language(L.fit_language_model(counted.filter("id < 30")), counted).collect()
    assert len(out) == 42 and all(r["language"] == r["lang"] for r in out if r["id"] < 40)
    assert out[0].asDict().keys() == {"id", "lang", "text", "language"}
    assert written["trigrams"] == 1
