"""Words outside the trained vocabulary."""

import numpy as np

from postweave.functions.vectors import hash_encoder
from postweave.operators import learn as L
from postweave.storage import noted_tables


def test_rare_words_get_hashed_vectors(spark):
    posts = spark.createDataFrame([(1, ["known", "rare"]), (2, ["rare"]), (3, [])], "id bigint, token array<string>")
    words = spark.createDataFrame([("known", [3.0] + [0.0] * 31)], "word string, vector array<float>")
    found = {r["id"]: r["word_embeddings"] for r in L.embed_by_table(posts, words, hash_unknown=True).collect()}
    code = hash_encoder()(["rare"])[0]
    expected = code / np.linalg.norm(code) * 3.0
    assert found[1][0] == [3.0] + [0.0] * 31 and found[3] == []
    assert np.allclose(found[1][1], expected, atol=1e-6) and np.allclose(found[2][0], expected, atol=1e-6)


def test_a_rare_word_is_hashed_once(spark):
    posts = spark.createDataFrame([(1, ["known", "rare", "rare"]), (2, ["rare", "odd"]), (2, ["rare", None])],
                                  "id bigint, token array<string>")
    words = spark.createDataFrame([("known", [3.0] + [0.0] * 31)], "word string, vector array<float>")
    with noted_tables() as made:
        found = L.embed_by_table(posts, words, hash_unknown=True).collect()
    hashed = [r["word"] for t in made if "word" in t.columns for r in t.collect()]
    assert sorted(hashed) == ["odd", "rare"]
    # Tokens that are null count as empty.
    code = hash_encoder()([""])[0]
    ours = [v for r in found if r["id"] == 2 for v in r["word_embeddings"]]
    assert any(np.allclose(v, code / np.linalg.norm(code) * 3.0, atol=1e-6) for v in ours)


def test_the_vocabulary_has_a_bound(spark):
    rows = [(i, [f"w{j}" for j in range(1, 21) if i < j * 5]) for i in range(100)]
    tokens = spark.createDataFrame(rows, "id bigint, token array<string>")
    # w1 occurs 5 times, w2 10 times, and so on.
    assert [L.least_count_within(tokens, "token", 5, n) for n in (20, 19, 4)] == [5, 6, 81]
    assert L.fit_word_vectors(tokens, size=4, partitions=1, most_words=4).count() == 4
