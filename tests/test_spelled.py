"""Posts that hold tokens instead of vectors: the same edges, with nothing as wide as a vector per token stored or sent."""

import numpy as np
import pytest

from postweave.operators import elements as E
from postweave.operators import learn as L
from postweave.plans import offline
from postweave.storage import materialize, noted_tables

WORDS = "the of and cat dog bird tree house river stone".split()


@pytest.fixture(scope="module")
def posts(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(WORDS + [f"rare{i}", "."], size=rng.integers(1, 9)))
        rows.append((i, f"l{i % 3}", 2012, 1 + i % 12, 5, text + (f" #Tag{i % 4} #Tag{i % 4}" if i % 5 else "")))
    rows += [(100, "l0", 2012, 1, 1, None), (101, "l0", 2012, 1, 1, "")]
    return materialize(spark.createDataFrame(rows, "id bigint, label string, year int, month int, day int, text string"), "p")


@pytest.fixture(scope="module")
def words(spark):
    vectors = np.random.default_rng(6).normal(size=(6, 32))
    # The last of them has no direction.
    vectors[5] = 0
    return materialize(spark.createDataFrame(
        [(w, [float(x) for x in v]) for w, v in zip(WORDS, vectors)], "word string, vector array<float>"), "w")


def both(posts, words):
    encoder = L.table_encoder(words)
    return (materialize(offline.post_vectors(posts, words), "vectors"),
            materialize(offline.post_vectors(posts, encoder, spelled=True), "spelled"), encoder)


def test_spelled_posts_have_the_same_sentence_vectors(posts, words):
    vectors, spelled, _ = both(posts, words)
    one, two = ({r["id"]: r["sentence_embeddings"] for r in df.collect()} for df in (vectors, spelled))
    assert one.keys() == two.keys() and len(one) == 62
    for key, vector in one.items():
        assert (vector is None) == (two[key] is None)
        assert vector is None or np.allclose(vector, two[key], atol=1e-6)
    assert dict(spelled.dtypes)["word_embeddings"] == dict(spelled.dtypes)["hashtags_embeddings"] == "array<string>"


@pytest.mark.parametrize("round_bytes", [10**9, 20_000])
def test_spelled_posts_have_the_same_edges(spark, posts, words, monkeypatch, round_bytes):
    monkeypatch.setattr(E, "ROUND_BYTES", round_bytes)
    monkeypatch.setattr(E, "EDGES_AT_ONCE", 7)
    vectors, spelled, encoder = both(posts, words)
    ids = [r["id"] for r in posts.select("id").collect()]
    near = materialize(spark.createDataFrame(
        [(a, b, 0.5) for a in ids[:20] + [100, 101, 999] for b in ids if a != b],
        "src bigint, dst bigint, sentence_distance double"), "near")
    with noted_tables() as made:
        ours = E.proximity_edges(near, spelled, encoder=encoder)
        found = {(r["src"], r["dst"]): (r["word_distance"], r["hashtag_distance"]) for r in ours.collect()}
    expected = {(r["src"], r["dst"]): (r["word_distance"], r["hashtag_distance"])
                for r in E.proximity_edges(near, vectors).collect()}
    assert found.keys() == expected.keys()
    for key, pair in expected.items():
        for x, y in zip(pair, found[key]):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-6), key
    assert any(0 < p[0] for p in expected.values() if p[0] is not None)
    # Rounds of a bounded size.
    assert (len(made) > 3) == (round_bytes == 20_000)


def test_topics_of_texts_stores_no_vector_per_token(spark):
    import __spark_entry__ as registered
    from conftest import SMALL
    with noted_tables() as made:
        found = registered.queries()["topics_of_texts"](spark, SMALL).collect()
    assert len(found) == 200 and all(r["well_named"] and r["known"] for r in found)
    assert not [t for t in made if "array<array<float>>" in dict(t.dtypes).values()]
