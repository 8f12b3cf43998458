"""Registered queries against their SQL counterparts, at the smallest scale."""

import pytest

import __spark_entry__ as registered
from check import database, difference
from conftest import SMALL

QUICK = [
    "load_posts", "labelled_ids", "hydrate_posts", "keyword_search", "relabel_posts", "has_hashtags",
    "hash_sample", "sample_n", "slice_rows", "clean_urls", "split_hashtag", "mask_mentions",
    "clean_post", "sentences", "tokens", "token_positions", "select_by_index", "text_with_info",
    "word_vectors", "hashtag_vectors", "date_bucket", "date_parts", "bucket_pairs",
    "threshold_pairs", "online_neighbors", "nearest_neighbors", "most_similar", "closest_words",
    "proximity_edges", "confusion", "auroc", "row_index", "label_index", "assign_centroid",
    "language_id", "classify_topics", "score_edges", "cut_edges", "kmeans_topics", "searched_classifier", "pca3",
    "pca3_with_vector",
]


@pytest.fixture(scope="module")
def connection():
    return database(SMALL)


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, connection, name):
    frame = registered.queries()[name](spark, SMALL)
    assert difference(frame, connection.execute(registered.oracle_sql()[name])) == ""


def test_every_oracle_has_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_entry(spark):
    assert registered.entry(spark).columns == ["src", "dst", "sentence_distance"]
