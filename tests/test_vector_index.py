"""The stored vector index against brute force."""

import numpy as np
import pytest

from postweave.operators import vector_index as V
from postweave.storage import scratch_path


def posts_of(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)],
                                 "id bigint, sentence_embeddings array<float>")


def clustered(seed, size=600, width=12, centres=15):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width))
    vectors = (middle[rng.integers(0, centres, size)] + rng.normal(size=(size, width)) * .15).astype(np.float32)
    # Copies, and vectors without a direction.
    vectors[5:25] = vectors[4]
    vectors[30], vectors[31] = 0, np.nan
    return vectors


def brute_force(vectors, queries, n):
    found = {}
    usable = [i for i, v in enumerate(vectors) if np.isfinite(v).all() and v.any()]
    unit = {i: vectors[i].astype(np.float64) / np.linalg.norm(vectors[i].astype(np.float64)) for i in usable}
    for q in queries:
        if q in unit:
            near = sorted((round(1 - float(unit[q] @ unit[i]), 9), i) for i in usable if i != q)[:n]
            found[q] = [i for _, i in near]
    return found


def lists_of(frame):
    found = {}
    for r in frame.orderBy("query", "distance", "id").collect():
        found.setdefault(r["query"], []).append(r["id"])
    return found


@pytest.fixture(scope="module")
def built(spark):
    vectors = clustered(1)
    posts = posts_of(spark, vectors)
    return vectors, posts, V.build(posts, scratch_path(spark, "index"), cells=16, parts=4, sample=300)


def test_every_vector_is_indexed(spark, built):
    vectors, _, index = built
    rows = index.table(spark).collect()
    assert sorted(r["id"] for r in rows) == [i for i in range(len(vectors)) if i not in (30, 31)]
    assert {len(r["code"]) for r in rows} == {4}


@pytest.mark.parametrize("block_rows,block_queries", [(V.BLOCK_ROWS, V.BLOCK_QUERIES), (7, 3)])
def test_exact_search_equals_brute_force(built, block_rows, block_queries):
    vectors, posts, index = built
    asked = posts.filter("id % 9 = 3 OR id < 8")
    found = V.search(index, asked, 6, exact=True, block_rows=block_rows, block_queries=block_queries)
    ids = [i for i in range(len(vectors)) if i % 9 == 3 or i < 8]
    assert lists_of(found) == brute_force(vectors, ids, 6)


@pytest.mark.parametrize("block_rows,block_queries", [(V.BLOCK_ROWS, V.BLOCK_QUERIES), (7, 3)])
def test_few_cells_find_nearly_all(built, block_rows, block_queries):
    _, posts, index = built
    truth = V.search(index, posts, 5, exact=True)
    found = V.search(index, posts, 5, probes=4, block_rows=block_rows, block_queries=block_queries)
    assert V.recall(found, truth).first()[0] >= 0.9
    # What is found has its exact distance.
    wrong = found.join(truth.withColumnRenamed("distance", "exact"), ["query", "id"]).filter("abs(distance - exact) > 1e-6")
    assert wrong.count() == 0


def test_enough_cells_are_chosen(built):
    _, posts, index = built
    asked = posts.filter("id % 20 = 0")
    probes = V.probes_for_recall(index, asked, 5, 0.95, first=1)
    truth = V.search(index, asked, 5, exact=True)
    assert probes == 16 or V.recall(V.search(index, asked, 5, probes), truth).first()[0] >= 0.95


def test_empty_tables(spark, built):
    _, posts, index = built
    assert V.search(index, posts.filter("false"), 5).collect() == []
    nothing = V.build(posts.filter("id = 30"), scratch_path(spark, "index"))
    assert V.search(nothing, posts.filter("id = 30"), 5).collect() == []
