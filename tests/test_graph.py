import random

import pytest

from postweave.operators import graph as G, joins
from postweave.streaming.online import ComponentStream
from postweave.storage import scratch_path


def union_find(ids, edges):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a in parent and b in parent:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: root(i) for i in ids}


def frames(spark, ids, edges):
    vertices = spark.createDataFrame([(i, f"l{i % 3}", "t") for i in ids], "id bigint, label string, text string")
    return vertices, spark.createDataFrame(edges, "src bigint, dst bigint")


def random_graph(seed, vertices, edges):
    rng = random.Random(seed)
    return list(range(vertices)), [(rng.randrange(vertices), rng.randrange(vertices)) for _ in range(edges)]


PATH = ([5, 1, 4, 2, 6, 3, 9], [(5, 1), (1, 4), (4, 2), (2, 6), (6, 3)])
STAR = (list(range(10, 40)), [(25, i) for i in range(10, 40)])
ODD = ([1, 2, 3, 7], [(1, 1), (2, 3), (3, 2), (2, 3), (3, 99)])


@pytest.mark.parametrize("ids,edges,hot_rows", [
    (*PATH, 1_000_000), (*STAR, 2), (*STAR, 1_000_000), (*ODD, 2), ([1, 2], [], 2),
    (*random_graph(3, 120, 90), 4)])
def test_components(spark, ids, edges, hot_rows):
    vertices, links = frames(spark, ids, edges)
    found = {r[0]: r[1] for r in G.connected_components(vertices, links, hot_rows).collect()}
    assert found == union_find(ids, edges)


def test_components_ignore_direction_and_partitions(spark):
    ids, edges = random_graph(4, 60, 50)
    vertices, links = frames(spark, ids, [(b, a) for a, b in reversed(edges)])
    found = {r[0]: r[1] for r in G.connected_components(vertices, links.repartition(7)).collect()}
    assert found == union_find(ids, edges)


def test_incremental_components_equal_batch(spark):
    ids, edges = random_graph(5, 80, 70)
    online = ComponentStream(spark, scratch_path(spark, "test-online"))
    for number, start in enumerate(range(0, len(edges), 25)):
        _, batch = frames(spark, ids, edges[start:start + 25])
        online.update(batch, number)
        if number == 1:
            online.update(batch, number)  # a batch run again changes nothing
    touched = {x for e in edges for x in e}
    expected = {i: c for i, c in union_find(ids, edges).items() if i in touched}
    assert {r[0]: r[1] for r in online.components().collect()} == expected


def test_small_graph_operators(spark):
    vertices, links = frames(spark, [1, 2, 3], [(1, 2), (2, 1), (3, 9), (8, 1), (1, 2)])
    assert sorted(map(tuple, G.dangling_edges(links, vertices).collect())) == [(3, 9), (8, 1)]
    assert sorted(map(tuple, G.undirected_edges(links).collect())) == [
        (1, 2), (1, 8), (2, 1), (3, 9), (8, 1), (9, 3)]
    assert {r[0]: r[1] for r in G.in_degrees(links).collect()} == {2: 2, 1: 2, 9: 1}


def test_topic_summary(spark):
    vertices = spark.createDataFrame(
        [(1, "b", "t"), (2, "a", "t"), (3, "a", "t"), (4, "b", "t"), (5, None, "t")],
        "id bigint, label string, text string")
    topics = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)], "id bigint, component bigint")
    rows = sorted(map(tuple, G.topic_summary(topics, vertices).collect()))
    assert rows == [(1, 4, "a", 0.5), (5, 1, None, 1.0)]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_rows", [3, 1_000_000])
def test_salted_join_is_a_join(spark, how, hot_rows):
    rows = spark.createDataFrame([(i % 4 if i % 2 else 7, i) for i in range(40)], "k bigint, v bigint")
    lookup = spark.createDataFrame([(1, "a"), (7, "b"), (8, "c")], "k bigint, name string")
    salted = joins.salted_join(rows, lookup, "k", "v", how=how, hot_rows=hot_rows)
    plain = rows.join(lookup, "k", how)
    key = lambda r: (r["v"], r["k"])
    assert sorted(salted.select(plain.columns).collect(), key=key) == sorted(plain.collect(), key=key)
