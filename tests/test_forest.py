"""Components in the state of a stream against union-find on all links that arrived."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from postweave.storage import delete, scratch_path
from postweave.streaming.forest import LINK, ForestStream, spanning_links


def components_of(links):
    above = {}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            above.setdefault(a, a)
            above.setdefault(b, b)
            low, high = sorted((root(a), root(b)))
            above[high] = low
    return sorted((x, root(x)) for x in above)


class Arrivals:
    def __init__(self, spark):
        self.spark, self.path, self.links = spark, scratch_path(spark, "arrivals"), []
        self.forest = ForestStream(spark, scratch_path(spark, "forest"))

    def stream(self):
        return self.spark.readStream.schema(LINK).parquet(self.path)

    def add(self, links):
        self.links += links
        self.spark.createDataFrame(links, LINK).coalesce(1).write.mode("append").parquet(self.path)

    def run(self):
        self.forest.start(self.stream()).awaitTermination()

    def found(self):
        return sorted(map(tuple, self.forest.components().collect()))

    def expected(self):
        return components_of(self.links)


def test_components_after_every_batch(spark):
    rng, arrivals = random.Random(3), Arrivals(spark)
    for k in range(3):
        links = [(rng.randrange(200), rng.randrange(200)) for _ in range(60)]
        # Links of a vertex to itself, repeated ones, null ends, and a long chain that grows.
        links += links[:5] + [(900 + k, 900 + k), (None, 1), (2, None), (None, None)]
        links += [(1000 + i, 1001 + i) for i in range(k * 40, k * 40 + 41)]
        arrivals.add(links)
        arrivals.run()
        assert arrivals.found() == arrivals.expected()
    assert arrivals.forest.settle(arrivals.stream()) < 40
    assert arrivals.found() == arrivals.expected()
    # One pointer per vertex, and none of the messages is left.
    pointers = arrivals.forest.pointers()
    assert pointers.count() == pointers.select("id").distinct().count() <= len(arrivals.expected())


def test_batch_that_runs_again(spark):
    arrivals = Arrivals(spark)
    arrivals.add([(i, i % 7) for i in range(60)])
    arrivals.run()
    arrivals.add([(i, i + 60) for i in range(50)])
    arrivals.run()
    commits = f"{arrivals.forest.checkpoint}/commits"
    last = max(int(r["path"].rsplit("/", 1)[1]) for r in spark.read.format("binaryFile").load(
        f"{commits}/[0-9]*").select("path").collect())
    # As if the driver had been lost before it noted the last batch.
    delete(spark, f"{commits}/{last}")
    arrivals.add([(200, 201), (201, 3)])
    arrivals.run()
    assert arrivals.found() == arrivals.expected()


def test_no_links(spark):
    arrivals = Arrivals(spark)
    assert arrivals.found() == []
    arrivals.add([])
    arrivals.run()
    assert arrivals.found() == []
    arrivals.add([(4, 4)])
    arrivals.run()
    assert arrivals.found() == [(4, 4)]


def test_a_popular_vertex_reaches_its_state_once_per_chunk(spark):
    arrivals = Arrivals(spark)
    arrivals.add([(7, i) for i in range(5000)])
    arrivals.run()
    assert arrivals.found() == arrivals.expected()
    waiting = spark.read.schema(LINK).parquet(f"{arrivals.forest.messages}/batch=*")
    assert waiting.count() < 100


@pytest.mark.parametrize("seed", range(5))
def test_spanning_links_keep_components(seed):
    rng = random.Random(seed)
    links = [(rng.randrange(50), rng.randrange(50)) for _ in range(rng.randrange(60))]
    rank = {x: (x * 7919) % 101 - 50 for x in range(50)}
    chunk = pd.DataFrame([(a, b, rank[a], rank[b]) for a, b in links],
                         columns=["src", "dst", "src_rank", "dst_rank"], dtype="int64")
    stars = next(spanning_links(iter([chunk])))
    assert components_of(list(zip(stars["high"], stars["low"]))) == components_of(links)
    assert not stars["high"].duplicated().any()
    assert all(rank[b] == r and (a == b or r < rank[a]) for a, b, r in stars.itertuples(index=False))
