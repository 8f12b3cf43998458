import pytest
from pyspark.sql import functions as F

from postweave.functions import text as T
from postweave.sources import derive
from postweave.storage import scratch_path
from postweave.streaming import ingest
from postweave.streaming.online import NeighborStream
from tests_support import as_dict, brute_force, clustered, same, SCHEMA


def test_ingest_appends_each_post_once(spark, tmp_path):
    posts = derive.posts(spark, "/root/testdata/sf0.001")
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for part in range(3):
        posts.filter(F.col("id") % 3 == part).write.mode("append").parquet(source)
        stream = ingest.ingest_posts(ingest.read_stream(spark, source, posts.schema, 1))
        ingest.append_stream(stream, sink, checkpoint).awaitTermination()
    expected = posts.withColumn("text", T.strip_repost(F.col("text")))
    got = spark.read.parquet(sink)
    assert got.count() == posts.count()
    assert got.select("id", "text").exceptAll(expected.select("id", "text")).count() == 0


def test_enriched_stream_equals_batch(spark, tmp_path):
    posts = derive.posts(spark, "/root/testdata/sf0.001")
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    posts.repartition(4).write.parquet(source)
    stream = ingest.embed_posts(ingest.enrich_posts(ingest.read_stream(spark, source, posts.schema, 2)))
    ingest.append_stream(stream, sink, checkpoint, "time_bucket").awaitTermination()
    columns = ["id", "text", "token", "time_bucket", "word_embeddings"]
    batch = ingest.embed_posts(ingest.enrich_posts(posts)).select(*columns)
    assert spark.read.parquet(sink).select(*columns).exceptAll(batch).count() == 0


def test_neighbor_stream_with_eviction_late_posts_and_replay(spark):
    rows = clustered(9, 120, 6)
    frame = lambda part: spark.createDataFrame(part, SCHEMA)
    online = NeighborStream(spark, scratch_path(spark, "test-online"), n=4, window=1)
    batches = [[r for r in rows if r[2] // 2 == g] for g in range(3)]
    late = (1000, [1.0] * 6, 0)
    batches[2].append(late)
    for number, part in enumerate(batches):
        online.update(frame(part), number)
        online.update(frame(part), number)
    same(as_dict(online.neighbors()), brute_force(rows, 4, "symmetric"))
    assert [r["id"] for r in online.late().collect()] == [1000]


def test_stream_of_one_bucket(spark):
    rows = clustered(10, 30, 1)
    online = NeighborStream(spark, scratch_path(spark, "test-online"), n=3)
    online.update(spark.createDataFrame(rows[:20], SCHEMA), 0)
    online.update(spark.createDataFrame([], SCHEMA), 1)
    online.update(spark.createDataFrame(rows[20:], SCHEMA), 2)
    same(as_dict(online.neighbors()), brute_force(rows, 3, "symmetric"))


def test_state_of_many_batches_stays_flat(spark):
    import os

    rows = clustered(12, 100, 20)
    path = scratch_path(spark, "test-online")
    online = NeighborStream(spark, path, n=2)
    folder = path.removeprefix("file:")
    counts = []
    for bucket in range(20):
        online.update(spark.createDataFrame([r for r in rows if r[2] == bucket], SCHEMA), bucket)
        counts.append(sum(len([x for x in os.listdir(f"{folder}/{part}") if x.startswith("batch=")])
                          for part in ("open", "buffer")))
    assert counts[5:] == [4] * 15
    same(as_dict(online.neighbors()), brute_force(rows, 2, "symmetric"))


def test_topic_stream_equals_batch_on_its_edges(spark):
    from postweave.operators import graph

    rows = [(i, v, b, [v[:3], v[3:]], [v[:3]] if i % 2 else []) for i, v, b in clustered(11, 90, 3)]
    schema = SCHEMA + ", word_embeddings array<array<float>>, hashtags_embeddings array<array<float>>"
    posts = spark.createDataFrame(rows, schema)
    accept = lambda edges: edges.filter("sentence_distance < 0.01 AND word_distance < 0.02")
    from postweave.streaming.online import TopicStream

    online = TopicStream(spark, scratch_path(spark, "test-online"), accept, n=3)
    for bucket in range(3):
        online.update(posts.filter(F.col("time_bucket") == bucket), bucket)
    online.finish()
    edges = online.edges()
    near = {}
    for r in edges.collect():
        near.setdefault(r["src"], set()).add(r["dst"])
    assert near == {i: {x[1] for x in f} for i, f in brute_force(
        [r[:3] for r in rows], 3, "symmetric").items()}
    assert edges.filter("hashtag_distance IS NULL").count() > 0
    assert edges.filter("word_distance IS NULL").count() == 0
    batch = graph.connected_components(posts.select("id"), accept(edges))
    assert sorted(online.components().collect()) == sorted(batch.collect())
