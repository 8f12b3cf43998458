"""Neighbours and components kept up to date as posts arrive.

Each micro-batch writes below ``batch=<number>`` and reads only lower numbers, so a
batch that is run again after a failure gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from postweave.operators.elements import proximity_edges
from postweave.operators.graph import component_stars
from postweave.operators.neighbors import NEIGHBORS, explode_neighbors, nearest_in_buffer
from postweave.storage import committed_batches, delete, discard, materialize
from postweave.streaming.ingest import split_late

LINK_SCHEMA = "id bigint, component bigint"
FOREST_SCHEMA = "bucket int, high bigint, low bigint, newest int"
MERGE_SCHEMA = "component bigint, root bigint"
BUFFER_SCHEMA = "id bigint, sentence_embeddings array<float>, time_bucket int"
LIST_SCHEMA = f"id bigint, time_bucket int, neighbors {NEIGHBORS}"
ARRAY_SCHEMA = ("id bigint, word_embeddings array<array<float>>, "
                "hashtags_embeddings array<array<float>>, time_bucket int")
EDGE_SCHEMA = ("src bigint, dst bigint, sentence_distance double, word_distance double, "
               "hashtag_distance double, relationship array<float>")


def _write_batch(df: DataFrame, path: str, number: int, *partition: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition).parquet(f"{path}/batch={number}")


def _read_batches(spark: SparkSession, path: str, below: int | None, schema: str) -> DataFrame:
    """What batches before ``below`` (or all) wrote; empty if there is none."""
    numbers = [n for n in committed_batches(spark, path) if below is None or n < below]
    if not numbers:
        return spark.createDataFrame([], schema)
    return (
        spark.read.schema(f"{schema}, batch int").option("basePath", path).parquet(path)
        .filter(F.col("batch") <= numbers[-1]).drop("batch")
    )


def _read_last(spark: SparkSession, path: str, below: int | None, schema: str) -> DataFrame:
    """What the last batch before ``below`` (or of all) wrote; empty if there is none."""
    numbers = [n for n in committed_batches(spark, path) if below is None or n < below]
    if not numbers:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch={numbers[-1]}")


def _forget(spark: SparkSession, paths: list[str], below: int) -> None:
    """Delete the state of batches before ``below``; the last two copies are kept for a rerun."""
    for path in paths:
        for number in committed_batches(spark, path):
            if number < below:
                delete(spark, f"{path}/batch={number}")


class NeighborStream:
    """Keeps the nearest posts within ``window`` time buckets before and after every post.

    A post that arrives is looked up among all posts near it in time, and the lists of those posts are
    renewed, as it may belong into them. Posts more than ``window`` buckets older than the newest one of
    earlier batches go to the ``late`` table, for the batch path. So after a batch, lists more than
    ``2 * window`` buckets back are final: they are moved to the ``closed`` table, and equal those of the
    batch operator over all timely posts. Of the posts, only the last ``3 * window`` buckets are kept, of
    their lists only those that are not closed: each batch writes its own copy of this state and
    deletes the one before the last.
    """

    def __init__(self, spark: SparkSession, path: str, n: int = 12, window: int = 1):
        self.spark, self.path, self.n, self.window = spark, path, n, window

    def update(self, batch: DataFrame, number: int) -> None:
        columns = ("id", "sentence_embeddings", "time_bucket")
        posts = materialize(batch.select(*columns), "arrived")
        buffered, lists = self._state(number)
        before = buffered.agg(F.max("time_bucket")).first()[0]
        if before is None:
            timely, late = posts, posts.filter("false")
        else:
            timely, late = split_late(posts, before, self.window)
        first, last = timely.agg(F.min("time_bucket"), F.max("time_bucket")).first()
        newest = max(x for x in (before, last, 0) if x is not None)
        near = F.col("time_bucket").between(
            F.lit(first).cast("int") - self.window, F.lit(last).cast("int") + self.window)
        touched = timely.unionByName(buffered.filter(near))
        found = nearest_in_buffer(touched, buffered.filter(~F.coalesce(near, F.lit(False))), self.n,
                                  window=self.window)
        renewed = materialize(touched.select("id", "time_bucket").join(found, "id"), "renewed")
        kept = lists.join(touched.select("id"), "id", "left_anti")
        every = renewed.unionByName(kept.select(*renewed.columns))
        closed = F.col("time_bucket") < newest - 2 * self.window
        _write_batch(every.filter(closed), f"{self.path}/closed", number)
        _write_batch(every.filter(~closed), f"{self.path}/open", number)
        _write_batch(late, f"{self.path}/late", number)
        recent = F.col("time_bucket") >= newest - 3 * self.window
        _write_batch(buffered.unionByName(timely).filter(recent), f"{self.path}/buffer", number)
        discard(posts, renewed)
        _forget(self.spark, [f"{self.path}/open", f"{self.path}/buffer"], number - 1)

    def _state(self, below: int | None) -> tuple[DataFrame, DataFrame]:
        """Posts and open lists as the last batch before ``below`` left them."""
        return (_read_last(self.spark, f"{self.path}/buffer", below, BUFFER_SCHEMA),
                _read_last(self.spark, f"{self.path}/open", below, LIST_SCHEMA))

    def start(self, stream: DataFrame) -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(self.update)
            .option("checkpointLocation", f"{self.path}/checkpoint")
            .trigger(availableNow=True).start()
        )

    def closed(self, number: int) -> DataFrame:
        """The lists that became final in one batch."""
        return self.spark.read.schema(LIST_SCHEMA).parquet(f"{self.path}/closed/batch={number}")

    def open(self) -> DataFrame:
        """The lists that later posts may still change."""
        return self._state(None)[1]

    def neighbors(self) -> DataFrame:
        """The neighbours of all posts that arrived in time."""
        closed = _read_batches(self.spark, f"{self.path}/closed", None, LIST_SCHEMA)
        return closed.unionByName(self.open()).select("id", "neighbors")

    def late(self) -> DataFrame:
        """The posts that arrived too late."""
        return _read_batches(self.spark, f"{self.path}/late", None, BUFFER_SCHEMA)


class ComponentStream:
    """Keeps connected components while edges arrive.

    Edges only ever join components. A vertex is stored once, with the component it
    first fell into; joins are kept as ``component -> root`` rows, rewritten per batch.
    Only the components a batch touches are worked on.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def update(self, batch: DataFrame, number: int) -> None:
        edges = materialize(batch.select("src", "dst"), "arrived")
        before = self.components(number)
        ends = edges.select(F.col("src").alias("id")).unionByName(
            edges.select(F.col("dst").alias("id"))).distinct()
        current = materialize(ends.join(before, "id", "left").select(
            "id", F.col("component").isNull().alias("fresh"),
            F.coalesce("component", "id").alias("component")), "touched")
        lifted = (
            edges.join(current.select(F.col("id").alias("src"), F.col("component").alias("a")), "src")
            .join(current.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst")
            .select(F.col("a").alias("src"), F.col("b").alias("dst"))
            .filter("src <> dst").distinct()
        )
        joined = component_stars(lifted).select(
            F.col("id").alias("component"), F.col("component").alias("new_root"))
        fresh = current.filter("fresh").select("id", "component")
        merges = (
            self._merges(number).withColumnRenamed("component", "merged")
            .join(joined, F.col("root") == F.col("component"), "left")
            .select(F.col("merged").alias("component"), F.coalesce("new_root", "root").alias("root"))
            .unionByName(joined.withColumnRenamed("new_root", "root"))
        )
        _write_batch(merges, f"{self.path}/merges", number)
        _write_batch(fresh, f"{self.path}/links", number)
        _forget(self.spark, [f"{self.path}/merges"], number - 1)
        discard(edges, current)

    def _merges(self, below: int | None) -> DataFrame:
        path = f"{self.path}/merges"
        numbers = [n for n in committed_batches(self.spark, path) if below is None or n < below]
        if not numbers:
            return self.spark.createDataFrame([], MERGE_SCHEMA)
        return self.spark.read.schema(MERGE_SCHEMA).parquet(f"{path}/batch={numbers[-1]}")

    def components(self, below: int | None = None) -> DataFrame:
        """``(id, component)`` of all vertices that arrived (before batch ``below``)."""
        links = _read_batches(self.spark, f"{self.path}/links", below, LINK_SCHEMA)
        return links.join(self._merges(below), "component", "left").select(
            "id", F.coalesce("root", "component").alias("component"))

    def start(self, stream: DataFrame) -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(self.update)
            .option("checkpointLocation", f"{self.path}/checkpoint")
            .trigger(availableNow=True).start()
        )


class WindowComponents:
    """Connected components of the posts of the last ``window`` time buckets and the newest one.

    Unlike in ``ComponentStream``, components part again when posts that held them together leave the window. An edge
    lives as long as the older of its posts, so edges are kept by that post's bucket, and those of a bucket leave together:
    what is kept of them is a spanning forest, at most one link per post. The components of the window are those of its
    forests. Only forests that a batch adds edges to are made anew; each batch writes its own copy of the forests of the
    window and deletes the one before the last.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = 1):
        self.spark, self.path, self.window = spark, path, window

    def update(self, batch: DataFrame, number: int) -> None:
        """Take in ``(src, dst, src_bucket, dst_bucket)``; repetitions and directions do not matter."""
        edges = materialize(batch.select(
            "src", "dst", F.least("src_bucket", "dst_bucket").cast("int").alias("bucket"),
            F.greatest("src_bucket", "dst_bucket").cast("int").alias("newer")), "arrived")
        before = _read_last(self.spark, f"{self.path}/forests", number, FOREST_SCHEMA)
        newest = max((x for x in (
            before.agg(F.max("newest")).first()[0], edges.agg(F.max("newer")).first()[0]) if x is not None),
            default=None)
        alive = F.lit(False) if newest is None else F.col("bucket") >= newest - self.window
        touched = F.broadcast(edges.filter(alive).select("bucket").distinct())
        held = before.filter(alive & F.col("high").isNotNull())
        # Links of all touched buckets at once, with the bucket as part of a post's name.
        links = edges.filter(alive).select("bucket", "src", "dst").unionByName(
            held.join(touched, "bucket", "left_semi").select(
                "bucket", F.col("high").alias("src"), F.col("low").alias("dst")))
        stars = component_stars(links.select(
            F.struct("bucket", F.col("src").alias("id")).alias("src"),
            F.struct("bucket", F.col("dst").alias("id")).alias("dst")))
        renewed = stars.select(F.col("id.bucket").alias("bucket"), F.col("id.id").alias("high"),
                               F.col("component.id").alias("low"))
        kept = held.join(touched, "bucket", "left_anti").select("bucket", "high", "low")
        forests = renewed.unionByName(kept).withColumn("newest", F.lit(newest).cast("int"))
        # The newest bucket is remembered even if no link is left.
        mark = self.spark.range(1).select(
            F.lit(newest).cast("int").alias("bucket"), F.lit(None).cast("bigint").alias("high"),
            F.lit(None).cast("bigint").alias("low"), F.lit(newest).cast("int").alias("newest"))
        _write_batch(forests.unionByName(mark), f"{self.path}/forests", number)
        _forget(self.spark, [f"{self.path}/forests"], number - 1)
        discard(edges)

    def components(self, below: int | None = None) -> DataFrame:
        """``(id, component)`` of the posts in the window that have a link, as batches (before ``below``) left them."""
        links = _read_last(self.spark, f"{self.path}/forests", below, FOREST_SCHEMA).filter(
            F.col("high").isNotNull() & (F.col("high") != F.col("low")))
        stars = materialize(component_stars(links.select(
            F.col("high").alias("src"), F.col("low").alias("dst"))), "stars")
        # Stars leave out the smallest post of each component.
        return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())

    def start(self, stream: DataFrame) -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(self.update)
            .option("checkpointLocation", f"{self.path}/checkpoint")
            .trigger(availableNow=True).start()
        )


class TopicStream:
    """Topics while vectorised posts arrive: neighbours, edges, cut, components.

    ``accept`` keeps the edges within a topic, for example by a fitted classifier:
    ``lambda edges: cut_edges(score_edges(model, edges))``. Only final lists become edges, as components can
    be joined but not parted; ``finish`` takes the rest when no more posts are to come. Arrays are kept for
    the time buckets that final lists can still reach. Late posts take no part.
    """

    def __init__(self, spark: SparkSession, path: str, accept: Callable[[DataFrame], DataFrame],
                 n: int = 12, words: int = 3, hashtags: int = 9, window: int = 1):
        self.spark, self.path, self.accept = spark, path, accept
        self.words, self.hashtags, self.window = words, hashtags, window
        self.near = NeighborStream(spark, f"{path}/near", n, window)
        self.topics = ComponentStream(spark, f"{path}/topics")

    def update(self, batch: DataFrame, number: int) -> None:
        columns = ("id", "sentence_embeddings", "word_embeddings", "hashtags_embeddings", "time_bucket")
        posts = materialize(batch.select(*columns), "arrived")
        self.near.update(posts, number)
        stored = _read_last(self.spark, f"{self.path}/arrays", number, ARRAY_SCHEMA)
        arrays = materialize(stored.unionByName(posts.drop("sentence_embeddings")), "arrays")
        newest = arrays.agg(F.max("time_bucket")).first()[0] or 0
        late = self.spark.read.schema(BUFFER_SCHEMA).parquet(f"{self.path}/near/late/batch={number}")
        self._link(self.near.closed(number), arrays, posts.join(late.select("id"), "id", "left_anti"), number)
        # The next lists to be closed are those of the last buckets, with neighbours before them.
        _write_batch(arrays.filter(F.col("time_bucket") >= newest - 4 * self.window),
                     f"{self.path}/arrays", number)
        _forget(self.spark, [f"{self.path}/arrays"], number - 1)
        discard(posts, arrays)

    def finish(self) -> None:
        """Take the lists that are still open as final."""
        number = max(committed_batches(self.spark, f"{self.path}/arrays"), default=-1) + 1
        arrays = _read_last(self.spark, f"{self.path}/arrays", None, ARRAY_SCHEMA)
        self._link(self.near.open(), arrays, arrays.filter("false"), number)

    def _link(self, lists: DataFrame, arrays: DataFrame, posts: DataFrame, number: int) -> None:
        found = materialize(explode_neighbors(lists.select("id", "neighbors")), "final")
        edges = proximity_edges(found, arrays, self.words, self.hashtags)
        _write_batch(edges, f"{self.path}/edges", number)
        stored = self.spark.read.schema(EDGE_SCHEMA).parquet(f"{self.path}/edges/batch={number}")
        # A post without accepted edges is a topic of its own: it is linked to itself.
        alone = posts.select(F.col("id").alias("src"), F.col("id").alias("dst"))
        self.topics.update(self.accept(stored).select("src", "dst").unionByName(alone), number)
        discard(found)

    def start(self, stream: DataFrame) -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(self.update)
            .option("checkpointLocation", f"{self.path}/checkpoint")
            .trigger(availableNow=True).start()
        )

    def edges(self) -> DataFrame:
        """All scored edges."""
        return _read_batches(self.spark, f"{self.path}/edges", None, EDGE_SCHEMA)

    def components(self) -> DataFrame:
        """``(id, component)`` of all posts that arrived in time."""
        return self.topics.components()
