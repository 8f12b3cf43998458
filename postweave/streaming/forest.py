"""Connected components as keyed state of a stream: one pointer per vertex, moved by messages.

Vertices are ranked by a hash of their id, and the state of a vertex is its pointer: a neighbour of lower rank. A link between
``u`` and a lower ``v`` goes to the state of ``u``, which keeps the lower of ``v`` and its pointer ``w``. The other of the two
becomes a link between ``v`` and ``w``, both lower than ``u``, which the stream reads back as a message. So messages die out, and at
any time the pointers and the messages not yet read connect the same vertices as all links that arrived: components can be read
after every batch, with or without waiting for the messages. As ranks are random, few rounds are left to wait for,
also for long chains.

Links and messages may come twice, in any order, after any failure: nothing but connectivity is kept of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postweave.operators.graph import component_stars
from postweave.storage import committed_batches, discard, materialize

LINK = "src bigint, dst bigint"
RANKED = "high bigint, low bigint, low_rank bigint"
POINTER = "low bigint, low_rank bigint"


def spanning_links(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each chunk of ``(src, dst, src_rank, dst_rank)`` as stars around the vertices of lowest rank.

    A vertex is the ``high`` end of at most one link of a chunk, so popular vertices are reduced before the shuffle. Links of a
    vertex to itself stay if it has no other.
    """
    for chunk in chunks:
        above = {}

        def root(x):
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        for a, b in zip(zip(chunk["src_rank"].tolist(), chunk["src"].tolist()),
                        zip(chunk["dst_rank"].tolist(), chunk["dst"].tolist())):
            above.setdefault(a, a)
            above.setdefault(b, b)
            low, high = sorted((root(a), root(b)))
            above[high] = low
        ends = {x: root(x) for x in above}
        centres = {y for x, y in ends.items() if x != y}
        links = [(x[1], y[1], y[0]) for x, y in ends.items() if x not in centres]
        yield pd.DataFrame(links, columns=["high", "low", "low_rank"], dtype="int64")


def move_pointer(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep the lowest neighbour of one vertex; the others are linked to it by messages ``(src, dst)``."""
    held = tuple(reversed(state.get)) if state.exists else None
    best = held
    for chunk in chunks:
        found = set(zip(chunk["low_rank"].tolist(), chunk["low"].tolist()))
        if best is not None:
            found.add(best)
        best = min(found)
        # A vertex that points to itself has had no lower neighbour yet.
        others = [x for _, x in found if x not in (best[1], key[0])]
        if others:
            yield pd.DataFrame({"src": others, "dst": best[1]}, dtype="int64")
    if best != held:
        state.update((best[1], best[0]))


class ForestStream:
    """Keeps connected components while links ``(src, dst)`` arrive; direction does not matter.

    A link of a vertex to itself makes it known. Links with a null end are left out. The state is one pointer per vertex and
    is read from the checkpoint; with ``spark.sql.streaming.stateStore.providerClass`` set to RocksDB's it need
    not fit in memory. A batch works on the vertices that its links and messages name, and no other.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.checkpoint, self.messages = f"{path}/checkpoint", f"{path}/messages"

    def _write(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.messages}/batch={number}")

    def start(self, stream: DataFrame) -> StreamingQuery:
        """Take in what has arrived, and the messages of earlier runs."""
        if not committed_batches(self.spark, self.messages):
            # Streams do not start on a folder that is not there.
            self._write(self.spark.createDataFrame([], LINK), -1)
        # Messages that a finished batch has read are deleted.
        back = self.spark.readStream.schema(LINK).option("cleanSource", "delete").parquet(f"{self.messages}/batch=*")
        links = stream.select("src", "dst").unionByName(back).filter(
            F.col("src").isNotNull() & F.col("dst").isNotNull())
        ranked = links.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")).withColumns(
            {"src_rank": F.xxhash64("src"), "dst_rank": F.xxhash64("dst")})
        moved = ranked.mapInPandas(spanning_links, RANKED).groupBy("high").applyInPandasWithState(
            move_pointer, LINK, POINTER, "append", GroupStateTimeout.NoTimeout)
        return (
            moved.writeStream.foreachBatch(self._write).option("checkpointLocation", self.checkpoint)
            .trigger(availableNow=True).start()
        )

    def settle(self, stream: DataFrame) -> int:
        """Run until no message is left; the number of runs."""
        runs = 0
        while True:
            self.start(stream).awaitTermination()
            runs += 1
            last = committed_batches(self.spark, self.messages)[-1]
            if self.spark.read.schema(LINK).parquet(f"{self.messages}/batch={last}").isEmpty():
                return runs

    def pointers(self) -> DataFrame:
        """``(id, low)``: the state of every vertex that has one."""
        if not is_started(self.spark, self.checkpoint):
            return self.spark.createDataFrame([], "id bigint, low bigint")
        state = self.spark.read.format("statestore").load(self.checkpoint)
        return state.select(F.col("key.high").alias("id"), F.col("value.groupState.low").alias("low"))

    def components(self) -> DataFrame:
        """``(id, component)`` of all vertices that arrived, with the smallest id of each component."""
        waiting = self.spark.read.schema(LINK).parquet(f"{self.messages}/batch=*") if committed_batches(
            self.spark, self.messages) else self.spark.createDataFrame([], LINK)
        links = materialize(self.pointers().select(F.col("id").alias("src"), F.col("low").alias("dst")).unionByName(
            waiting.select("src", "dst")), "pointers")
        ids = links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id"))).distinct()
        found = materialize(ids.join(component_stars(links), "id", "left").select(
            "id", F.coalesce("component", "id").alias("component")), "components")
        discard(links)
        return found


def is_started(spark: SparkSession, checkpoint: str) -> bool:
    """True if a stream has finished a batch with this checkpoint."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint, "commits/[0-9]*")
    return bool(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(folder))
