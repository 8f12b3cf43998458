"""Streams by event time: late rows, windows that close, joins and top lists in append mode.

``TimelyStream`` passes rows on in the micro-batches in which they arrive and keeps those that come after their window was
closed in a table of late rows, for the batch path. What it passes on is read as a stream with a watermark, over which
Spark's own windows, joins and states run: none of them drops a row, and each forgets what its watermark closed.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postweave.storage import committed_batches, is_committed

# The column with the time of an event; its values are read in the session's time zone.
AT = "at"
# Parts that the top list of one window is found in, so that no task sees a whole window.
TOP_PARTS = 8
# Parts of the state of a query per core. Every part is a store (four for each join), opened and committed in every batch
# however little it holds.
STATES_PER_CORE = 2


def with_event_time(rows: DataFrame, column: str) -> DataFrame:
    """Add the time of the event as a timestamp, which watermarks need."""
    return rows.withColumn(AT, F.col(column).cast("timestamp"))


def window_end(at: Column, size: str) -> Column:
    return F.window(at, size)["end"]


def split_late_at(rows: DataFrame, watermark, size: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose window is open under a watermark, and those too late for it or without a time."""
    dated, undated = rows.filter(F.col(AT).isNotNull()), rows.filter(F.col(AT).isNull())
    if watermark is None:
        return dated, undated
    closed = window_end(F.col(AT), size) <= F.lit(watermark)
    return tuple(part.select(*rows.columns) for part in (
        dated.filter(~closed), dated.filter(closed).select(*rows.columns).unionByName(undated)))


class TimelyStream:
    """Parts the rows of a stream into timely and late ones.

    The watermark of a batch is the newest time of the batches before it, less ``lateness``; a row is late if its
    window of ``size`` ended by then. Rows without a time are late. Each batch writes its own folders and reads what lower
    numbers left; one that was written whole is not written again, so what reads the timely rows gets each once.
    """

    def __init__(self, spark: SparkSession, path: str, size: str, lateness: str):
        self.spark, self.path, self.size, self.lateness = spark, path, size, lateness
        self.schema = None

    def watermark(self, below: int | None = None):
        """The watermark of a batch (or of the next one); None before the first."""
        numbers = [n for n in committed_batches(self.spark, f"{self.path}/marks") if below is None or n < below]
        if not numbers:
            return None
        marks = self.spark.read.schema("newest timestamp, batch int").option(
            "basePath", f"{self.path}/marks").parquet(f"{self.path}/marks")
        # Watermarks count milliseconds.
        newest = F.date_trunc("millisecond", F.max("newest"))
        return marks.filter(F.col("batch") <= numbers[-1]).agg(
            newest - F.expr(f"interval {self.lateness}")).first()[0]

    def update(self, batch: DataFrame, number: int) -> None:
        if is_committed(self.spark, f"{self.path}/marks/batch={number}"):
            return
        timely, late = split_late_at(batch, self.watermark(number), self.size)
        late.write.mode("overwrite").parquet(f"{self.path}/late/batch={number}")
        timely.write.mode("overwrite").parquet(f"{self.path}/timely/batch={number}")
        written = self.spark.read.schema(batch.schema).parquet(f"{self.path}/timely/batch={number}")
        written.agg(F.max(AT).alias("newest")).write.mode("overwrite").parquet(f"{self.path}/marks/batch={number}")

    def start(self, stream: DataFrame) -> StreamingQuery:
        """Take in what a stream with the column ``at`` has, until it is used up."""
        self.schema = stream.schema
        return (
            stream.writeStream.foreachBatch(self.update)
            .option("checkpointLocation", f"{self.path}/checkpoint")
            .trigger(availableNow=True).start()
        )

    def timely(self) -> DataFrame:
        """The timely rows as a stream with a watermark."""
        return self.spark.readStream.schema(self.schema).parquet(
            f"{self.path}/timely/batch=*").withWatermark(AT, self.lateness)

    def late(self) -> DataFrame:
        """The rows that came too late."""
        if not committed_batches(self.spark, f"{self.path}/late"):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/late/batch=*")


def window_totals(stream: DataFrame, size: str, value: str, *keys: str) -> DataFrame:
    """``(window_start, *keys, events, total)`` of windows, which append mode returns once they are closed."""
    totals = stream.groupBy(F.window(AT, size).alias("window"), *keys).agg(
        F.count("*").alias("events"), F.sum(value).alias("total"))
    return totals.select(F.col("window.start").alias("window_start"), *keys, "events", "total")


def candidates_before(left: DataFrame, right: DataFrame, size: str, key: str, name: str) -> DataFrame:
    """``(name, key, window_start, candidates)``: for each left row the rows on the right with its key, by window.

    Windows are the row's own and the one before. The right side is counted per key and window before the join, and
    a count is offered to its own window and the next one. So no pair of rows is formed: the join holds the left
    rows of open windows and at most two counts per key and window, until the watermark closes the window. The
    counts of a row are complete once its window is closed.
    """
    counts = right.groupBy(F.window(AT, size).alias("window"), F.col(key).alias("other")).agg(
        F.count("*").alias("candidates"))
    start, end = F.col("window.start"), F.col("window.end")
    length = end - start
    targets = F.explode(F.array(
        F.struct(start.alias("start"), end.alias("end")),
        F.struct((start + length).alias("start"), (end + length).alias("end"))))
    offered = counts.select("other", "candidates", start.alias("window_start"), targets.alias("target"))
    asking = left.select(name, F.col(key).alias("own"), F.window(AT, size).alias("window"))
    same = (F.col("own") == F.col("other")) & (F.col("window") == F.col("target"))
    return asking.join(offered, same).select(name, F.col("own").alias(key), "window_start", "candidates")


def top_of_windows(stream: DataFrame, size: str, n: int, value: str, name: str, key: str,
                   parts: int = TOP_PARTS) -> DataFrame:
    """``(window_start, key, part, name, value)``: the ``n`` largest values of closed windows, ties to the smaller name.

    A window's rows are dealt to ``parts`` states per key, each of which holds its ``n`` largest rows and no other. They are
    returned when the watermark closes the window, for ``merge_tops``.
    """
    # Only the window keeps the watermark: a row counts as long as its window is open.
    window = F.window(AT, size)
    rows = stream.select(
        window.alias("window"), F.col(key).alias("key"), F.col(name).cast("bigint").alias("name"),
        F.col(value).cast("double").alias("value"), F.pmod(F.xxhash64(name), F.lit(parts)).cast("int").alias("part"))
    rows = rows.withColumns({"first": F.unix_micros(F.col("window.start")), "last": F.unix_millis(F.col("window.end"))})

    def keep(group: tuple, arrived: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, of, part = group
        if state.hasTimedOut:
            names, values = state.get
            state.remove()
            yield pd.DataFrame({"first": first, "key": of, "part": part, "name": list(names), "value": list(values)})
            return
        names, values = map(list, state.get) if state.exists else ([], [])
        held = pd.DataFrame({"name": names, "value": values}).astype({"name": "int64", "value": "float64"})
        for batch in arrived:
            held = pd.concat([held, batch[["name", "value"]].dropna()], ignore_index=True).sort_values(
                ["value", "name"], ascending=[False, True], kind="stable").head(n)
        state.update((held["name"].tolist(), held["value"].tolist()))
        state.setTimeoutTimestamp(int(last))

    kind = stream.schema[key].dataType.simpleString()
    found = rows.groupBy("first", "last", "key", "part").applyInPandasWithState(
        keep, f"first bigint, key {kind}, part int, name bigint, value double",
        "names array<bigint>, held array<double>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.timestamp_micros("first").alias("window_start"), F.col("key").alias(key), "part",
                        F.col("name").alias(name), F.col("value").alias(value))


def merge_tops(tops: DataFrame, n: int, value: str, name: str, key: str) -> DataFrame:
    """``(window_start, key, place, name, value)`` from the parts of each window, at most ``n`` rows of each."""
    ranked = Window.partitionBy("window_start", key).orderBy(F.desc(value), name)
    return tops.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= n).select(
        "window_start", key, "place", name, value)


@contextmanager
def _few_states(spark: SparkSession) -> Iterator[None]:
    """Queries that start in this block keep their state in at most ``STATES_PER_CORE`` parts per core."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), STATES_PER_CORE * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def append_closed(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what a query returns in append mode to a table, until its input is used up."""
    with _few_states(result.sparkSession):
        return (
            result.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
        )
