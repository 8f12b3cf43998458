"""A sample of fixed size of all rows that arrived so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from postweave.operators.rows import sample_n
from postweave.streaming.online import _forget, _read_last, _write_batch


class StreamSample:
    """Keeps the ``n`` rows with the smallest hashes of their keys.

    The smallest of some rows and of the smallest of others are the smallest of all, so a batch needs only the sample
    before it: every task keeps ``n`` rows, and the result equals ``sample_n`` over all rows that arrived, in whatever
    batches. A batch reads what lower numbers left, and gives the same result if it runs again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, n: int, seed: int = 3, key: str = "id"):
        self.spark, self.path, self.schema = spark, path, schema
        self.n, self.seed, self.key = n, seed, key

    def update(self, batch: DataFrame, number: int) -> None:
        before = self.sample(number)
        both = before.unionByName(batch.select(*before.columns))
        _write_batch(sample_n(both, self.n, self.seed, self.key), self.path, number)
        _forget(self.spark, [self.path], number - 1)

    def sample(self, below: int | None = None) -> DataFrame:
        """The sample as the last batch (before ``below``) left it."""
        return _read_last(self.spark, self.path, below, self.schema)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
