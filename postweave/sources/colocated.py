"""Tables that are stored by the hash of a key, so that joins and groupings on it need no shuffle.

A table is shuffled once when it is written: to ``buckets`` files that are sorted by the key. Reads of two tables with the same
number of buckets meet file by file. This suits keys with few rows each, like the ids of posts; a key that a large
share of the rows has would make one file large, and is better joined with salts (``operators.joins``).
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

# Files of a table; tables that are to meet need the same number.
BUCKETS = 64


def save(df: DataFrame, name: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Write ``df`` as the table ``name``, one sorted file per bucket of ``key``, replacing an older one."""
    spark = df.sparkSession
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet")
     .bucketBy(buckets, key).sortBy(key).saveAsTable(name))
    return spark.table(name)


def fresh_name(prefix: str) -> str:
    """A table name that no other run uses."""
    return f"{re.sub('[^a-z0-9_]', '_', prefix.lower())}_{uuid.uuid4().hex}"


def drop(spark: SparkSession, *names: str) -> None:
    """Remove tables and their files."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def attach(edges: DataFrame, posts: DataFrame, end: str, columns: list[str], suffix: str = "") -> DataFrame:
    """Add ``columns`` of the posts at one end of stored edges; both tables are bucketed by it.

    Neither side is moved: each pair of files is merged as it lies.
    """
    theirs = posts.select(posts["id"].alias(end), *(posts[c].alias(c + suffix) for c in columns))
    return edges.join(theirs.hint("merge"), end, "left")


def shuffles(df: DataFrame) -> int:
    """How often the plan of ``df`` moves rows between tasks, by shuffling or broadcasting."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"\b(?:Exchange|BroadcastExchange)\b", plan))
