"""Projection, filtering, sampling and numbering of posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postweave.operators.joins import salted_join
from postweave.storage import materialize

# Sampling hashes are read as numbers below this limit.
HASH_RANGE = 2**32


def non_empty(posts: DataFrame) -> DataFrame:
    """Posts with a text."""
    return posts.filter(F.col("text") != "")


def has_hashtags(posts: DataFrame) -> DataFrame:
    """Posts with at least one hashtag vector."""
    return posts.filter(F.size("hashtags_embeddings") > 0)


def vertices(posts: DataFrame) -> DataFrame:
    """The posts as graph vertices."""
    return posts.select("id", "label", "text")


def _hash(key: str, seed: int) -> Column:
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def bernoulli_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Keep each row with a probability; depends on the partitioning of ``df``."""
    return df.sample(False, fraction, seed)


def hash_sample(df: DataFrame, fraction: float, seed: int = 42, key: str = "id") -> DataFrame:
    """Keep each row with a probability, decided by its key alone: reproducible anywhere."""
    return df.filter(_hash(key, seed) < int(fraction * HASH_RANGE))


def sample_n(df: DataFrame, n: int, seed: int = 3, key: str = "id") -> DataFrame:
    """``n`` random rows without replacement, reproducible; a distributed top-n."""
    return df.withColumn("order", _hash(key, seed)).orderBy("order", key).limit(n).drop("order")


def split_edges(edges: DataFrame, tenths: int = 8) -> DataFrame:
    """Mark edges as ``train`` or ``test`` by their unordered endpoints.

    Both directions of an edge fall on the same side, however the rows are partitioned.
    """
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    side = F.pmod(low * 31 + high, F.lit(10)) < tenths
    return edges.withColumn("split", F.when(side, "train").otherwise("test"))


def slice_rows(df: DataFrame, start: int, end: int, key: str = "id") -> DataFrame:
    """Rows ``start`` to ``end`` in the order of ``key``, numbered without one task for all before them."""
    place = F.col("_place")
    numbered = row_index(df, key, "_place")
    return numbered.filter((place > start) & (place <= end)).drop("_place")


def row_index(df: DataFrame, key: str = "id", name: str = "index") -> DataFrame:
    """Number all rows from 1 in the order of ``key``, without gathering them in one task.

    Rows are range-partitioned and numbered within their partition; the partition
    sizes, one number each, are summed up to the offsets.
    """
    # One stored copy fixes which rows form a partition and keeps the input unchanged.
    part = F.spark_partition_id()
    ordered = materialize(
        df.repartitionByRange(key).sortWithinPartitions(key)
        .withColumns({"part": part, "place": F.monotonically_increasing_id()}), "ordered")
    sizes = ordered.groupBy("part").agg(
        F.count("*").alias("rows"), F.min("place").alias("first")).orderBy("part").collect()
    spark, before, offsets = df.sparkSession, 0, []
    for row in sizes:
        offsets.append((row["part"], before + 1 - row["first"]))
        before += row["rows"]
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("bigint"))
    shift = spark.createDataFrame(offsets, "part int, shift bigint")
    # One row per partition of the plan.
    return (
        ordered.join(F.broadcast(shift), "part")
        .withColumn(name, F.col("place") + F.col("shift")).drop("part", "place", "shift")
    )


def union_posts(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of several frames with the same columns in any order."""
    for other in others:
        first = first.unionByName(other)
    return first


def label_counts(posts: DataFrame) -> DataFrame:
    """Posts per label."""
    return posts.groupBy("label").count()


def label_index(posts: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """``(label, label_idx)``: the position of each label in sorted order.

    Labels come from ``classes`` or, if not given, from the posts. They are few.
    """
    if classes is not None:
        rows = [(label, i) for i, label in enumerate(sorted(classes))]
        return posts.sparkSession.createDataFrame(rows, "label string, label_idx int")
    distinct = posts.select("label").filter(F.col("label").isNotNull()).distinct()
    return row_index(distinct, "label", "position").select(
        "label", (F.col("position") - 1).cast("int").alias("label_idx"))


def with_label_index(posts: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Add the label's index to every post."""
    return salted_join(posts, label_index(posts, classes), "label", "id")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, standard deviation, minimum and maximum, one row per column."""
    stats = df.agg(*(F.struct(
        F.lit(c).alias("column"), F.count(c).alias("count"),
        F.avg(c).cast("double").alias("mean"), F.stddev(c).cast("double").alias("stddev"),
        F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"),
    ).alias(c) for c in columns))
    return stats.select(F.inline(F.array(*columns)))


def spread(df: DataFrame) -> DataFrame:
    """Share the rows of a table among all cores if it has fewer splits than there are cores.

    Splits have a bounded size, so what is moved is at most one split per core; large files have more
    splits than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
