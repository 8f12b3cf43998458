"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A task should not get more rows of one key than this. Of n rows at most n / HOT_ROWS
# keys are that frequent, so a list of them can be held by every task.
HOT_ROWS = 1_000_000


def hot_keys(rows: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(key, rows)`` of the keys with more than ``hot_rows`` rows; counted map-side first."""
    return rows.groupBy(key).agg(F.count("*").alias("rows")).filter(F.col("rows") > hot_rows)


def salted_join(rows: DataFrame, lookup: DataFrame, key: str, spread: str,
                hot: DataFrame | None = None, how: str = "inner",
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join ``rows`` with ``lookup``, which has one row per ``key``.

    A key with many rows is spread by ``spread`` over as many tasks as its count asks for,
    and its single lookup row is repeated for each; all other keys join as usual. ``hot``
    lists these keys as ``(key, rows)``; without it they are counted, so ``rows`` should
    then be a stored table.
    """
    if hot is None:
        hot = hot_keys(rows, key, hot_rows)
    salts = F.ceil(F.col("rows") / F.lit(hot_rows)).cast("int")
    hot = F.broadcast(hot.select(key, salts.alias("salts")))
    count = F.coalesce("salts", F.lit(1))
    salt = F.pmod(F.xxhash64(spread), count).cast("int")
    ours = rows.join(hot, key, "left").withColumn("salt", salt).drop("salts")
    theirs = lookup.join(hot, key, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), count - 1))).drop("salts")
    return ours.join(theirs, [key, "salt"], how).drop("salt")


def relabel(posts: DataFrame, labelled_ids: DataFrame) -> DataFrame:
    """Replace the label of every post by the one listed for its id; unlisted posts go."""
    listed = labelled_ids.select(
        F.col("id").cast("bigint").alias("id"), F.col("label").alias("file"))
    columns = ("label", "id", "year", "month", "day", "text", "mentions", "hashtags")
    return posts.drop("label").join(listed, "id").withColumnRenamed("file", "label").select(*columns)


def hydrate(labelled_ids: DataFrame, content: DataFrame) -> DataFrame:
    """Look up the content of listed ids; ids without content are dropped."""
    listed = labelled_ids.select("label", F.col("id").cast("bigint").alias("id"))
    return listed.join(content.drop("label"), "id")
