"""Reading and writing posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from postweave.operators.rows import non_empty

# Fixed value: the label file left out when labelled ids are read.
EXCLUDED_FILE = "2014-sydneysiege.ids"

POST_SCHEMA = "label string, id bigint, year int, month int, day int, text string"


def load_posts(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Posts with a non-empty text from a Parquet table."""
    posts = non_empty(spark.read.parquet(path))
    return posts.select(*columns) if columns else posts


def labelled_ids(spark: SparkSession, folder: str, excluded: str = EXCLUDED_FILE) -> DataFrame:
    """``(label, id)`` from a folder of text files with one id per line.

    Either each file is named after its label, or the files of a label are below a
    folder ``label=<name>``. One scan, whatever the number of files.
    """
    lines = spark.read.text(folder)
    label = F.col("label") if "label" in lines.columns else F.col("_metadata.file_name")
    return (
        lines.select(label.cast("string").alias("label"), F.col("value").alias("id"))
        .filter(F.col("label") != excluded)
    )


def rows_to_frame(spark: SparkSession, rows: list, schema: str | StructType = POST_SCHEMA) -> DataFrame:
    """A frame from a few local rows, with a stated schema."""
    return spark.createDataFrame(rows, schema)


def save_posts(posts: DataFrame, path: str, partition: str | None = None,
               mode: str = "error") -> None:
    """Write a Parquet table, by default refusing to replace one.

    With ``partition``, rows are first gathered by it so that every folder gets few
    files; popular values are split by AQE's rebalancing.
    """
    if partition is None:
        posts.write.mode(mode).parquet(path)
        return
    posts.hint("rebalance", partition).write.mode(mode).partitionBy(partition).parquet(path)


def keyword_search(posts: DataFrame, text: Column, at: Column, keyword: str, end: str,
                   count: int = 10) -> DataFrame:
    """The ``count`` latest posts up to ``end`` that contain ``keyword``."""
    return (
        posts.filter(F.contains(text, F.lit(keyword)) & (at <= F.lit(end).cast("timestamp_ntz")))
        .orderBy(at.desc(), "id").limit(count)
    )
