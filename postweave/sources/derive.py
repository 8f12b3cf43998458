"""Posts and vectors derived from stored tables of documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postweave.functions.dates import FIRST_DAY, with_time_bucket
from postweave.operators.rows import spread

# Every table of embeddings is read as words of this many components.
WORD_WIDTH = 8
# Days are spread over the bucketed range by multiplying ids with this number.
DAY_STEP = 37
DAY_SPAN = 1827


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_dates(df: DataFrame, key: str) -> DataFrame:
    """Give every row a day of the bucketed range, as year, month and day."""
    offset = F.pmod(F.col(key) * DAY_STEP, F.lit(DAY_SPAN)).cast("int")
    date = F.date_add(F.lit(FIRST_DAY).cast("date"), offset)
    return df.withColumns({"year": F.year(date), "month": F.month(date), "day": F.dayofmonth(date)})


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Posts with sentence, word and hashtag vectors, from the embeddings table."""
    source = with_dates(table(spark, folder, "embeddings"), "vec_id")
    words = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("embedding") / WORD_WIDTH).cast("int") - 1),
        lambda i: F.slice("embedding", i * WORD_WIDTH + 1, WORD_WIDTH))
    tagged = F.slice("word_embeddings", 1, F.pmod("id", F.lit(4)).cast("int"))
    return with_time_bucket(source).select(
        F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"),
        F.concat(F.lit("post "), F.col("vec_id").cast("string")).alias("text"),
        F.col("embedding").alias("sentence_embeddings"), words.alias("word_embeddings"),
        "day_ordinal", "time_bucket",
    ).withColumn("hashtags_embeddings", tagged)


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled, dated posts from the documents table, with hashtag, mention, URL and repost mark."""
    repost = F.when(F.col("doc_id") % 3 == 0, F.lit("RT ")).otherwise(F.lit(""))
    text = F.concat(
        repost, F.col("text"), F.lit(" #"), F.initcap("lang"), F.lit("Topic"),
        (F.col("doc_id") % 7).cast("string"), F.lit(" @"), F.col("source"),
        F.lit(" https://ex.example/"), F.col("doc_id").cast("string"))
    return with_dates(spread(table(spark, folder, "documents")), "doc_id").select(
        F.col("source").alias("label"), F.col("doc_id").alias("id"),
        "year", "month", "day", text.alias("text"), "lang")
