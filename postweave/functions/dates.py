"""Day ordinals and time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The first day of the bucketed range, its ordinal and that of the day after the last, and
# the default number of buckets.
FIRST_DAY = "2012-01-01"
FIRST_ORDINAL = 734503
END_ORDINAL = 736330
BUCKETS = 10


def cast_date_parts(df: DataFrame) -> DataFrame:
    """Turn textual year, month and day into integers (unreadable ones into NULL)."""
    types = dict(df.dtypes)
    return df.withColumns({
        c: F.col(c).try_cast("int") if types[c] == "string" else F.col(c).cast("int")
        for c in ("year", "month", "day")})


def parts_to_date(year: Column, month: Column, day: Column) -> Column:
    """A date, or NULL where the integers name no calendar day."""
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(year, month, day, zero, zero, zero).cast("date")


def date_ordinal(date: Column) -> Column:
    """Days in the proleptic Gregorian calendar, with 0001-01-01 as day 1."""
    return F.datediff(date, F.lit("0001-01-01").cast("date")) + F.lit(1)


def ordinal_bucket(ordinal: Column, buckets: int = BUCKETS,
                   first: int = FIRST_ORDINAL, end: int = END_ORDINAL) -> Column:
    """Floor of the day's distance from ``first`` in units of ``(end - first) // buckets``.

    Days outside the range get negative or larger numbers; nothing is clamped, and
    because the unit is rounded down there is one bucket more than ``buckets``.
    """
    width = (end - first) // buckets
    return F.floor((ordinal - F.lit(first)) / F.lit(width)).cast("int")


def width_bucket(value: Column, width: int) -> Column:
    """Bucket number for buckets of a fixed width."""
    return F.floor(value / F.lit(width)).cast("int")


def with_time_bucket(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Replace year, month, day by ``day_ordinal`` and ``time_bucket``; drop non-dates."""
    date = parts_to_date(F.col("year"), F.col("month"), F.col("day"))
    return (
        cast_date_parts(df)
        .withColumn("day_ordinal", date_ordinal(date))
        .filter(F.col("day_ordinal").isNotNull())
        .withColumn("time_bucket", ordinal_bucket(F.col("day_ordinal"), buckets))
        .drop("year", "month", "day")
    )


def invalid_dates(df: DataFrame) -> DataFrame:
    """The rows ``with_time_bucket`` drops, for inspection."""
    checked = cast_date_parts(df)
    return checked.filter(parts_to_date(F.col("year"), F.col("month"), F.col("day")).isNull())


def with_date_parts(df: DataFrame, timestamp: str) -> DataFrame:
    """Split a timestamp column into year, month and day."""
    at = F.col(timestamp)
    return df.withColumns({"year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at)})
