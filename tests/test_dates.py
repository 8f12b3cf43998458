import datetime

from pyspark.sql import functions as F

from postweave.functions import dates as D


def test_ordinals_and_buckets_match_python(spark):
    days = ["2012-01-01", "2011-12-31", "2016-12-31", "2017-06-01", "2000-02-29", "2014-07-15"]
    rows = [tuple(d.split("-")) for d in days]
    df = spark.createDataFrame(rows, "year string, month string, day string")
    out = {r[0]: r[1] for r in D.with_time_bucket(df).select("day_ordinal", "time_bucket").collect()}
    first = datetime.date(2012, 1, 1).toordinal()
    width = (datetime.date(2017, 1, 1).toordinal() - first) // 10
    ordinals = [datetime.date.fromisoformat(d).toordinal() for d in days]
    assert out == {o: (o - first) // width for o in ordinals}
    assert out[ordinals[1]] == -1 and out[ordinals[2]] == 10


def test_invalid_dates_are_set_aside(spark):
    df = spark.createDataFrame(
        [("2023", "2", "30"), ("2023", "x", "1"), (None, "1", "1"), ("2023", "02", "3")],
        "year string, month string, day string")
    assert D.with_time_bucket(df).count() == 1
    assert D.invalid_dates(df).count() == 3


def test_width_bucket_floors(spark):
    df = spark.createDataFrame([(-1,), (0,), (59,)], "x int")
    assert [r[0] for r in df.select(D.width_bucket(F.col("x"), 30)).collect()] == [-1, 0, 1]


def test_date_parts(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2014-03-09 23:59:59' AS at")
    assert tuple(D.with_date_parts(df, "at").select("year", "month", "day").first()) == (2014, 3, 9)
