"""Dated lists of hosts, joined as of the time every page was fetched.

List entries say from when on a host or domain is listed or no longer listed. They become validity
intervals: an entry holds until the next one for the same key. A capture is evaluated against
its host and all domains above it, by the entries that held when it was fetched.

The as-of join deals rows by key and day. What held when a day began is carried over once per key
and day, after the days of a key are reduced to one row each; within a key and day, captures and
entries are put in order and the last entry is read off. So a host with a third of all
captures is spread over its days, and a day with very many captures is salted by its count.
No pairs are formed.

Everything is built-in functions. Of several entries for a key at one time, a listing wins. An
entry holds from its own time on, that time included.

Defined cases: a null or unparsable url has no host and is not blocked; so is a capture without a
time. Entries without key or time are ignored. Repeated captures give repeated result rows.
Other columns of the captures are ignored by ``evaluate`` and kept by ``as_of``; an empty list blocks nothing. Urls of any
length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from postweave.operators.joins import HOT_ROWS
from postweave.storage import materialize

# Labels of a host that are looked up besides the host itself: domains of two labels and more.
LEAST_LABELS = 2

HOST_PATTERN = "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """The lower-case host of a url, or null."""
    host = F.lower(F.regexp_extract(url, HOST_PATTERN, 1))
    return F.when(host != "", host)


def keys_of(host: Column) -> Column:
    """The host and the domains above it with at least ``LEAST_LABELS`` labels."""
    labels = F.split(host, "\\.")
    starts = F.sequence(F.lit(1), F.greatest(F.size(labels) - LEAST_LABELS + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``(key, listed, valid_from, valid_to)`` from ``(key, listed, at)``; the last is open-ended.

    One row per key and time. The next entry is looked for within the day first, and among the
    key's days, one row each, after that.
    """
    merged = _merged(entries)
    day = Window.partitionBy("key", "day").orderBy("at")
    days = merged.groupBy("key", "day").agg(F.min("at").alias("first"))
    following = Window.partitionBy("key").orderBy("day")
    days = days.select("key", "day", F.lead("first").over(following).alias("next_day"))
    return merged.withColumn("next", F.lead("at").over(day)).join(days, ["key", "day"]).select(
        "key", "listed", F.col("at").alias("valid_from"),
        F.coalesce("next", "next_day").alias("valid_to"))


def _merged(entries: DataFrame) -> DataFrame:
    valid = entries.filter(F.col("key").isNotNull() & F.col("at").isNotNull())
    return valid.groupBy("key", "at").agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed")).withColumn(
        "day", F.to_date("at"))


def as_of(captures: DataFrame, entries: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``listed`` and ``since`` of the entry that holds for each ``(key, at)``, null if none.

    ``captures`` should be a stored table; columns of theirs with the names of the added ones are replaced.
    """
    names = [c for c in captures.columns if c not in ("listed", "since")]
    captures = captures.select("key", "at", F.struct(*names).alias("row"))
    intervals = validity_intervals(entries)
    # The state at the beginning of every day with captures: the interval that spans it.
    wanted = captures.filter(F.col("key").isNotNull() & F.col("at").isNotNull()).groupBy(
        "key", F.to_date("at").alias("day")).agg(F.count("*").alias("rows"))
    events = intervals.select("key", F.to_date("valid_from").alias("day"),
                              F.struct("valid_from", "listed", "valid_to").alias("state"))
    last = events.groupBy("key", "day").agg(F.max("state").alias("state"))
    timeline = wanted.select("key", "day", F.lit(None).cast(last.schema["state"].dataType).alias("state"),
                             "rows").unionByName(
        last.select("key", "day", "state", F.lit(None).cast("bigint").alias("rows")))
    days = timeline.withColumn("day_number", F.datediff("day", F.lit("1970-01-01"))).withColumn(
        "carried", F.last("state", True).over(
            Window.partitionBy("key").orderBy("day_number").rangeBetween(Window.unboundedPreceding, -1)))
    salts = F.ceil(F.col("rows") / F.lit(hot_rows)).cast("int")
    days = materialize(days.filter(F.col("rows").isNotNull()).select(
        "key", "day", "carried", salts.alias("salts")), "days")
    many = days.filter("salts > 1").select("key", "day", "salts")
    salt = F.pmod(F.xxhash64("row"), F.coalesce("salts", F.lit(1))).cast("int")
    rows = captures.withColumn("day", F.to_date("at")).join(
        F.broadcast(many), ["key", "day"], "left").withColumn("salt", salt).drop("salts")
    # What held when the day began counts as an entry at its beginning, before all others.
    carried = days.select("key", "day", F.lit(0).alias("order"), F.col("day").cast("timestamp").alias("at"),
                          F.col("carried").alias("state"), "salts")
    within = intervals.select("key", F.to_date("valid_from").alias("day"), F.lit(1).alias("order"),
                              F.col("valid_from").alias("at"),
                              F.struct("valid_from", "listed", "valid_to").alias("state")).join(
        days.select("key", "day", "salts"), ["key", "day"])
    states = carried.unionByName(within).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    ours = rows.withColumns({"order": F.lit(2), "state": F.lit(None).cast(states.schema["state"].dataType)})
    both = ours.unionByName(states, allowMissingColumns=True)
    running = Window.partitionBy("key", "day", "salt").orderBy("at", "order").rowsBetween(
        Window.unboundedPreceding, 0)
    # The last interval that began counts up to its end.
    active = F.col("held.valid_to").isNull() | (F.col("at") < F.col("held.valid_to"))
    return both.withColumn("held", F.last("state", True).over(running)).filter("order = 2").select(
        "row.*", F.when(active, F.col("held.listed")).alias("listed"),
        F.when(active, F.col("held.valid_from")).alias("since"))


def evaluate(captures: DataFrame, entries: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(page_id, host, fetched, n_listed, blocked)`` for every capture ``(page_id, url, fetched)``.

    ``n_listed`` counts the host and the domains above it that were listed at fetch time.
    """
    known = captures.select(
        "page_id", host_of(F.col("url")).alias("host"), "fetched")
    numbered = materialize(known.withColumn("row", F.monotonically_increasing_id()), "captures")
    looked_up = materialize(numbered.filter(F.col("host").isNotNull()).select(
        "row", F.col("fetched").alias("at"), F.explode(keys_of(F.col("host"))).alias("key")), "keys")
    hits = as_of(looked_up, entries, hot_rows).filter("listed").groupBy("row").agg(
        F.count("*").alias("hits"))
    n_listed = F.coalesce("hits", F.lit(0)).cast("bigint")
    return numbered.join(hits, "row", "left").select(
        "page_id", "host", "fetched", n_listed.alias("n_listed"), (n_listed > 0).alias("blocked"))
