"""Streams by event time against a replay of their batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postweave.storage import scratch_path
from postweave.streaming import event_time as E
from postweave.streaming.online import WindowComponents

SCHEMA = "event_id bigint, user_id bigint, event_type string, value double, at timestamp"
START = dt.datetime(2024, 3, 1)
HOUR = dt.timedelta(hours=1)


def batches(seed, count=5, size=120, hot=False):
    """Batches that move on in time, with rows from long before, ties, missing times and repeated values."""
    rng, found, number = random.Random(seed), [], 0
    for k in range(count):
        rows = []
        for _ in range(size):
            back = rng.randrange(20) if rng.random() < .3 else rng.randrange(4)
            at = START + HOUR * (k * 4 + 4 - back) + dt.timedelta(milliseconds=rng.randrange(3_600_000))
            rows.append((number, 1 if hot else rng.randrange(4), rng.choice(["purchase", "view", "click", None]),
                         float(rng.randrange(9)) if rng.random() < .95 else None, None if rng.random() < .02 else at))
            number += 1
        found.append(rows)
    return found


def window_of(at):
    return at.replace(minute=0, second=0, microsecond=0)


def replay(arrived, lateness=2 * HOUR):
    """Timely and late rows, and the last watermark."""
    timely, late, watermark, newest = [], [], None, None
    for rows in arrived:
        fresh = []
        for r in rows:
            if r[4] is None or watermark is not None and window_of(r[4]) + HOUR <= watermark:
                late.append(r)
            else:
                fresh.append(r)
        timely += fresh
        newest = max([r[4] for r in fresh] + ([newest] if newest else []))
        watermark = newest - lateness
    return timely, late, watermark


def run(spark, arrived, build):
    """The result of an append-mode query, with the progress of its batches."""
    path, out, checkpoint = (scratch_path(spark, x) for x in ("arrivals", "closed", "checkpoint"))
    timely, progress = E.TimelyStream(spark, scratch_path(spark, "events"), "1 hour", "2 hours"), []
    for rows in arrived:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        timely.start(spark.readStream.schema(SCHEMA).parquet(path)).awaitTermination()
        result = build(timely.timely())
        running = E.append_closed(result, out, checkpoint)
        running.awaitTermination()
        progress += running.recentProgress
    return spark.read.schema(result.schema).parquet(out), timely, progress


def dropped(progress):
    return sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])


@pytest.mark.parametrize("seed", [1])
def test_windows_and_late_rows(spark, seed):
    arrived = batches(seed)
    found, timely, progress = run(spark, arrived, lambda rows: E.window_totals(rows, "1 hour", "value", "event_type"))
    kept, late, watermark = replay(arrived)
    assert late and dropped(progress) == 0
    assert sorted(r["event_id"] for r in timely.late().collect()) == sorted(r[0] for r in late)
    expected = {}
    for r in kept:
        if r[4] is not None and window_of(r[4]) + HOUR <= watermark:
            n, total = expected.get((window_of(r[4]), r[2]), (0, 0.0))
            expected[window_of(r[4]), r[2]] = (n + 1, total + (r[3] or 0.0))
    rows = found.collect()
    assert len(rows) == len(expected)
    for r in rows:
        n, total = expected[r["window_start"], r["event_type"]]
        assert (r["events"], r["total"] or 0.0) == (n, total)
    # What is left in the state are open windows only.
    open_groups = {(window_of(r[4]), r[2]) for r in kept if r[4] is not None and window_of(r[4]) + HOUR > watermark}
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == len(open_groups)


@pytest.mark.parametrize("hot", [False, True])
def test_candidates_are_counted_without_pairs(spark, hot):
    arrived = batches(3, hot=hot)
    found, _, progress = run(spark, arrived, lambda rows: E.candidates_before(
        rows.filter("event_type = 'purchase'"), rows.filter("event_type IN ('view', 'click')"),
        "1 hour", "user_id", "event_id"))
    kept, _, watermark = replay(arrived)
    assert dropped(progress) == 0
    expected = {}
    for a in kept:
        for b in kept:
            if a[2] == "purchase" and b[2] in ("view", "click") and a[1] == b[1] and a[4] and b[4]:
                if window_of(b[4]) + HOUR <= watermark and window_of(a[4]) - window_of(b[4]) in (0 * HOUR, HOUR):
                    key = (a[0], window_of(b[4]))
                    expected[key] = expected.get(key, 0) + 1
    rows = found.collect()
    assert {(r["event_id"], r["window_start"]): r["candidates"] for r in rows} == expected
    # At most two rows per purchase, however many candidates there are.
    assert len(rows) <= 2 * sum(r[2] == "purchase" for r in kept)


@pytest.mark.parametrize("parts", [3])
def test_top_lists_hold_no_more_than_they_return(spark, parts):
    arrived = batches(4)
    found, _, progress = run(spark, arrived, lambda rows: E.top_of_windows(
        rows, "1 hour", 3, "value", "event_id", "event_type", parts))
    kept, _, watermark = replay(arrived)
    assert dropped(progress) == 0
    expected, groups = set(), {}
    for r in kept:
        if r[4] is not None and r[3] is not None and window_of(r[4]) + HOUR <= watermark:
            groups.setdefault((window_of(r[4]), r[2]), []).append((-r[3], r[0]))
    for (start, kind), rows in groups.items():
        expected |= {(start, kind, i + 1, name, -value) for i, (value, name) in enumerate(sorted(rows)[:3])}
    merged = E.merge_tops(found, 3, "value", "event_id", "event_type")
    assert {tuple(r) for r in merged.collect()} == expected
    sizes = found.groupBy("window_start", "event_type", "part").count().agg(F.max("count")).first()[0]
    assert sizes <= 3


def test_a_batch_that_runs_again_changes_nothing(spark):
    arrived = batches(5, 3, 40)
    timely = E.TimelyStream(spark, scratch_path(spark, "events"), "1 hour", "2 hours")
    timely.schema = SCHEMA
    seen = []
    for number, rows in enumerate(arrived):
        for _ in range(2):
            timely.update(spark.createDataFrame(rows, SCHEMA), number)
            seen.append((timely.watermark(), sorted(r["event_id"] for r in timely.late().collect())))
    assert seen[0::2] == seen[1::2]
    assert seen[-1][0] == replay(arrived)[2]


def brute_force_components(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a)
        label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("seed,window", [(1, 1), (2, 3)])
def test_window_components_equal_brute_force(spark, seed, window):
    rng = random.Random(seed)
    bucket = {i: i // 6 for i in range(48)}
    edges = [(a, b) for a in bucket for b in bucket
             if a != b and abs(bucket[a] - bucket[b]) <= 1 and rng.random() < .08]
    found, seen = WindowComponents(spark, scratch_path(spark, "window"), window), []
    for number in range(3):
        own = [e for e in edges if max(bucket[e[0]], bucket[e[1]]) // 2 == number]
        batch = spark.createDataFrame([(a, b, bucket[a], bucket[b]) for a, b in own],
                                      "src bigint, dst bigint, src_bucket int, dst_bucket int")
        found.update(batch, number)
        found.update(batch, number)
        seen += own
        newest = max(bucket[x] for e in seen for x in e)
        alive = [e for e in seen if min(bucket[e[0]], bucket[e[1]]) >= newest - window]
        expected = brute_force_components(alive)
        rows = {r["id"]: r["component"] for r in found.components().collect()}
        assert rows == expected
        forest = spark.read.parquet(f"{found.path}/forests/batch={number}").filter("high IS NOT NULL")
        assert forest.groupBy("bucket", "high").count().filter("count > 1").isEmpty()


def test_components_part_when_posts_leave(spark):
    found = WindowComponents(spark, scratch_path(spark, "window"), 1)
    schema = "src bigint, dst bigint, src_bucket int, dst_bucket int"
    # Post 1 holds two pairs together until its bucket leaves.
    found.update(spark.createDataFrame([(1, 10, 0, 1), (1, 20, 0, 1), (10, 11, 1, 1), (20, 21, 1, 1)], schema), 0)
    assert {r["id"]: r["component"] for r in found.components().collect()} == {1: 1, 10: 1, 11: 1, 20: 1, 21: 1}
    found.update(spark.createDataFrame([(21, 30, 1, 2)], schema), 1)
    assert {r["id"]: r["component"] for r in found.components().collect()} == {10: 10, 11: 10, 20: 20, 21: 20, 30: 20}
    found.update(spark.createDataFrame([], schema), 2)
    assert found.components().count() == 5
    found.update(spark.createDataFrame([(90, 91, 9, 9)], schema), 3)
    assert {r["id"]: r["component"] for r in found.components().collect()} == {90: 90, 91: 90}


def test_state_has_few_parts_whatever_the_shuffle(spark):
    key, before, cores = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"), 4
    spark.conf.set(key, "40")
    try:
        found, _, progress = run(spark, batches(1, count=1), lambda rows: E.window_totals(rows, "1 hour", "value", "event_type"))
        assert spark.conf.get(key) == "40"
    finally:
        spark.conf.set(key, before)
    parts = {s["numShufflePartitions"] for p in progress for s in p["stateOperators"]}
    assert parts and max(parts) <= E.STATES_PER_CORE * cores and not found.isEmpty()
