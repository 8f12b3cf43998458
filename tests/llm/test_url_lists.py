import datetime as dt
import random

import pytest

from check import database, difference
from conftest import SMALL
from llm_support import rows_of
from postweave.llm import oracles, queries, url_lists as U

HOSTS = ["a.example.com", "b.a.example.com", "example.com", "x.org", "deep.b.a.example.com", "localhost"]
START = dt.datetime(2024, 3, 1)


def data(spark, seed=1, captures=150, entries=40):
    rng = random.Random(seed)
    moment = lambda: START + dt.timedelta(hours=rng.randrange(24 * 6) // 2 * 2)
    urls = [f"https://user@{h}:80/p?q#f" for h in HOSTS] + ["HTTP://A.Example.com", None, "", "no url", "mailto:x@y.z"]
    # One host holds most of the captures.
    rows = [(i, rng.choice(urls) if i % 3 else urls[1], moment() if i % 29 else None, "k") for i in range(captures)]
    listed = [(rng.choice(HOSTS), rng.random() < 0.5, moment()) for _ in range(entries)] + [
        (None, True, START), ("x.org", True, None), ("x.org", None, START)]
    return (rows, listed, spark.createDataFrame(rows, "page_id bigint, url string, fetched timestamp, key string"),
            spark.createDataFrame(listed, "key string, listed boolean, at timestamp"))


def hosts(url):
    found = url.split("://")[1].split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower() if (
        url and "://" in url) else None
    labels = found.split(".") if found else []
    return found, [".".join(labels[i:]) for i in range(max(len(labels) - 1, min(len(labels), 1)))]


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_evaluation_equals_brute_force(spark, hot_rows):
    rows, listed, captures, entries = data(spark)
    found = {r["page_id"]: r for r in rows_of(U.evaluate(captures, entries, hot_rows))}
    assert len(found) == len(rows)
    for page, url, fetched, _ in rows:
        host, keys = hosts(url)
        active = 0
        for key in keys:
            past = [(at, bool(flag)) for k, flag, at in listed if k == key and at and fetched and at <= fetched]
            active += bool(past) and max(past)[1]
        assert (found[page]["host"], found[page]["n_listed"], found[page]["blocked"]) == (host, active, active > 0)


def test_intervals(spark):
    _, listed, _, entries = data(spark)
    found = {(r["key"], r["valid_from"]): (r["listed"], r["valid_to"]) for r in rows_of(U.validity_intervals(entries))}
    times = {}
    for key, flag, at in listed:
        if key and at:
            times.setdefault(key, {})[at] = times.get(key, {}).get(at, False) or bool(flag)
    expected = {}
    for key, own in times.items():
        order = sorted(own)
        for at, end in zip(order, [*order[1:], None]):
            expected[key, at] = (own[at], end)
    assert found == expected


def test_empty_tables(spark):
    _, _, captures, entries = data(spark)
    assert not any(r["blocked"] for r in rows_of(U.evaluate(captures, entries.filter("false"))))
    assert U.evaluate(captures.filter("false"), entries).collect() == []
    twice = U.evaluate(captures.union(captures), entries)
    assert twice.count() == 300


def test_query_equals_sql(spark):
    frame = queries.op6_url_lists(spark, SMALL)
    assert difference(frame, database(SMALL).execute(oracles.ORACLES["op6_url_lists"])) == ""


def test_columns_of_captures_stay(spark):
    at = START + dt.timedelta(hours=5)
    captures = spark.createDataFrame([("x.org", at, 1, 2, "s", 3, True, "r")], "key string, at timestamp, day int, "
                                     "salt int, state string, order int, listed boolean, row string")
    entries = spark.createDataFrame([("x.org", False, START)], "key string, listed boolean, at timestamp")
    row = U.as_of(captures, entries).first().asDict()
    assert row == {"key": "x.org", "at": at, "day": 1, "salt": 2, "state": "s", "order": 3, "row": "r",
                   "listed": False, "since": START}
