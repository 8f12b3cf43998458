import random
import re

import pytest

from check import database, difference
from conftest import SMALL
from llm_support import AWKWARD, by_id, documents, sentence
from postweave.llm import decontamination as D, oracles, queries

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_force(texts, items):
    found = {}
    for i, text in enumerate(texts):
        own, hit, named = words(text), set(), set()
        for item, passage in items:
            theirs = words(passage)
            for k in range(max(1, len(theirs) - 9) if theirs else 0):
                window = theirs[k:k + 10]
                for at in range(len(own) - len(window) + 1):
                    if own[at:at + len(window)] == window:
                        hit.update(range(at, at + len(window)))
                        named.add(str(item))
        found[i] = (len(own), len(hit), sorted(named))
    return found


def passages(seed=4):
    rng = random.Random(seed)
    items = [(i, sentence(rng, rng.choice([1, 2, 3, 9, 10, 11, 25]), 3000)) for i in range(12)]
    items += [(12, items[5][1]), (13, None), (14, "..."), (15, "one one one one one one one one one one one"), (16, "É é")]
    texts = list(AWKWARD)
    for i in range(50):
        text = sentence(rng, rng.randrange(40), 3000).split()
        passage = (rng.choice(items)[1] or "").split()
        cut = passage[rng.randrange(len(passage) + 1):] if i % 3 == 0 else passage
        at = rng.randrange(len(text) + 1)
        texts.append(", ".join(text[:at] + cut + text[at:]).upper() if i % 2 else "-".join(text[:at] + cut + text[at:]))
    texts += ["one " * 30, "É É é é", "  !?one one"]
    return texts, items


@pytest.mark.parametrize("broadcast,hot_rows", [(True, 1_000_000), (False, 5)])
def test_matches_equal_brute_force(spark, broadcast, hot_rows, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(D, "broadcast_if_small", lambda df: df)
    texts, items = passages()
    docs = documents(spark, texts)
    bench = spark.createDataFrame([(i, t, "x") for i, t in [*items, (None, "w1"), items[0]]],
                                  "item_id bigint, text string, term string")
    found = by_id(D.decontaminate(docs.union(docs.filter("doc_id < 5")), bench, hot_rows=hot_rows))
    expected = brute_force(texts, items)
    assert {k: (r["n_words"], r["n_hit"], r["item_ids"]) for k, r in found.items()} == expected
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in found.values())
    assert sum(n > 0 for _, n, _ in expected.values()) > 15


def test_missing_ids_and_empty_tables(spark):
    docs = documents(spark, ["a b c"]).selectExpr("cast(null as bigint) AS doc_id", "text")
    bench = spark.createDataFrame([(1, "b c")], "item_id bigint, text string")
    assert [tuple(r) for r in D.decontaminate(docs, bench).collect()] == [(None, 3, 0, [], False)]
    assert [r["n_hit"] for r in D.decontaminate(documents(spark, ["a b c"]), bench.filter("false")).collect()] == [0]
    assert D.decontaminate(docs.filter("false"), bench).collect() == []


def test_proximity(spark):
    rng = random.Random(5)
    texts = [sentence(rng, 60, 12) for _ in range(8)]
    docs = documents(spark, texts)
    terms = D.number_terms(spark.createDataFrame([("w1",), ("w2",)], "term string"))
    index = D.build_index(docs, terms)
    number = {r["term"]: r["term_id"] for r in terms.collect()}
    pairs = spark.createDataFrame([(1, number["w1"], number["w2"])], "pair int, first_id bigint, second_id bigint")
    found = {(r["doc_id"], r["position"], r["other"]) for r in D.proximity_matches(index, pairs, 3).collect()}
    expected = {(i, a, b) for i, t in enumerate(texts) for a, x in enumerate(t.split()) for b, y in enumerate(t.split())
                if (x, y) == ("w1", "w2") and abs(a - b) <= 3}
    assert found == expected and expected


def test_query_equals_sql(spark):
    frame = queries.op9_decontamination(spark, SMALL)
    assert difference(frame, database(SMALL).execute(oracles.ORACLES["op9_decontamination"])) == ""
