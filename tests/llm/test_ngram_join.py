import random

import numpy as np
import pyarrow as pa
import pytest

from check import database, difference
from conftest import SMALL
from llm_support import WORDS, by_id, documents, mixed_texts
from postweave.llm import ngram_join as J, oracles, queries


def shingles(text):
    words = WORDS.findall((text or "").encode().lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute_force(texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return {i: (len(s), label[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("block_shingles,hot_rows", [(500_000, 1_000_000), (300, 5)])
def test_components_equal_brute_force(spark, block_shingles, hot_rows):
    texts = mixed_texts(3)
    found = by_id(J.similar_documents(
        documents(spark, texts), block_shingles=block_shingles, hot_rows=hot_rows))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in found.items()} == brute_force(texts)


def test_repeated_rows_and_missing_ids(spark):
    docs = documents(spark, ["a b c d e f", "A b c d e f", None])
    lost = docs.filter("doc_id = 0").selectExpr("cast(null as bigint) AS doc_id", "text")
    rows = J.similar_documents(docs.select("doc_id", "text").union(docs.select("doc_id", "text")).union(lost)).collect()
    assert sorted((str(r[0]), r[1], r[2] if r[2] is not None else -1) for r in rows) == sorted(
        [("0", 2, 0), ("1", 2, 0), ("2", 0, 2)] * 2 + [("None", 2, -1)])
    assert J.similar_documents(docs.filter("doc_id > 5")).collect() == []


def links_of(sets):
    return {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}


def connected(pairs, size):
    label = list(range(size))
    for a, b in pairs:
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("probe_cost", [0.0001, 0.01, 10.0])
def test_divide_skip_finds_all_links(seed, probe_cost, monkeypatch):
    monkeypatch.setattr(J, "PROBE_COST", probe_cost)
    rng = random.Random(seed)
    centres = [set(rng.sample(range(400), rng.randrange(1, 60))) for _ in range(4)]
    sets = []
    for _ in range(40):
        own = set(rng.choice(centres))
        for _ in range(rng.randrange(8)):
            own.discard(rng.randrange(400)) if rng.random() < 0.5 else own.add(rng.randrange(400))
        sets.append(own or {1})
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    links = links_of(sets)
    found = J.search_links(arrays, np.zeros(40, np.int64))
    assert set(found) <= links and connected(found, 40) == connected(links, 40)
    block = np.arange(40) % 2
    across = {(a, b) for a, b in links if block[a] != block[b]}
    found = J.search_links(arrays, block)
    assert set(found) <= across and connected(found, 40) == connected(across, 40)


def test_sets_do_not_depend_on_chunks(monkeypatch):
    texts = mixed_texts(4)
    whole = [s.tobytes() for s in J.shingle_sets(pa.array(texts))]
    parts = [s.tobytes() for t in texts for s in J.shingle_sets(pa.array([t], pa.string()))]
    assert whole == parts
    assert [len(s) // 8 for s in whole] == [len(shingles(t)) for t in texts]


def test_short_text_is_no_part_of_a_longer_one():
    a, b = J.shingle_sets(pa.array(["a b c d", "a b c d e"]))
    assert not set(a.tolist()) & set(b.tolist())


def test_query_equals_sql(spark):
    frame = queries.op10_ngram_join(spark, SMALL)
    assert difference(frame, database(SMALL).execute(oracles.ORACLES["op10_ngram_join"])) == ""


@pytest.mark.parametrize("blocks", [1, 2])
def test_large_groups_of_near_copies_take_little_more_than_linear_time(blocks):
    import time

    rng = np.random.default_rng(1)
    base, seconds = np.sort(rng.integers(0, 1 << 62, 41, dtype=np.uint64)), []
    for size in (3000, 12_000):
        sets = []
        for _ in range(size):
            own = base.copy()
            own[rng.integers(0, 41, 2)] = rng.integers(0, 1 << 62, 2, dtype=np.uint64)
            sets.append(np.unique(own))
        start = time.time()
        found = J.search_links(sets, np.arange(size) % blocks)
        seconds.append(time.time() - start)
        assert len(found) == size - 1
    # Four times the sets would take sixteen times as long if all pairs were looked at.
    assert seconds[1] < 10 * seconds[0] + 2


def test_heap_merge_equals_counting():
    rng = random.Random(9)
    for _ in range(300):
        lists = [sorted(rng.sample(range(60), rng.randrange(1, 30))) for _ in range(rng.randrange(1, 12))]
        entries = [x for held in lists for x in held]
        ends = list(np.cumsum([len(x) for x in lists]))
        least = rng.randrange(1, len(lists) + 1)
        found = list(J.merge_lists(entries, [e - len(x) for e, x in zip(ends, lists)], ends, least))
        counted = [(v, sum(v in x for x in lists)) for v in range(60)]
        assert found == [c for c in counted if c[1] >= least]
