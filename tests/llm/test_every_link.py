"""All links of the n-gram join, not only those that connect."""

import random

import numpy as np
import pytest

from llm_support import documents, mixed_texts
from postweave.llm import ngram_join as J
from pyspark.sql import functions as F
from test_ngram_join import links_of, shingles


@pytest.mark.parametrize("seed", range(4))
def test_search_finds_every_link(seed):
    rng = random.Random(seed)
    centre = set(range(50))
    sets = [centre - {rng.randrange(50)} | {100 + rng.randrange(9)} for _ in range(30)]
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    links, block = links_of(sets), np.arange(30) % 2
    assert len(links) > 29 and set(J.search_links(arrays, np.zeros(30, np.int64), every=True)) == links
    assert set(J.search_links(arrays, block, every=True)) == {(a, b) for a, b in links if block[a] != block[b]}


@pytest.mark.parametrize("block_shingles", [500_000, 300])
def test_pairs_equal_brute_force(spark, block_shingles):
    texts = mixed_texts(3)
    docs, own = documents(spark, texts), [shingles(t) for t in texts]
    first = {s: i for i, s in reversed(list(enumerate(own))) if s}
    ids = sorted(first.values())
    sets = J.set_table(docs)
    chosen = sets.filter(F.col("doc_id").isin(ids)).select("doc_id", "n_shingles")
    found = J.similar_pairs(docs, sets, chosen, block_shingles=block_shingles, every=True).collect()
    expected = {(ids[a], ids[b]) for a, b in links_of([own[i] for i in ids])}
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == expected and len(expected) > len(ids) / 4
