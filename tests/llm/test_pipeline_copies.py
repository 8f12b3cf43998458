"""Exact copies in the pipeline's line dedup."""

import random

import pytest

import corpus_pipeline
from llm_support import documents, sentence
from postweave.llm import line_dedup


@pytest.mark.parametrize("broadcast", [True, False])
def test_one_of_many_copies_stays_whole(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(line_dedup, "broadcast_if_small", lambda df: df)
        monkeypatch.setattr(line_dedup, "HOT_ROWS", 5)
    rng = random.Random(2)
    copied = "\n".join(sentence(rng, 8, 500) for _ in range(4))
    footed = [sentence(rng, 9, 500) + "\nThe same foot." for _ in range(11)]
    texts = [copied] * 12 + footed + [copied + "\nOne line more."] * 10 + ["The same foot."] * 10
    docs = documents(spark, texts)
    odd = docs.union(docs).union(docs.filter("doc_id = 0").selectExpr("cast(null as bigint)", *docs.columns[1:]))
    found = corpus_pipeline.dedup_lines(spark, odd, "").select("doc_id", "text").collect()
    # The first of the documents with a frequent line keeps it.
    bodies = [(12 + i, t.split("\n")[0] if i else t) for i, t in enumerate(footed)]
    whole = [(0, copied), (23, copied + "\nOne line more.")]
    assert sorted(r[:] for r in found if r["doc_id"] is not None) == sorted((whole + bodies) * 2)
    assert [r["text"] for r in found if r["doc_id"] is None] == [copied]
