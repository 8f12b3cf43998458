"""Registered queries that SQL cannot express, against the libraries and brute force."""

import hashlib
import zlib

import numpy as np
import pytest

from conftest import SMALL
from llm_support import rows_of
from postweave.llm import packing, queries, sharding
from postweave.llm.piece_encoding import codec
from test_pieces import brute_force_table
from test_personal_data import by_the_patterns


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def digest(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_personal_data(spark, texts):
    rows = rows_of(queries.QUERIES["op2_personal_data"](spark, SMALL))
    assert len(rows) == len(texts)
    for r in rows:
        base = by_the_patterns(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == digest(base)
        assert {*filter(None, base.split(","))} <= {*r["spans"].split(",")}
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [
            sum(s.startswith(f"{k}:") for s in base.split(",")) for k in ("email", "ip", "card", "phone")]


def test_sharding(spark, texts):
    table = brute_force_table(queries.SHARDS[:7], 101)
    assert [queries.SHARDS[k] for k in sharding.fill_table(queries.SHARDS[:7], 101)] == table
    rows = rows_of(queries.QUERIES["op3_sharding"](spark, SMALL))
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    filled = sharding.fill_table(queries.SHARDS)
    for r in rows:
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, queries.SHARDS[filled[slot]])


def test_packing(spark, texts):
    library = codec(queries.vocabulary("piece_bpe_32k.model")).library
    rows = rows_of(queries.QUERIES["op5_packing"](spark, SMALL))
    sizes = {}
    for r in rows:
        assert r["cu_seqlens"][-1] == r["n_tokens"] <= packing.ROW_TOKENS
        for doc, part, a, b in zip(r["doc_ids"], r["parts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            sizes[doc, part] = b - a
    expected = {}
    for doc, text in texts.items():
        n = len(library.encode(text or "", add_bos=True, add_eos=True))
        for part, at in enumerate(range(0, n, packing.ROW_TOKENS)):
            expected[doc, part] = min(packing.ROW_TOKENS, n - at)
    assert sizes == expected


def test_piece_encoding(spark, texts):
    library = codec(queries.vocabulary("piece_bpe_32k.model")).library
    rows = rows_of(queries.QUERIES["op8_piece_encoding"](spark, SMALL))
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["agrees"] and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == digest(np.array(ids, "<u4").tobytes())
        assert r["decoded_sha256"] == digest(library.decode(ids))


def test_language(spark, texts):
    rows = rows_of(queries.QUERIES["op7_language_id"](spark, SMALL))
    assert len(rows) == len(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in texts[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == (not letters)
