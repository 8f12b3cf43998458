import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from llm_support import documents, mixed_texts, rows_of
from postweave.llm import batches, byte_encoding as B, parts, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
LETTERS = list(" \t\n\rab'sStd109!?.,é\x00\x1c\x85\xa0  　漢😀") + [
    "'s", "'ll", " the", "  ", "aaaa", "ing", "\n\n"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return B.ByteCodec(PATH, PATTERN)


def encoded(codec, texts):
    found = []
    for _, _, data, offsets in batches.text_chunks(pa.array(texts, pa.string())):
        ids, at = codec.encode(data, offsets)
        found += [ids[a:b] for a, b in zip(at[:-1], at[1:])]
    return found


def check(codec, library, texts):
    for text, ids in zip(texts, encoded(codec, texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text or ""), text
        assert codec.decode(ids) == (text or "").encode()


def test_equals_the_library(codec, library):
    rng = random.Random(1)
    check(codec, library, mixed_texts(3) + [
        "".join(rng.choice(LETTERS) for _ in range(rng.randrange(60))) for _ in range(5000)])


def test_every_character_equals_the_library(codec, library):
    wanted = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000] + [
        chr(c) for c in range(0x3000, 0x110000, 97) if not 0xD800 <= c < 0xE000]
    for around in ("a{}b", "1{} {}2", " {} "):
        check(codec, library, [around.replace("{}", c) for c in wanted])


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abeiné th1"), max_size=200), st.integers(1, 9))
def test_tree_equals_direct_merges(text, leaf):
    tree = TREES.setdefault(leaf, B.TreeEncoder(RANKS, leaf))
    assert tree.reduce(text.encode()) == tree.merge(text.encode())


RANKS, TREES = B.read_ranks(PATH), {}


def brute_force(ranks, text):
    symbols = [text[i:i + 1] for i in range(len(text))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in ranks]
        if not found:
            return [ranks[s] for s in symbols]
        i = min(found)[1]
        symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]


def test_tree_on_random_vocabularies():
    rng = random.Random(4)
    for seed in range(40):
        ranks = {bytes([b]): 1000 + b for b in range(256)}
        while len(ranks) < 300:
            ranks.setdefault(b"".join(rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(2, 7))), len(ranks))
        tree = B.TreeEncoder(ranks, 1 + seed % 4)
        for _ in range(30):
            text = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 60)))
            assert tree.reduce(text) == brute_force(ranks, text)


def test_join_is_associative():
    rng, tree = random.Random(5), B.TreeEncoder(RANKS)
    for _ in range(300):
        a, b, c = (tree.merge(bytes(rng.choice(b"aeinth ") for _ in range(rng.randrange(30)))) for _ in range(3))
        assert tree.join(tree.join(a, b), c) == tree.join(a, tree.join(b, c))


def test_long_matches_and_texts(codec, library):
    rng = random.Random(6)
    start = time.time()
    texts = ["=-" * 100_000, "x" * 20_000, "".join(rng.choice("abcdefghij") for _ in range(200_000)),
             " ".join(f"w{i}" for i in range(400_000)) + "é \n x"]
    for text, ids in zip(texts, encoded(codec, texts)):
        assert codec.decode(ids) == text.encode()
        if len(text) < 50_000 or " " in text:
            assert ids.tolist() == library.encode_ordinary(text)
    assert time.time() - start < 60


def test_colliding_hashes_are_found(codec, library, monkeypatch):
    clashing = lambda data, starts, ends: (ends - starts).astype(np.uint64)
    monkeypatch.setattr(parts, "range_hashes", clashing)
    check(B.ByteCodec(PATH, PATTERN), library, ["one two six", "ten two", "", "some more", "same some"])


def test_memory_is_bounded(codec):
    small = B.ByteCodec(PATH, PATTERN)
    small.parts.remembered = 50
    for i in range(0, 400, 8):
        texts = [f"word{k} other{k % 20} the" for k in range(i, i + 8)]
        assert [x.tolist() for x in encoded(small, texts)] == [x.tolist() for x in encoded(codec, texts)]
        assert len(small.parts.known) + len(small.parts.older) < 200


def test_table_round_trip(spark, library):
    texts = mixed_texts(9)
    docs = documents(spark, texts)
    rows = rows_of(B.decode(B.encode(docs, PATH, PATTERN), PATH, PATTERN))
    assert len(rows) == len(texts) and all(r["salt"] == 2 for r in rows)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(text)
        assert r["decoded"] == text.encode()
    both = rows_of(B.round_trip(docs, PATH, PATTERN))
    assert {(r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in both} == {
        (r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in rows}
    assert B.round_trip(docs.filter("false"), PATH, PATTERN).collect() == []
    assert B.decode(docs.limit(1).selectExpr("cast(null as binary) ids"), PATH, PATTERN).first()["decoded"] is None


def test_registered_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = rows_of(queries.QUERIES["op13_byte_encoding"](spark, folder))
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
