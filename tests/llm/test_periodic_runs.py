import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from llm_support import AWKWARD, documents, mixed_texts, rows_of, sentence
from postweave.llm import batches, parts, periodic_runs as R, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_force(words):
    """All runs, by definition: every period, every stretch."""
    size, found = len(words), []
    for q in range(1, size // 4 + 1):
        i = 0
        while i < size - q:
            j = i
            while j < size - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(
                    all(words[k] == words[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def search(texts, direct=R.DIRECT_PERIODS):
    """Runs of each list of small numbers."""
    lengths = np.array([len(t) + 1 for t in texts])
    words = np.concatenate([np.array([*t, 1000 + i]) for i, t in enumerate(texts)]).astype(np.uint64)
    bases = np.cumsum(lengths) - lengths
    found = [[] for _ in texts]
    for start, length, period in R.find_runs(batches.mixed(words), lengths, direct=direct).tolist():
        k = int(np.searchsorted(bases, start, "right")) - 1
        found[k].append((start - int(bases[k]), length, period))
    return found


def periodic(rng, size):
    """Words with stretches of some periods, nested and next to each other."""
    words = []
    while len(words) < size:
        block = [rng.randrange(rng.choice([2, 3, 9])) for _ in range(rng.randrange(1, 24))]
        if rng.random() < 0.3:
            block = block[:4] * rng.randrange(1, 6) + block
        count = rng.choice([1, 2, 3, 4, 5, 9])
        words += (block * count)[:len(block) * count - rng.randrange(len(block))]
    return words


@pytest.mark.parametrize("direct", [2, 4, 8])
def test_equals_brute_force(direct):
    rng = random.Random(direct)
    texts = [periodic(rng, rng.randrange(1, 160)) for _ in range(300)] + [
        [rng.randrange(2) for _ in range(rng.randrange(60))] for _ in range(300)]
    for text, found in zip(texts, search(texts, direct)):
        assert found == brute_force(text), text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=12), st.integers(1, 9), st.lists(st.integers(0, 2), max_size=30))
def test_repeated_blocks(block, count, tail):
    text = tail[:7] + block * count + tail
    assert search([text], 2)[0] == brute_force(text)


def test_famous_sequences():
    """Sequences with many squares or with none of a fourth power."""
    fibonacci, thue = [0], [0]
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    fibonacci = b
    while len(thue) < 1024:
        thue = thue + [1 - x for x in thue]
    for text in (fibonacci, thue, thue * 5, fibonacci[:80] * 6):
        assert search([text], 2)[0] == brute_force(text)


def test_long_texts_in_time():
    rng, start = random.Random(5), time.time()
    block = [rng.randrange(50) for _ in range(60_000)]
    lone = [rng.randrange(100_000) for _ in range(400_000)]
    texts = [block * 5, [0] * 400_000, [0, 1, 2, 3, 4, 5, 6, 7, 8] * 50_000, lone]
    found = search(texts)
    assert found[0] == [(0, 300_000, 60_000)] and found[1] == [(0, 400_000, 1)]
    assert found[2] == [(0, 450_000, 9)] and found[3] == []
    assert time.time() - start < 30


def collapsed(words, found):
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_table(spark):
    rng = random.Random(6)
    block = sentence(rng, 11)
    texts = [t for t in mixed_texts(6) if t is None or len(t) < 9000] + [
        " ".join([block] * 7), "a\tb\n" * 9 + "end", "x " * 6, "x " * 5, "é 漢\x0b" * 20, " ".join([block] * 4)[:-1]]
    docs = documents(spark, texts)
    docs = docs.withColumn("runs", docs.salt).union(docs.filter("doc_id = 3").withColumn("runs", docs.salt))
    rows = rows_of(R.collapse_runs(docs))
    assert len(rows) == len(texts) + 1
    for r in rows:
        words = WORD.findall(texts[r["doc_id"]] or "")
        found = brute_force(words)
        assert [tuple(x) for x in r["runs"]] == found and r["n_words"] == len(words)
        assert r["collapsed"] == collapsed(words, found) and r["salt"] == 2
    assert R.collapse_runs(docs.filter("false")).collect() == []


def test_slices_of_a_long_text(monkeypatch):
    rng = random.Random(8)
    text = "\n".join(" ".join([sentence(rng, 9)] * 5) for _ in range(800)).encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = batches.runs(~batches.IS_SPACE[data], np.array([0, len(data)]))
    whole = batches.range_hashes(data, starts, ends)
    joined = parts.gathered(data, starts, ends - starts)
    monkeypatch.setattr(batches, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(parts, "CHUNK_BYTES", 1000)
    assert (batches.sliced_hashes(data, starts, ends) == whole).all()
    assert (parts.gathered(data, starts, ends - starts) == joined).all()


def damaged(doc_id, words):
    """The words of a document after periods were planted in every tenth."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = damaged(doc_id, WORD.findall(text or ""))
    found = brute_force(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {"doc_id": doc_id, "n_runs": len(found), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": best[1] * 1000 // best[2] if found else None,
            "runs_sha256": digest("".join(f"{s},{n},{q}\n" for s, n, q in found)),
            "collapsed_sha256": digest(collapsed(words, found))}


def test_planted_periods(spark):
    rng = random.Random(7)
    texts = list(AWKWARD) + [sentence(rng, rng.randrange(1, 120)) for _ in range(300)]
    docs = documents(spark, texts).selectExpr("if(doc_id = 5, null, doc_id) doc_id", "text", "n_lines words", "rows n")
    rows = {r["doc_id"]: r for r in rows_of(queries.periodic_rows(docs))}
    assert sum(r["n_runs"] > 0 for r in rows.values()) > 10
    for i, text in enumerate(texts):
        doc_id = None if i == 5 else i
        assert rows[doc_id] == expected(doc_id, text)


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = rows_of(queries.QUERIES["op12_periodic_runs"](spark, folder))
    assert len(rows) == len(texts)
    for r in rows:
        if len(texts[r["doc_id"]] or "") < 6000:
            assert r == expected(r["doc_id"], texts[r["doc_id"]])
