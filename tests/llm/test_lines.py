from collections import Counter, defaultdict

import pytest

from check import database, difference
from conftest import SMALL
from llm_support import documents, by_id, mixed_texts
from postweave.llm import line_dedup, line_quality, oracles, queries


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute_force(texts, least):
    lines = [(t or "").split("\n") for t in texts]
    seen = Counter(k for own in lines for k in {key(x) for x in own} if k)
    kept = [[x for x in own if not key(x) or seen[key(x)] < least] for own in lines]
    return {i: (len(a), len(a) - len(b), "\n".join(b)) for i, (a, b) in enumerate(zip(lines, kept))}


@pytest.mark.parametrize("least,hot_rows,broadcast", [(10, 1_000_000, True), (2, 1_000_000, True), (3, 4, False)])
def test_dedup_equals_brute_force(spark, least, hot_rows, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    texts = mixed_texts(5)
    found = by_id(line_dedup.dedup_lines(documents(spark, texts), least, hot_rows=hot_rows))
    assert {k: (r["n_lines"], r["n_dropped"], r["text"]) for k, r in found.items()} == brute_force(texts, least)
    assert found[3]["label"] is None and found[3]["rows"] == 1


def test_first_occurrences_stay(spark):
    docs = documents(spark, ["a\nb\nA", "b\nc", "c\n\na"])
    found = by_id(line_dedup.dedup_lines(docs, 2, keep_first=True))
    assert [found[i]["text"] for i in range(3)] == ["a\nb", "c", ""]


def test_repeated_rows_count_once(spark):
    docs = documents(spark, ["x\ny", "x", None])
    twice = docs.union(docs).union(docs.selectExpr("cast(null as bigint)", *docs.columns[1:]))
    rows = line_dedup.dedup_lines(twice, 2).select("doc_id", "text").collect()
    assert sorted((str(r[0]), r[1]) for r in rows) == sorted(
        [("0", "y"), ("1", ""), ("2", "")] * 2 + [("None", "x\ny"), ("None", "x"), ("None", "")])
    assert line_dedup.dedup_lines(docs.filter("false"), 2).collect() == []


def metrics(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(i, i + 3)}
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(repeated))


@pytest.mark.parametrize("broadcast", [True, False])
def test_quality_equals_brute_force(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(line_quality, "BROADCAST_ROWS", 0)
    texts = mixed_texts(6)
    docs = documents(spark, texts)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    holders = defaultdict(set)
    plain = lambda line: key(line).translate(str.maketrans("123456789", "000000000"))
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            holders[source[i], plain(line)].add(i)
    found = by_id(line_quality.judge(docs, most_documents=2, hot_rows=1_000_000 if broadcast else 2))
    for i, t in enumerate(texts):
        expected = metrics(t)
        assert tuple(found[i][m] for m in line_quality.METRICS) == expected, i
        gone = sum(len(line.encode().split()) for line in (t or "").split("\n")
                   if key(line) and len(holders[source[i], plain(line)]) > 2)
        failed = expected[0] < 50 or 100 * expected[4] > 50 * expected[0]
        assert found[i]["n_removed_words"] == gone and found[i]["base_failed"] == failed
        assert found[i]["kept"] == (not failed and 100 * (expected[0] - gone) >= 50 * expected[0])


def test_clean_lines_removes_frequent_ones(spark):
    letters = "abcdefghijklmnop"
    texts = ["\n".join([f"Seen {i} times", *(" ".join(own + a + b for b in letters) for a in letters[:6])])
             for i, own in enumerate(letters[:8])]
    docs = documents(spark, texts).withColumn("source", line_quality.F.lit("one"))
    found = line_quality.clean_lines(docs, most_documents=3).collect()
    assert len(found) == 8 and all("Seen" not in r["text"] and len(r["text"].split("\n")) == 6 for r in found)


@pytest.mark.parametrize("name", ["op1_line_quality", "op4_line_dedup"])
def test_queries_equal_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SMALL), database(SMALL).execute(oracles.ORACLES[name])) == ""


def test_long_document_is_rebuilt_in_time(spark):
    import time

    lines = [f"own line {i}" if i % 3 else f"Shared {i % 7}" for i in range(200_000)]
    docs = documents(spark, ["\n".join(lines)] + ["\n".join(f"shared {i}" for i in range(7))] * 3)
    start = time.time()
    found = by_id(line_dedup.dedup_lines(docs, 4))
    assert time.time() - start < 60
    assert found[0]["text"] == "\n".join(x for x in lines if not x.startswith("Shared"))
    assert found[0]["n_lines"] == 200_000 and found[1]["text"] == ""
