import binascii

import numpy as np
import pyarrow as pa

from conftest import SMALL
from llm_support import AWKWARD, documents, rows_of
from postweave.llm import language as L, queries
from postweave.sources.derive import table


def padded(text):
    """Letters of a text in lower case, with one blank for anything else between words."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c if c.isalpha() else " "
                  if c.isalpha() else " " for c in text) if text else ""
    return "".join(c if c.isalpha() else " " for c in low).split()


def grams(text):
    found = {}
    for word in padded(text):
        run = f" {word} "
        for size in (1, 2, 3):
            for i in range(len(run) - size + 1):
                gram = run[i:i + size]
                if gram.strip() and not (size == 3 and gram[1] == " "):
                    found[gram] = found.get(gram, 0) + 1
    return found


def code(gram):
    points = [1 if c == " " else ord(c) for c in gram] + [0, 0]
    return (points[0] << 42) | (points[1] << 21) | points[2]


TEXTS = [t for t in AWKWARD if t] + ["Das Haus steht. Das Haus!", "el niño y la niña", "a a a b", "ÀÉ é"]


def test_grams_equal_brute_force():
    column = pa.array(TEXTS)
    (_, _, data, offsets), = L.text_chunks(column)
    documents_, wide, counts = L._grams(data, offsets)
    for i, text in enumerate(TEXTS):
        own = documents_ == i
        assert dict(zip(wide[own].tolist(), counts[own].tolist())) == {
            code(g): n for g, n in grams(text).items()}, text


def test_prediction_equals_brute_force():
    names, places = ["aa", "bb", "cc"], 12
    sources = ["the cat sat on the mat and the hat", "der hund und die katze und der ball", "el perro y la gata"]
    ranked = [sorted(grams(s), key=lambda g, s=s: (-grams(s)[g], code(g)))[:places] for s in sources]
    every = sorted({code(g) for r in ranked for g in r})
    table_ = np.full((len(every), 3), places, np.int32)
    for k, own in enumerate(ranked):
        for place, gram in enumerate(own):
            table_[every.index(code(gram)), k] = place
    profiles = L.Profiles(names, np.array(every), table_, places)
    found, scores = profiles.predict(pa.array([*TEXTS, None, ""]))
    for i, text in enumerate([*TEXTS, None, ""]):
        own = grams(text)
        order = sorted(own, key=lambda g: (-own[g], code(g)))[:places]
        distance = [sum(abs(r.index(g) - i) if g in r else places for i, g in enumerate(order)) for r in ranked]
        expected = names[distance.index(min(distance))] if order else "und"
        assert found[i] == expected, text
        assert np.isclose(scores[i], 1 - min(distance) / (places * len(order)) if order else 0.0)


def test_no_text_no_language(spark):
    docs = documents(spark, [None, "", "123 !", "The cat and the dog", "Der Hund und die Katze"] * 3,
                     ["en", "en", None, "en", "de"] * 3)
    profiles = L.learn_profiles(docs)
    assert profiles.names == ["de", "en"]
    rows = rows_of(L.identify(docs, profiles))
    assert [r["lang_pred"] for r in rows] == ["und", "und", "und", "en", "de"] * 3
    assert all(0 <= r["score"] <= 1 for r in rows) and rows[0]["label"] is None
    nothing = L.learn_profiles(docs.filter("false"))
    assert {r["lang_pred"] for r in rows_of(L.identify(docs, nothing))} == {"und"}


def test_held_out_accuracy(spark):
    spoken = {r["doc_id"]: r["lang"] for r in table(spark, SMALL, "documents").collect()}
    rows = queries.op7_language_id(spark, SMALL).collect()
    assert len(rows) == len(spoken)
    for r in rows:
        assert r["held_out"] == (binascii.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == spoken[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_sample_has_the_smallest_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.range(3000).selectExpr("id doc_id", "if(id % 9 = 0, 'de', 'en') lang")
    rows = rows.union(rows.filter("doc_id < 500"))
    hashes = {}
    for r in rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct().collect():
        hashes.setdefault(r["lang"], []).append((r["h"], r["doc_id"]))
    for spare in (3, 0.5):
        # With half as many as wanted below the bound, everything is ranked.
        monkeypatch.setattr(L, "SPARE", spare)
        found = {}
        for r in L.smallest_hashes(rows, 40).collect():
            found.setdefault(r["lang"], set()).add(r["doc_id"])
        assert found == {k: {d for _, d in sorted(v)[:40]} for k, v in hashes.items()}
