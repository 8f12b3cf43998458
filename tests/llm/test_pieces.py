import random

import numpy as np
import pytest

from llm_support import AWKWARD, documents, mixed_texts, rows_of
from postweave.llm import packing, piece_encoding as E, sharding
from postweave.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")
LETTERS = list(" ▁ab\n\t\r éñ<s>/0x　漢字😀\x00́ﬁ'\"()|#²") + ["</s>", "<0x0A>", "  ", "the", "m²."]


@pytest.fixture(scope="module")
def codec():
    return E.PieceCodec(PATH)


def test_encoding_and_decoding_equal_the_library(codec):
    rng = random.Random(2)
    texts = [t or "" for t in AWKWARD] + [
        "".join(rng.choice(LETTERS) for _ in range(rng.randrange(30))) for _ in range(3000)]
    ids, agrees = codec.encode(texts)
    assert all(agrees)
    for text, own in zip(texts, ids):
        theirs = codec.library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(own, "<u4").tolist() == theirs, text
        assert codec.decode(own) == codec.library.decode(theirs), text


def test_agenda_equals_the_library_on_uncut_texts(codec):
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 60)))
        normal = codec.library.normalize(text)
        assert codec.agenda.encode(normal) == codec.library.encode(text)


def test_memory_is_bounded(codec, monkeypatch):
    monkeypatch.setattr(E, "REMEMBERED_PARTS", 50)
    texts, small = [f"word{i} other{i % 20} the" for i in range(400)], E.PieceCodec(PATH)
    for i in range(0, 400, 8):
        assert small.encode(texts[i:i + 8])[0] == codec.encode(texts[i:i + 8])[0]
        assert len(small.known) + len(small.older) < 200


def test_round_trip_of_a_table(spark, codec):
    texts = mixed_texts(7)
    docs = documents(spark, texts)
    rows = rows_of(E.decode(E.encode(docs, PATH), PATH))
    assert all(r["agrees"] and r["salt"] == 2 for r in rows)
    for r in rows:
        theirs = codec.library.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r["ids"], "<u4").tolist() == theirs
        assert r["decoded"] == codec.library.decode(theirs)
    both = {r["doc_id"]: (r["ids"], r["decoded"]) for r in rows_of(E.round_trip(docs, PATH))}
    assert both == {r["doc_id"]: (r["ids"], r["decoded"]) for r in rows}
    assert E.encode(docs.filter("false"), PATH).collect() == []


def brute_force_packing(sizes, capacity):
    room, rows = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(r, k) for k, r in enumerate(room) if r >= sizes[i]]
        if fits:
            k = min(fits)[1]
        else:
            k = len(rows)
            room.append(capacity)
            rows.append([])
        room[k] -= sizes[i]
        rows[k].append(i)
    return rows


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 7, 64, 100])
    sizes = np.array([rng.randint(1, capacity) for _ in range(rng.randrange(1, 300))])
    rows = packing.best_fit_decreasing(sizes, capacity)
    assert sorted(i for row in rows for i in row) == list(range(len(sizes)))
    # Rows of equal room are interchangeable: the amounts of room must be the same.
    used = lambda found: sorted(sum(int(sizes[i]) for i in row) for row in found)
    assert max(used(rows)) <= capacity and used(rows) == used(brute_force_packing(sizes, capacity))


def test_packed_rows_give_the_documents_back(spark, codec):
    texts = mixed_texts(8)
    docs = documents(spark, texts)
    rows = packing.pack(docs.union(docs.filter("doc_id = 7")), PATH, row_tokens=64, group_tokens=3000).collect()
    assert len({r["pack_group"] for r in rows}) > 3
    found = {}
    for r in rows:
        ids, places = np.frombuffer(r["input_ids"], "<u4"), np.frombuffer(r["position_ids"], "<u4")
        ends = r["cu_seqlens"]
        assert len(ids) == len(places) == 64 and ends[0] == 0 and ends[-1] == r["n_tokens"] <= 64
        assert not ids[r["n_tokens"]:].any()
        for doc, part, a, b in zip(r["doc_ids"], r["parts"], ends, ends[1:]):
            assert places[a:b].tolist() == list(range(b - a))
            found.setdefault((doc, part), []).append(ids[a:b].tolist())
    assert len(found[7, 0]) == 2 and all(len(v) == 1 for k, v in found.items() if k[0] != 7)
    for i, text in enumerate(texts):
        whole = [x for part in range(len(found)) if (i, part) in found for x in found[i, part][0]]
        assert whole == codec.library.encode(text or "", add_bos=True, add_eos=True)
    assert packing.pack(docs.filter("false"), PATH).collect() == []


def test_rows_load_as_matrices(spark, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "rows")
    packing.write_rows(packing.pack(documents(spark, ["a b c", "d", None]), PATH, row_tokens=16), path)
    column = pq.read_table(path)["input_ids"].combine_chunks()
    assert packing.matrix(column).shape == (len(column), 16)


def brute_force_table(shards, slots):
    orders = {}
    for name in shards:
        start, step = sharding.preference(name, slots)
        orders[name] = [(start + j * step) % slots for j in range(slots)]
        assert sorted(orders[name]) == list(range(slots))
    owner = {}
    while len(owner) < slots:
        for name in sorted(shards):
            free = [s for s in orders[name] if s not in owner]
            if free:
                owner[free[0]] = name
    return [owner[s] for s in range(slots)]


@pytest.mark.parametrize("shards,slots", [(["a", "b", "c"], 101), (["x"], 7), ([f"s{i}" for i in range(9)], 31)])
def test_table_equals_brute_force(shards, slots):
    filled = sharding.fill_table(shards[::-1], slots)
    assert [shards[::-1][k] for k in filled] == brute_force_table(shards, slots)
    with pytest.raises(ValueError):
        sharding.fill_table(shards, 100)


def test_few_slots_move_when_a_shard_goes():
    names = [f"s{i}" for i in range(20)]
    whole = [names[k] for k in sharding.fill_table(names, 10_007)]
    fewer = [names[:-1][k] for k in sharding.fill_table(names[:-1], 10_007)]
    moved = sum(a != b for a, b in zip(whole, fewer) if a != names[-1])
    assert moved < 0.2 * len(whole)
    assert max(whole.count(n) for n in names) - min(whole.count(n) for n in names) <= 1


def test_placement(spark, tmp_path):
    import hashlib

    docs = documents(spark, ["a", None, "b"] * 5)
    docs = docs.union(docs.filter("doc_id = 3")).union(docs.limit(1).selectExpr("null", *docs.columns[1:]))
    shards = ["one", "two", "three"]
    table = sharding.fill_table(shards)
    rows = rows_of(sharding.place(docs, shards))
    assert len(rows) == 17
    for r in rows:
        digest = hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()
        assert r["slot"] == int(digest[:15], 16) % sharding.SLOTS and r["shard"] == shards[table[r["slot"]]]
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, path, shards)
    assert spark.read.parquet(path).count() == 17
    assert sharding.place(docs.filter("false"), shards).collect() == []
