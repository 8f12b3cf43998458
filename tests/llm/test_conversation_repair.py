import hashlib
import random
import re
import time
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from llm_support import rows_of
from postweave.llm import conversation_repair as R, queries

WORD = re.compile("[^\x20\x09-\x0d]")
FOLLOW = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def brute_force(codes):
    """Cost and edits by value iteration over all edits from every place and state."""
    size = len(codes)
    best = {(size, ""): (0, ""), (size, "a"): (0, "")}
    changed = True
    while changed:
        changed = False
        for i in range(size, -1, -1):
            for state in FOLLOW:
                moves = [("I", 5, i, NEXT[state])]
                if i < size:
                    moves.append(("D", 2, i + 1, state))
                    extra = 5 if codes[i].isupper() else 0
                    if codes[i] != "x":
                        moves.append(("R", 1 + extra, i + 1, NEXT[state]))
                        if codes[i].lower() in FOLLOW[state]:
                            moves.append(("K", extra, i + 1, FOLLOW[state][codes[i].lower()]))
                for edit, cost, j, into in moves:
                    if (j, into) in best:
                        found = (cost + best[j, into][0], edit + best[j, into][1])
                        if (i, state) not in best or found < best[i, state]:
                            best[i, state] = found
                            changed = True
    return best[0, ""]


@settings(max_examples=400, deadline=None)
@given(st.text("suaoSUAOx", max_size=14))
def test_search_equals_brute_force(codes):
    assert R.whole_repair(codes) == brute_force(codes)


@pytest.mark.parametrize("rows", [1, 2, 5])
def test_blocks_and_pieces_equal_brute_force(rows, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_ROWS", rows)
    R.block_table.cache_clear()
    rng = random.Random(rows)
    for _ in range(150):
        codes = "".join(rng.choice("suaoSUAOxuaua") for _ in range(rng.randrange(1, 30)))
        expected = brute_force(codes)
        table = R.piece_table(codes)
        assert min((c + 5 * len(R._TAIL[b]), e + R._TAIL[b]) for (a, b), (c, e) in table.items() if a == 0) == expected
        # Pieces by their costs and ranks alone.
        cuts = [codes[i:i + 7] for i in range(0, len(codes), 7)]
        sums = []
        for cut in cuts:
            costs, ranks = [-1] * 16, [0] * 16
            for at, (cost, rank) in R._ranked(cut).items():
                costs[at], ranks[at] = cost, rank
            sums.append((costs, ranks))
        path = R.choose_path(sums)
        cost, edits = 0, ""
        for cut, pair in zip(cuts, path):
            cost, edits = cost + R.piece_table(cut)[pair][0], edits + R.piece_table(cut)[pair][1]
        tail = R._TAIL[path[-1][1]]
        assert (cost + 5 * len(tail), edits + tail) == expected
    R.block_table.cache_clear()


def test_long_conversations_in_time():
    rng, start = random.Random(3), time.time()
    codes = "".join(rng.choice("ux" if i % 2 else "aU") if rng.random() < 0.3 else "ua"[i % 2] for i in range(4000))
    cost, edits = R.whole_repair(codes)
    assert len(edits.replace("I", "")) == 4000 and cost > 500
    assert time.time() - start < 40


def damage(rows):
    kept = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        elif fate == 2 and text is not None:
            text = re.sub("[.!?]", "", text)
        elif fate == 4:
            role = "user"
        kept += [(turn, " " if role is None else role, " " if text is None else text)] * (2 if fate == 3 else 1)
    return sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def expected(conv, rows):
    rows = damage(rows)
    seen, codes, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        letters = WORD.findall(text)
        letter = role[:1] if role[:1] in tuple("sua") else "o"
        if not letters:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "truncated" if letters[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        codes += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
    cost, audit = brute_force(codes)
    lines, i, state = [], 0, ""
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        into = FOLLOW[state][rows[i][1][:1]] if edit == "K" else NEXT[state]
        name = {"u": "user", "a": "assistant"}.get(into)
        lines.append(f"{name}:" if edit == "I" else f"{rows[i][1] if edit == 'K' else name}:{rows[i][2]}")
        i += edit != "I"
        state = into
    turns = {r[0] for r in rows if r[0] is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return {"conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **counts,
            "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


SCHEMA = "conv_id bigint, turn bigint, role string, text string, piece int, faults string"


def conversations(seed, hot=90):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "Why?  ", "and so", "", " \n", None, "Long one. " * 30, "é。", "A.\nB.", "?"]
    for conv in [None, *range(40)]:
        size = hot if conv == 7 else rng.randrange(1, 9)
        for turn in range(size):
            role = rng.choice(["system"] if turn == 0 and rng.random() < .5 else [
                "user" if turn % 2 else "assistant"] * 6 + ["tool", None, "", "user"])
            text = rng.choice(texts) if rng.random() < .5 else f"Text {rng.randrange(10 ** 6)}."
            rows.append((conv, rng.choice([turn] * 9 + [None, 3]), role, text))
            if rng.random() < .05:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("seed,piece_rows,piece_bytes", [(1, 1024, 10 ** 6), (2, 4, 10 ** 6), (3, 7, 90)])
def test_table_equals_brute_force(spark, seed, piece_rows, piece_bytes):
    rows = conversations(seed)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    by_conversation = {}
    for r in rows:
        by_conversation.setdefault(r[0], []).append(r)
    repaired = R.repair(queries.damaged_rows(frame), piece_rows, piece_bytes)
    found = {r["conv_id"]: r for r in rows_of(R.summaries(repaired))}
    assert found.keys() == by_conversation.keys()
    for conv, own in by_conversation.items():
        assert found[conv] == expected(conv, own), (conv, damage(own))
    assert max(len(r["lines"]) for r in repaired.collect()) <= 4 * piece_rows


def test_rows_that_are_gone_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, 2, "user", "Hi."), (1, 3, "assistant", "Yes.")], SCHEMA.split(", piece")[0])
    gone = frame.selectExpr("*", "false present")
    row = rows_of(R.summaries(R.repair(gone)))
    assert row == [{"conv_id": 1, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0,
                    "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}]
    assert R.summaries(R.repair(frame.filter("false"))).collect() == []
    assert rows_of(R.repair(frame))[0]["lines"] == ["user:Hi.", "assistant:Yes."]


def test_registered_query(spark):
    folder, rows = "/root/testdata/sf0.001", {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        rows.setdefault(r["conv_id"], []).append((r["conv_id"], r["turn"], r["role"], r["text"]))
    found = rows_of(queries.QUERIES["op11_conversation_repair"](spark, folder))
    assert len(found) == len(rows)
    for r in found:
        assert r == expected(r["conv_id"], rows[r["conv_id"]])
