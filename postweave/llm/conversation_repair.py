"""Cheapest repairs of the turn structure of conversations.

The rows of a conversation are taken by turn. A row is faulty if it has no word (blank), repeats the role and text of an
earlier row (duplicate) or does not end a sentence (truncated). Edits turn the rows into a conversation whose roles read
``system? (user assistant)*`` by their initials, with nothing after a lone system row: Keep (K) costs 0, Rerole (R) to user
or assistant 1, Delete (D) 2 and Insert (I) of an empty user or assistant row 5; a truncated row that
stays costs 5 more, and blank and duplicate rows must go. Of the cheapest lists of edits, the least in ASCII order counts.

``Search`` finds it by iterative-deepening A*: depth first with the edits in ASCII order, under a cost bound that grows to the
least cost that went beyond it; the rows that must still be paid for are the estimate. A table keeps for every state that
failed the least cost known to be needed from there, so no state is searched twice under one bound. Under the first bound that
suffices, the first path that is accepted is the answer.

A conversation is not held whole. All rows are range-partitioned by conversation and turn, sorted and cut into pieces of
bounded size. The conversations that lie in one piece, nearly all, are searched there. For the others,
each piece is searched between all pairs of states, block by block; lists of edits that end in different states differ within
the piece, so their order there decides between equal costs, and a piece is summed up by 16 costs and ranks. One task per
conversation chooses the path through these sums, some 200 bytes for ``PIECE_ROWS`` rows, and the pieces are then edited where they
lie. First occurrences of roles and texts come from a grouping, of which a piece gets its own back.

Defined cases: a null conversation is one of its own; null turns come first; null roles and texts count as one space. Rows of
equal turns go by role and text; repeated rows are duplicates. Rows that are not ``present`` only make their conversation
known; one without other rows has no edits. Any text length is fine; a piece ends at ``PIECE_BYTES``. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from postweave.llm.columns import SPACES, broadcast_if_small
from postweave.storage import materialize

# A piece of a conversation ends at so many rows or bytes of text; it is searched in blocks of rows.
PIECE_ROWS, PIECE_BYTES, BLOCK_ROWS = 1024, 4_000_000, 32
# Searches remembered by a Python worker.
REMEMBERED = 50_000

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5

# States: before any row, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
# What may follow a state, by role initial, and the state of the one user or assistant row that may.
_FOLLOW = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
_NEXT = [USER, USER, ASSISTANT, USER]
_NAMES = {USER: "user", ASSISTANT: "assistant"}
# Inserts that complete a conversation after a state.
_TAIL = ["", "II", "I", ""]
_NEVER = 1 << 40

# Rows as letters: x must go; else the role's initial (s, u, a or o), in upper case if truncated.
GONE = "x"


class Search:
    """Searches over the rows of one block, for one goal; what fails is remembered across calls."""

    def __init__(self, codes: str, goal: int | None):
        self.codes, self.goal, self.size = codes, goal, len(codes)
        owed = [0]
        for code in reversed(codes):
            owed.append(owed[-1] + (DELETE if code == GONE or code.isupper() else 0))
        # The least that the rows from a place on cost, whatever becomes of them.
        self.owed = owed[::-1]
        self.needed: dict[tuple[int, int], int] = {}

    def _moves(self, at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """``(edit, cost, place, state)`` in ASCII order of the edits."""
        if at < self.size:
            yield "D", DELETE, at + 1, state
        if at < self.size or self.goal is None:
            yield "I", INSERT, at, _NEXT[state]
        if at < self.size and self.codes[at] != GONE:
            code = self.codes[at]
            extra = TRUNCATED if code.isupper() else 0
            into = _FOLLOW[state].get(code.lower())
            if into is not None:
                yield "K", extra, at + 1, into
            if into != _NEXT[state]:
                yield "R", REROLE + extra, at + 1, _NEXT[state]

    def _descend(self, at: int, state: int, budget: int, edits: list[str]) -> int:
        """0 if the goal is reached within the budget, with the edits in reverse; else the least cost needed."""
        if at == self.size and (state in (START, ASSISTANT) if self.goal is None else state == self.goal):
            return 0
        least = _NEVER
        for edit, cost, place, into in self._moves(at, state):
            left = budget - cost
            need = self.needed.get((place, into), self.owed[place])
            if need <= left:
                need = self._descend(place, into, left, edits)
                if not need:
                    edits.append(edit)
                    return 0
            least = min(least, cost + need)
        self.needed[at, state] = least
        return least

    def cheapest(self, state: int, most: int) -> tuple[int, str] | None:
        """Cost and edits from a state at the first row to the goal; None if it takes more than ``most``."""
        bound = self.needed.get((0, state), self.owed[0])
        while bound <= most:
            edits: list[str] = []
            need = self._descend(0, state, bound, edits)
            if not need:
                return bound, "".join(reversed(edits))
            bound = need
        return None


def whole_repair(codes: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    if len(codes) <= BLOCK_ROWS:
        return _short_repair(codes)
    return min((cost + INSERT * len(_TAIL[end]), edits + _TAIL[end])
               for (start, end), (cost, edits) in piece_table(codes).items() if start == START)


@lru_cache(REMEMBERED)
def _short_repair(codes: str) -> tuple[int, str]:
    # All rows can go.
    return Search(codes, None).cheapest(START, DELETE * len(codes))


@lru_cache(REMEMBERED // 10)
def block_table(codes: str) -> dict[tuple[int, int], tuple[int, str]]:
    """Cost and edits between all states before and after a block; the last edit uses its last row."""
    table = {}
    for goal in STATES:
        search = Search(codes, goal)
        for state in STATES:
            # Nothing leads back to the start, nor to the system row but from the start.
            if goal == START != state or goal == SYSTEM and state not in (START, SYSTEM):
                continue
            if goal == SYSTEM != state and "s" not in codes.lower():
                continue
            found = search.cheapest(state, DELETE * len(codes) + 3 * INSERT)
            if found is not None:
                table[state, goal] = found
    return table


def piece_table(codes: str) -> dict[tuple[int, int], tuple[int, str]]:
    """The same of several blocks: of equal costs, the least in ASCII order."""
    blocks = [codes[i:i + BLOCK_ROWS] for i in range(0, len(codes), BLOCK_ROWS)]
    table = block_table(blocks[-1])
    for block in reversed(blocks[:-1]):
        joined = {}
        for (start, middle), (cost, edits) in block_table(block).items():
            for end in STATES:
                if (middle, end) in table:
                    more, rest = table[middle, end]
                    found = (cost + more, edits + rest)
                    joined[start, end] = min(joined.get((start, end), found), found)
        table = joined
    return table


def repaired_lines(roles: list[str], texts: list[str], edits: str, state: int) -> list[str]:
    """``role:text`` of the rows that result from the edits, from a state on."""
    lines, at = [], 0
    for edit in edits:
        if edit == "D":
            at += 1
            continue
        into = _FOLLOW[state].get(roles[at][:1]) if edit == "K" else _NEXT[state]
        if edit == "I":
            lines.append(f"{_NAMES[into]}:")
        else:
            lines.append(f"{roles[at] if edit == 'K' else _NAMES[into]}:{texts[at]}")
            at += 1
        state = into
    return lines


def _coded(roles: list[str], faults: list[int]) -> str:
    """Rows as letters; faults are 0 none, 1 blank, 2 duplicate, 3 truncated."""
    letters = []
    for role, fault in zip(roles, faults):
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        letters.append(GONE if fault in (1, 2) else letter.upper() if fault == 3 else letter)
    return "".join(letters)


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


BLANK, DUPLICATE, CUT_SHORT = 1, 2, 3

_PIECE = ("conv_id {kind}, piece bigint, closed boolean, first_turn bigint, last_turn bigint, n_turns bigint, "
          "roles array<string>, texts array<string>, faults array<int>, digests array<binary>")
_NAMES_OF_PIECE = ["conv_id", "piece", "closed", "first_turn", "last_turn", "n_turns", "roles", "texts", "faults",
                   "digests"]


def _last_letter(text: Column) -> Column:
    """The last character that is no white space."""
    return F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))


def pieces(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Bounded pieces of conversations, in order of their numbers.

    ``closed`` pieces are whole conversations, and their faults are final. In the others duplicates are not
    marked yet, and ``digests`` tell rows with equal role and text.
    """
    if "present" not in rows.columns:
        rows = rows.withColumn("present", F.lit(True))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    blank = F.length(F.rtrim(text, F.lit(SPACES))) == 0
    fault = F.when(blank, BLANK).when(~_last_letter(text).isin(".", "!", "?"), CUT_SHORT).otherwise(0)
    prepared = rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
        F.when(F.col("present"), text).alias("text"), F.col("present").alias("present"), fault.alias("fault"),
        F.unhex(F.md5(F.concat(role, F.lit("\0"), text))).alias("digest"))
    # The beginning of a text orders rows as the whole text does; equal beginnings share a partition.
    ordered = prepared.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(
        "conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "turn", "role", "text", "present", "fault", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        nothing = object()
        conv, first, cut, size = nothing, True, False, 0
        held: list[tuple] = []
        ready: list[dict] = []

        def close(whole: bool) -> None:
            """Make a piece of the rows that are held."""
            nonlocal number, size
            turns = {r[0] for r in held if r[0] is not None}
            faults = [r[3] for r in held]
            if whole:
                seen: set[bytes] = set()
                for k, (_, _, _, fault, digest) in enumerate(held):
                    if fault != BLANK and digest in seen:
                        faults[k] = DUPLICATE
                    seen.add(digest)
            ready.append({
                "conv_id": conv, "piece": number, "closed": whole, "first_turn": min(turns, default=None),
                "last_turn": max(turns, default=None), "n_turns": len(turns), "roles": [r[1] for r in held],
                "texts": [r[2] for r in held], "faults": faults,
                "digests": None if whole else [r[4] for r in held]})
            number += 1
            size = 0
            held.clear()

        def written() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(ready, schema=layout)
            ready.clear()
            return batch

        layout = None
        waiting = 0
        for batch in batches:
            if layout is None:
                layout = _piece_layout(batch.schema.field("conv_id").type)
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
            for conv_id, turn, role, text, present, fault, digest in zip(*columns):
                if conv is nothing or conv_id != conv:
                    if conv is not nothing:
                        # The first conversation of a partition may have begun before it.
                        close(not first and not cut)
                        first = False
                    conv, cut = conv_id, False
                if present:
                    if held and (len(held) >= piece_rows or size >= piece_bytes):
                        close(False)
                        cut = True
                    held.append((turn, role, text, fault, digest))
                    size += len(text) + 16
                    waiting += len(text) + 64
                if waiting > piece_bytes:
                    if ready:
                        yield written()
                    waiting = 0
        if conv is not nothing:
            close(False)
            yield written()

    return ordered.select(*names).mapInArrow(run, _PIECE.format(kind=kind))


def _piece_layout(kind: pa.DataType) -> pa.Schema:
    kinds = [kind, pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()),
             pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.binary())]
    return pa.schema(list(zip(_NAMES_OF_PIECE, kinds)))


def _with_duplicates(parts: DataFrame) -> DataFrame:
    """The faults of pieces of conversations that lie in several."""
    places = parts.select("conv_id", "piece", F.posexplode("digests").alias("place", "digest"))
    firsts = places.groupBy("conv_id", "digest").agg(F.min(F.struct("piece", "place")).alias("first"))
    # A piece has a bounded number of rows, whatever its conversation has.
    own = firsts.groupBy(F.col("first.piece").alias("piece")).agg(F.collect_list("first.place").alias("firsts"))
    marked = F.transform("faults", lambda fault, i: F.struct(fault.alias("fault"), i.alias("i")))
    faults = F.transform(marked, lambda x: F.when(
        (x["fault"] != BLANK) & ~F.array_contains("flags", x["i"]), DUPLICATE).otherwise(x["fault"]))
    return parts.join(own, "piece", "left").withColumn(
        "flags", F.coalesce("firsts", F.array().cast("array<int>"))).withColumn("faults", faults).drop(
        "firsts", "flags", "digests")


_SUM = ("piece bigint, costs array<int>, ranks array<int>, first_role string, last_role string")
_CHOICE = "piece bigint, entry int, exit int, tail string, illegal_before int, shared_turn int"


def _summed(parts: DataFrame) -> DataFrame:
    """For each piece the costs between all states, and the order of edits that begin in the same state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for piece, roles, faults in zip(*(c.to_pylist() for c in batch.columns)):
                costs, ranks = [0 if a == b else -1 for a in STATES for b in STATES], [0] * 16
                if roles:
                    costs = [-1] * 16
                    for at, edits in _ranked(_coded(roles, faults)).items():
                        costs[at], ranks[at] = edits
                rows.append({"piece": piece, "costs": costs, "ranks": ranks,
                             "first_role": roles[0][:1] if roles else None,
                             "last_role": roles[-1][:1] if roles else None})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("piece", pa.int64()), ("costs", pa.list_(pa.int32())), ("ranks", pa.list_(pa.int32())),
                ("first_role", pa.string()), ("last_role", pa.string())]))

    return parts.select("piece", "roles", "faults").mapInArrow(run, _SUM)


def _ranked(codes: str) -> dict[int, tuple[int, int]]:
    """Cost and rank by ``4 * entry + exit``."""
    found = {}
    table = piece_table(codes)
    for entry in STATES:
        own = sorted((edits, end) for (start, end), (_, edits) in table.items() if start == entry)
        for rank, (_, end) in enumerate(own):
            found[4 * entry + end] = (table[entry, end][0], rank)
    return found


def choose_path(sums: list[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """``(entry, exit)`` of consecutive pieces on the cheapest path, the least in order among equals."""
    best = [(INSERT * len(_TAIL[state]), 0) for state in STATES]
    exits = []
    for costs, ranks in reversed(sums):
        chosen = [min(((costs[4 * entry + end] + best[end][0], ranks[4 * entry + end], end) for end in STATES
                       if costs[4 * entry + end] >= 0), default=(_NEVER, 0, START)) for entry in STATES]
        best = [(cost, 0) for cost, _, _ in chosen]
        exits.append([end for _, _, end in chosen])
    path, state = [], START
    for ends in reversed(exits):
        path.append((state, ends[state]))
        state = ends[state]
    return path


def _choices(parts: DataFrame) -> DataFrame:
    """The path through the pieces of every conversation that lies in several."""
    sums = parts.select("conv_id", "piece", "first_turn", "last_turn").join(_summed(parts), "piece")

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("piece").to_pylist()
        path = choose_path([(r["costs"], r["ranks"]) for r in rows])
        found, role, turn = [], None, None
        for k, (row, (entry, end)) in enumerate(zip(rows, path)):
            both = role is not None and row["first_role"] is not None
            found.append({
                "piece": row["piece"], "entry": entry, "exit": end, "tail": _TAIL[end] if k + 1 == len(rows) else "",
                "illegal_before": _illegal([role, row["first_role"]]) if both else 0,
                "shared_turn": int(turn is not None and row["first_turn"] == turn)})
            role = row["last_role"] if row["last_role"] is not None else role
            turn = row["last_turn"] if row["last_turn"] is not None else turn
        return pa.Table.from_pylist(found, schema=pa.schema([
            ("piece", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("tail", pa.string()),
            ("illegal_before", pa.int32()), ("shared_turn", pa.int32())]))

    return sums.groupBy("conv_id").applyInArrow(run, _CHOICE)


_REPAIRED = ("conv_id {kind}, piece bigint, closed boolean, first_turn bigint, last_turn bigint, n_turns bigint, "
             "blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
             "lines array<string>")


def _edited(parts: DataFrame) -> DataFrame:
    """Pieces with their counts, edits and the lines that remain."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "piece", "closed", "first_turn", "last_turn", "n_turns", "roles", "texts", "faults", "entry",
             "exit", "tail", "illegal_before", "shared_turn"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
            kept = {n: columns[n].to_pylist() for n in names[6:]}
            made: dict[str, list] = {n: [] for n in (
                "blank", "duplicate", "truncated", "illegal", "cost", "audit", "lines", "n_turns")}
            for k, n_turns in enumerate(columns["n_turns"].to_pylist()):
                roles, faults, entry = kept["roles"][k], kept["faults"][k], kept["entry"][k]
                codes = _coded(roles, faults)
                illegal = _illegal([r[:1] for r in roles])
                if entry is None:
                    cost, edits = whole_repair(codes)
                    entry = START
                else:
                    tail = kept["tail"][k]
                    cost, edits = piece_table(codes)[entry, kept["exit"][k]] if codes else (0, "")
                    cost, edits = cost + INSERT * len(tail), edits + tail
                    illegal += kept["illegal_before"][k]
                    n_turns -= kept["shared_turn"][k]
                for name, value in (
                        ("blank", faults.count(BLANK)), ("duplicate", faults.count(DUPLICATE)),
                        ("truncated", faults.count(CUT_SHORT)), ("illegal", illegal), ("cost", cost), ("audit", edits),
                        ("lines", repaired_lines(roles, kept["texts"][k], edits, entry)), ("n_turns", n_turns)):
                    made[name].append(value)
            counts = [pa.array(made[n], pa.int64()) for n in (
                "n_turns", "blank", "duplicate", "truncated", "illegal", "cost")]
            yield pa.RecordBatch.from_arrays(
                [columns[n] for n in names[:5]] + counts + [
                    pa.array(made["audit"], pa.string()), pa.array(made["lines"], pa.list_(pa.string()))],
                names=names[:5] + ["n_turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "lines"])

    return parts.select(*names).mapInArrow(run, _REPAIRED.format(kind=kind))


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Repaired pieces of conversations, to be read in the order of ``piece``.

    ``lines`` are the resulting rows as ``role:text`` and ``audit`` the edits that lead to them; counts and costs
    add up over the pieces of a conversation.
    """
    stored = materialize(pieces(rows, piece_rows, piece_bytes), "conversation-pieces")
    several = materialize(_with_duplicates(stored.filter("NOT closed")), "conversations-in-pieces")
    choices = materialize(_choices(several), "conversation-paths")
    unset = [F.lit(None).cast(kind).alias(name) for name, kind in (
        field.rsplit(" ", 1) for field in _CHOICE.split(", ")[1:])]
    whole = stored.filter("closed").select("*", *unset).drop("digests")
    found = several.join(broadcast_if_small(choices), "piece")
    return _edited(whole.unionByName(found))


def summaries(repaired: DataFrame) -> DataFrame:
    """One row per conversation from the result of ``repair``: gaps, counts, cost, audit and the digest of its lines.

    The digest runs over all lines in order, so the pieces of a conversation stream through one task; only its
    edits are held, one letter a row.
    """
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0))
    whole = repaired.filter("closed").select(
        "conv_id", gaps.alias("gaps"), *counts, "audit",
        F.sha2(F.array_join("lines", "\n"), 256).alias("repaired_sha256"))
    parts = repaired.filter("NOT closed").repartition("conv_id").sortWithinPartitions("conv_id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        conv, total, layout = nothing, {}, None

        def result() -> pa.RecordBatch:
            row = {n: total[n] for n in counts} | {
                "conv_id": conv, "audit": "".join(total["audit"]), "repaired_sha256": total["digest"].hexdigest(),
                "gaps": total["last"] - total["first"] + 1 - total["turns"] if total["turns"] else 0}
            return pa.RecordBatch.from_pylist([row], schema=layout)

        for batch in batches:
            if layout is None:
                layout = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("gaps", pa.int64()),
                                    *((n, pa.int64()) for n in counts), ("audit", pa.string()),
                                    ("repaired_sha256", pa.string())])
            for row in batch.to_pylist():
                if conv is nothing or row["conv_id"] != conv:
                    if conv is not nothing:
                        yield result()
                    conv = row["conv_id"]
                    total = dict.fromkeys(counts, 0) | {
                        "audit": [], "digest": hashlib.sha256(), "begun": False, "first": None, "last": None, "turns": 0}
                for n in counts:
                    total[n] += row[n]
                total["audit"].append(row["audit"])
                if row["first_turn"] is not None:
                    total["first"] = row["first_turn"] if total["first"] is None else total["first"]
                    total["last"] = row["last_turn"]
                total["turns"] += row["n_turns"]
                if row["lines"]:
                    total["digest"].update((("\n" if total["begun"] else "") + "\n".join(row["lines"])).encode())
                    total["begun"] = True
        if conv is not nothing:
            yield result()

    return whole.unionByName(parts.mapInArrow(run, whole.schema))
