"""Packing of encoded documents into rows of equal length.

1. Documents are encoded and cut into segments of at most a row's length, without losing an id.
   Segments are stored once, with a number of their own.
2. Segments are dealt by the hash of that number into groups of about ``GROUP_TOKENS`` ids, so a group
   is bounded whatever documents or sources there are, and no document is ever held whole.
3. Within a group, segments go from the longest to the shortest into the row with the least
   room that still fits (best fit decreasing). A segment tree over all possible amounts of room finds it in
   logarithmic time.
4. A row is an array of ids, padded to full length, the cumulative lengths of its segments, and
   positions that start from 0 in every segment.

Defined cases: a null or empty text is its begin and end ids. Rows without an id are packed with
a null id. Repeated rows are packed repeatedly. Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postweave.llm.parts import binary_array
from postweave.llm.piece_encoding import codec
from postweave.storage import materialize

# Ids of a row.
ROW_TOKENS = 2048
# Ids packed by one call: larger groups fill rows better, smaller ones need less memory.
GROUP_TOKENS = 2_000_000
PADDING = 0

_SEGMENTS = "doc_id bigint, part int, n_tokens int, ids binary"
_PACKED = ("pack_group bigint, pack_row int, n_tokens int, doc_ids array<bigint>, parts array<int>, "
           "cu_seqlens array<int>, input_ids binary, position_ids binary")


class RoomTree:
    """Which amounts of room are on offer: a segment tree over 0 .. ``most``."""

    def __init__(self, most: int):
        self.leaves = 1 << max(1, most).bit_length()
        self.offers = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = self.leaves + room
        while at:
            self.offers[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Room and row of the tightest fit, which is no longer on offer; the first row among equals."""
        at = self.leaves + need
        if not self.offers[at]:
            # Climb until a right neighbour has an offer, then go down to its leftmost leaf.
            while at > 1 and (at & 1 or not self.offers[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.offers[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            self.offers[at] -= 1
            at >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of positions in ``sizes``, which are all between 1 and ``capacity``.

    Longer segments go first, equal ones in the given order.
    """
    tree, rows = RoomTree(capacity), []
    for i in np.argsort(-np.asarray(sizes, np.int64), kind="stable").tolist():
        size = int(sizes[i])
        found = tree.take(size)
        if found is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(i)
        if room > size:
            tree.add(room - size, row)
    return rows


def segments(docs: DataFrame, path: str, row_tokens: int = ROW_TOKENS) -> DataFrame:
    """``(doc_id, part, n_tokens, ids)``: the encoded documents in parts of bounded length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, ids, at, _, _, _ in codec(path, False).encode_arrays(batch.column(1)):
                # Segments of each text, in order, and where they begin and end.
                counts = -(-np.diff(at) // row_tokens)
                rows = np.repeat(np.arange(end - first), counts)
                part = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
                starts = at[rows] + part * row_tokens
                sizes = np.minimum(at[rows + 1] - starts, row_tokens)
                kind = "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first).take(pa.array(rows)),
                     pa.array(part.astype(np.int32)), pa.array(sizes.astype(np.int32)),
                     binary_array(ids.astype(kind), np.append(starts, at[-1]))],
                    names=["doc_id", "part", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _SEGMENTS)


def ids_of(raw: bytes, count: int) -> np.ndarray:
    """Ids from bytes of 2 or 4 each."""
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * count else "<u4")


def pack(docs: DataFrame, path: str, row_tokens: int = ROW_TOKENS,
         group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Rows of ids, in 4 bytes each, with segment lengths and positions.

    ``input_ids`` and ``position_ids`` hold ``row_tokens`` little-endian numbers; beyond ``n_tokens`` they
    are padding.
    """
    stored = materialize(segments(docs, path, row_tokens).withColumn(
        "segment", F.monotonically_increasing_id()), "segments")
    total = stored.agg(F.sum("n_tokens")).first()[0] or 0
    groups = max(1, math.ceil(total / group_tokens))
    dealt = stored.withColumn("pack_group", F.pmod(F.xxhash64("segment"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        # Segments in their stored order, whatever order they arrive in.
        table = table.sort_by("segment")
        sizes = table["n_tokens"].to_numpy()
        raw, owner = table["ids"].to_pylist(), table["doc_id"].combine_chunks()
        part = table["part"].combine_chunks()
        packed = best_fit_decreasing(sizes, row_tokens)
        order = pa.array([i for row in packed for i in row], pa.int64())
        counts = np.array([len(row) for row in packed])
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        ends, ids, positions, used = [], [], [], []
        for row in packed:
            at = np.concatenate([[0], np.cumsum(sizes[row])]).astype(np.int32)
            values = np.full(row_tokens, PADDING, "<u4")
            place = np.zeros(row_tokens, "<u4")
            for i, a, b in zip(row, at[:-1], at[1:]):
                values[a:b] = ids_of(raw[i], int(sizes[i]))
                place[a:b] = np.arange(b - a)
            ends.append(at)
            ids.append(values.tobytes())
            positions.append(place.tobytes())
            used.append(int(at[-1]))
        bounds = pa.array(np.concatenate([[0], np.cumsum(counts + 1)]).astype(np.int32))
        return pa.table({
            "pack_group": pa.array([table["pack_group"][0].as_py()] * len(packed), pa.int64()),
            "pack_row": pa.array(range(len(packed)), pa.int32()),
            "n_tokens": pa.array(used, pa.int32()),
            "doc_ids": pa.ListArray.from_arrays(offsets, owner.take(order)),
            "parts": pa.ListArray.from_arrays(offsets, part.take(order)),
            "cu_seqlens": pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(ends))),
            "input_ids": pa.array(ids, pa.binary()), "position_ids": pa.array(positions, pa.binary())})

    return dealt.groupBy("pack_group").applyInArrow(run, _PACKED)


def write_rows(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet: fixed-length binaries that load as matrices without a copy."""
    packed.write.parquet(path)


def matrix(column: pa.Array, row_tokens: int = ROW_TOKENS) -> np.ndarray:
    """Ids or positions of a batch of packed rows as a matrix."""
    return np.stack([np.frombuffer(x.as_buffer(), "<u4") for x in column]) if len(column) else (
        np.zeros((0, row_tokens), np.uint32))
