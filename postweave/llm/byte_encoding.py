"""Byte-level BPE encoding and decoding by the ranks of a vocabulary, as a tree reduction.

The ids of a string form a monoid: ``TreeEncoder.join`` takes the ids of two neighbouring strings and
returns those of both together, so a string is halved until its pieces are short, those are merged
directly, and the results are joined up the tree.

To join, a window of ids on both sides of the boundary is encoded anew. Ids outside the
window are final once the two ids on either side of each of its ends stay apart when these two alone are encoded. This is a
proof and no heuristic: merges go by rank and then from left to right, so between the first and the last id of
a sequence the merges are those that each pair of neighbours would make alone, up to the
first merge across a boundary, which would then occur in the pair as well. A sequence in which all neighbours stay apart is
therefore the encoding of its bytes. Where an end is not settled, the window doubles on that side.

A text is first split by a pattern and each match is encoded on its own; a match that is itself in the
vocabulary has that one id. ``decode`` concatenates the bytes of neighbouring ids up a tree.

Matches repeat a lot, so ``parts`` cuts texts where the pattern always ends a match (before white
space, and between letters, digits and marks) and encodes distinct parts only. What the ids spell is compared with
the text, and a text that differs is encoded again without looking parts up.

Defined cases: a null text counts as empty and has no ids. A very long text is handled in slices of
bounded size that end at a cut, and a single match of any length by the tree. Repeated rows give repeated
result rows. Other columns pass through; columns named like results are replaced. An empty table
gives an empty result. The vocabulary's path is a parameter that every executor must be able to read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postweave.llm.batches import text_chunks
from postweave.llm.parts import PartEncoder, Spelling, binary_array, different_texts, replaced

# Bytes that are merged directly.
LEAF_BYTES = 32
# Ids whose bytes are put together at once when decoding.
LEAF_IDS = 256
# Remembered pairs of ids.
REMEMBERED_PAIRS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks: one base64 token and one number a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class TreeEncoder:
    """Ids of one match, by halving and joining."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF_BYTES):
        self.ranks, self.leaf = ranks, max(1, leaf)
        self.tokens: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        self.apart: dict[tuple[int, int], bool] = {}

    def merge(self, text: bytes) -> list[int]:
        """Merge neighbours of the lowest rank first, the leftmost among equals."""
        ranks, size = self.ranks, len(text)
        ends = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        agenda = [(ranks[text[i:i + 2]], i, i + 2) for i in range(size - 1) if text[i:i + 2] in ranks]
        heapq.heapify(agenda)
        while agenda:
            _, left, end = heapq.heappop(agenda)
            right = ends[left]
            # Entries of symbols that were merged since then are stale.
            if right < 0 or right >= size or ends[right] != end:
                continue
            ends[left], ends[right] = end, -1
            if end < size:
                before[end] = left
                rank = ranks.get(text[left:ends[end]])
                if rank is not None:
                    heapq.heappush(agenda, (rank, left, ends[end]))
            if left:
                rank = ranks.get(text[before[left]:end])
                if rank is not None:
                    heapq.heappush(agenda, (rank, before[left], end))
        ids, at = [], 0
        while at < size:
            ids.append(ranks[text[at:ends[at]]])
            at = ends[at]
        return ids

    def stay_apart(self, left: int, right: int) -> bool:
        """True if two ids are the encoding of their own bytes."""
        found = self.apart.get((left, right))
        if found is None:
            if len(self.apart) >= REMEMBERED_PAIRS:
                self.apart.clear()
            found = self.apart[left, right] = self.merge(
                self.tokens[left] + self.tokens[right]) == [left, right]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbouring strings together."""
        if not left or not right:
            return left + right
        if self.stay_apart(left[-1], right[0]):
            return left + right
        tokens, i, j = self.tokens, 1, 1
        while True:
            middle = self.merge(b"".join([tokens[x] for x in left[-i:]] + [tokens[x] for x in right[:j]]))
            settled_left = i >= len(left) or self.stay_apart(left[-i - 1], middle[0])
            settled_right = j >= len(right) or self.stay_apart(middle[-1], right[j])
            if settled_left and settled_right:
                return left[:len(left) - min(i, len(left))] + middle + right[j:]
            if not settled_left:
                i *= 2
            if not settled_right:
                j *= 2

    def reduce(self, text: bytes) -> list[int]:
        """Ids of a string: both halves, joined."""
        if len(text) <= self.leaf:
            return self.merge(text)
        half = len(text) // 2
        return self.join(self.reduce(text[:half]), self.reduce(text[half:]))

    def encode(self, match: bytes) -> list[int]:
        whole = self.ranks.get(match)
        return [whole] if whole is not None else self.reduce(match)


def concatenated(parts: list[bytes]) -> bytes:
    """All parts, put together pair by pair up a tree."""
    while len(parts) > 1:
        parts = [b"".join(parts[i:i + 2]) for i in range(0, len(parts), 2)]
    return parts[0] if parts else b""


def _kind(byte: int) -> str:
    """Letter, digit, space or mark; bytes of other characters have no kind."""
    char = chr(byte)
    if byte >= 0x80:
        return ""
    return ("space" if char in " \t\n\r\x0b\x0c" else "letter" if char.isalpha()
            else "digit" if char.isdigit() else "mark")


def _cut_table() -> np.ndarray:
    """Where the pattern always ends a match, by the bytes on both sides.

    No match goes on from anything else into white space, or from one kind of character into another; but for
    what follows white space, which may lead a match, and letters after an apostrophe.
    """
    table = np.zeros((256, 256), bool)
    kinds = [_kind(b) for b in range(256)]
    for a in range(256):
        for b in range(256):
            if kinds[b] == "space":
                table[a, b] = kinds[a] != "space"
            elif kinds[a] and kinds[b] and kinds[a] != "space":
                table[a, b] = kinds[a] != kinds[b] and not (chr(a) == "'" and kinds[b] == "letter")
    return table


# White space beyond ASCII.
WIDE_SPACES = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_WIDE_SPACES = [chr(c).encode() for c in WIDE_SPACES]
_WIDE_LEADS = np.isin(np.arange(256), [c[0] for c in _WIDE_SPACES])


def _after_wide_space(data: np.ndarray) -> np.ndarray:
    """Places after white space beyond ASCII."""
    leads = np.flatnonzero(_WIDE_LEADS[data])
    after = []
    for space in _WIDE_SPACES:
        at = leads[leads + len(space) <= len(data)]
        for i, byte in enumerate(space):
            at = at[data[at + i] == byte]
        after.append(at + len(space))
    return np.concatenate(after)


class ByteCodec:
    """Encoder and decoder for one vocabulary and one splitting pattern."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF_BYTES):
        import regex

        ranks = read_ranks(path)
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("only vocabularies with all bytes are supported")
        self.tree = TreeEncoder(ranks, leaf)
        self.split = regex.compile(pattern).findall
        by_rank = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_rank[rank] = token
        self.spelling = Spelling(by_rank)
        self.parts = PartEncoder(_cut_table(), self._encode_parts, _after_wide_space)

    def _encode_parts(self, parts: list[bytes]) -> tuple[list[list[int]], list[bool]]:
        encode, split = self.tree.encode, self.split
        ids = [[i for match in split(part.decode()) for i in encode(match.encode())] for part in parts]
        return ids, [True] * len(parts)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts ``data[offsets[i]:offsets[i + 1]]``, and the offsets of each text's ids."""
        ids, at, _ = self.parts.encode(data, offsets)
        spelled, sizes = self.spelling.spell(ids)
        spelled_at = np.concatenate([[0], np.cumsum(sizes)])[at]
        new = {i: self.parts.encode_plainly(data[offsets[i]:offsets[i + 1]].tobytes())
               for i in different_texts(data, offsets, spelled, spelled_at)}
        return replaced(ids, at, new) if new else (ids, at)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of some ids."""
        spelled = list(map(self.spelling.spelled.__getitem__, ids.tolist()))
        return concatenated([b"".join(spelled[i:i + LEAF_IDS]) for i in range(0, len(spelled), LEAF_IDS)])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteCodec:
    """The codec of a vocabulary, made once by every Python worker."""
    return ByteCodec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``ids``: little-endian unsigned 32-bit numbers."""
    docs = docs.drop("ids")
    schema = docs.select("*", F.lit(b"").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(batch.schema.get_field_index(text))):
                ids, at = codec(path, pattern).encode(data, offsets)
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, binary_array(ids.astype("<u4", copy=False), at)],
                    names=[*part.schema.names, "ids"])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the bytes of the column ``ids``; null ids give null."""
    encoded = encoded.drop("decoded")
    schema = encoded.select("*", F.lit(None).cast("binary").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = codec(path, pattern)
            found = [None if x is None else by.decode(np.frombuffer(x, "<u4"))
                     for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass: replaces the text by ``ids`` and ``decoded``."""
    docs = docs.drop("ids", "decoded")
    names = [c for c in docs.columns if c != text]
    schema = docs.select(*names, F.lit(b"").alias("ids"), F.lit(b"").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = codec(path, pattern)
            for first, end, data, offsets in text_chunks(batch.column(batch.schema.get_field_index(text))):
                ids, at = by.encode(data, offsets)
                part = batch.slice(first, end - first)
                decoded = [by.decode(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(n)) for n in names),
                     binary_array(ids.astype("<u4", copy=False), at), pa.array(decoded, pa.binary())],
                    names=[*names, "ids", "decoded"])

    return docs.mapInArrow(run, schema)
