"""Encoding and decoding with merge-type SentencePiece vocabularies.

``Agenda`` merges adjacent symbols in the order of their scores: a heap holds the pairs that form
a piece, best score first and leftmost among equals; merging a pair puts its new neighbours on
the heap. What is no piece in the end is spelled in bytes.

``PieceCodec`` cuts a text where no piece can reach across, because none holds the two characters
side by side: before blanks, and between words and marks. ``parts`` finds the distinct parts, which repeat a
lot, and gathers their ids. Every part that is met for the first time is also encoded by the sentencepiece
library, a batch at a time, and ``agrees`` tells whether all parts of a text came out equal. What the ids spell
is compared with the text; one that differs is encoded again without looking parts up.

Defined cases: a null text counts as empty, which is the begin and end id only. A very long text is handled
in slices of bounded size that end at a cut. Repeated rows
give repeated result rows. The vocabulary's path is a parameter; it must be readable by every
executor. Other columns pass through unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from postweave.llm.batches import text_chunks
from postweave.llm.parts import (
    REMEMBERED_PARTS, PartEncoder, Spelling, binary_array, different_texts, replaced)

BLANK = "▁"


class Agenda:
    """Ids of a text by merging adjacent symbols in the order of their scores."""

    def __init__(self, processor):
        size = range(processor.vocab_size())
        self.unknown = processor.unk_id()
        self.bytes = [self.unknown] * 256
        self.pieces: dict[str, tuple[float, int]] = {}
        self.unused: set[int] = set()
        for i in size:
            piece = processor.id_to_piece(i)
            if processor.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (processor.is_control(i) or processor.is_unknown(i)):
                self.pieces[piece] = (processor.get_score(i), i)
                if processor.is_unused(i):
                    self.unused.add(i)
        self.spells = self.unknown not in self.bytes
        if self.unused:
            raise ValueError("vocabularies with unused pieces are not supported")

    def encode(self, text: str) -> list[int]:
        """Ids of a text whose blanks are written as ``BLANK``."""
        size, pieces = len(text), self.pieces
        symbols: list[str | None] = list(text)
        agenda = []
        for i in range(size - 1):
            pair = text[i:i + 2]
            if pair in pieces:
                agenda.append((-pieces[pair][0], i, i + 1, pair))
        if agenda:
            heapq.heapify(agenda)
            before, after = list(range(-1, size - 1)), list(range(1, size + 1))
            while agenda:
                _, left, right, pair = heapq.heappop(agenda)
                # A symbol that was merged since then has another text or none.
                if (symbols[left] is None or symbols[right] is None
                        or symbols[left] + symbols[right] != pair):
                    continue
                symbols[left], symbols[right] = pair, None
                next_one = after[left] = after[right]
                if next_one < size:
                    before[next_one] = left
                    wider = pair + symbols[next_one]
                    if wider in pieces:
                        heapq.heappush(agenda, (-pieces[wider][0], left, next_one, wider))
                last_one = before[left]
                if last_one >= 0:
                    wider = symbols[last_one] + pair
                    if wider in pieces:
                        heapq.heappush(agenda, (-pieces[wider][0], last_one, left, wider))
        ids = []
        for symbol in symbols:
            if symbol is not None:
                found = pieces.get(symbol)
                if found:
                    ids.append(found[1])
                elif self.spells:
                    ids.extend(self.bytes[b] for b in symbol.encode())
                else:
                    ids.append(self.unknown)
        return ids


def _cut_table(pieces) -> np.ndarray:
    """Where a text can be cut, by the bytes on both sides: where no piece holds both characters.

    Blanks count as the byte of a space. Neighbouring letters and digits are left together; a cut between them
    would be right, but make more parts.
    """
    spaced = [p.replace(BLANK, " ") for p in pieces]
    beside = {p[i:i + 2] for p in spaced for i in range(len(p) - 1)}
    # What stands beside characters beyond ASCII, on their left and on their right.
    left = {a for a, b in beside if b >= "\x80"}
    right = {b for a, b in beside if a >= "\x80"}
    table = np.zeros((256, 256), bool)
    for a in range(128):
        table[a, 0xC0:] = chr(a) not in left and not chr(a).isalnum()
        table[0x80:0xC0, a] = chr(a) not in right and not chr(a).isalnum()
        for b in range(128):
            table[a, b] = (chr(a) + chr(b) not in beside
                           and not (chr(a).isalnum() and chr(b).isalnum()))
    return table


class PieceCodec:
    """Encoder and decoder for one vocabulary; ids are little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, by_agenda: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.agenda = Agenda(self.library)
        self.by_agenda = by_agenda
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        if self.library.normalize(" a  b ") != f"{BLANK}{BLANK}a{BLANK}{BLANK}b{BLANK}":
            raise ValueError("only vocabularies that keep white space are supported")
        self.parts = PartEncoder(_cut_table(self.agenda.pieces), self._encode_parts, remembered=REMEMBERED_PARTS)
        # The library puts a blank in front of its input; the part after this mark is what counts.
        self.lead = len(self.library.encode("\n"))
        # What each id stands for; control ids stand for nothing.
        spelling = []
        for i in range(self.library.vocab_size()):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                spelling.append(bytes([int(piece[1:-1], 16)]))
            elif self.library.is_control(i):
                spelling.append(b"")
            elif self.library.is_unknown(i):
                spelling.append(" ⁇ ".encode())
            else:
                spelling.append(piece.replace(BLANK, " ").encode())
        self.spelling = Spelling(spelling)

    @property
    def known(self):
        return self.parts.known

    @property
    def older(self):
        return self.parts.older

    def _encode_parts(self, parts: list[bytes]) -> tuple[list[list[int]], list[bool]]:
        """Ids of parts that are met for the first time, by agenda and by the library."""
        texts = [part.decode() for part in parts]
        expected = [ids[self.lead:] for ids in self.library.encode(["\n" + t for t in texts], num_threads=1)]
        if not self.by_agenda:
            return expected, [True] * len(parts)
        found = [self.agenda.encode(t.replace(" ", BLANK)) for t in texts]
        return found, [a == b for a, b in zip(found, expected)]

    def encode_arrays(self, column: pa.Array) -> Iterator[tuple]:
        """Slices of a column of texts, as ``(first row, end row, ids, offsets, agrees, spelled, offsets)``.

        Ids have the begin and end id; ``agrees`` is whether they are the library's. ``spelled`` are the bytes that
        the ids stand for, without the blank in front of a text.
        """
        column = pc.replace_substring(column, BLANK, " ")
        for first, end, data, offsets in text_chunks(column):
            # A blank goes in front of every text that is not empty.
            filled = np.diff(offsets) > 0
            data = np.insert(data, offsets[:-1][filled], 32)
            offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
            ids, at, agrees = self.parts.encode(data, offsets)
            spelled, sizes = self.spelling.spell(ids)
            spelled_at = np.concatenate([[0], np.cumsum(sizes)])[at]
            new = {i: self.parts.encode_plainly(data[offsets[i]:offsets[i + 1]].tobytes())
                   for i in different_texts(data, offsets, spelled, spelled_at)}
            if new:
                ids, at = replaced(ids, at, new)
                spelled, sizes = self.spelling.spell(ids)
                spelled_at = np.concatenate([[0], np.cumsum(sizes)])[at]
            # Room for the begin and end ids.
            texts = np.arange(len(at))
            whole = np.empty(len(ids) + 2 * (len(at) - 1), "<u4")
            inner = np.ones(len(whole), bool)
            at = at + 2 * texts
            inner[at[:-1]] = inner[at[1:] - 1] = False
            whole[inner] = ids
            whole[at[:-1]], whole[at[1:] - 1] = self.begin, self.end
            leading = spelled_at[:-1][filled]
            leading = leading[spelled[leading] == 32]
            spelled = np.delete(spelled, leading)
            yield first, end, whole, at, agrees, spelled, spelled_at - np.searchsorted(leading, spelled_at)

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text, and whether they are the library's."""
        found, right = [], []
        for _, _, ids, at, agrees, _, _ in self.encode_arrays(pa.array(texts, pa.large_string())):
            found += [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            right += agrees.tolist()
        return found, right

    def decode(self, ids: bytes) -> str:
        """The text of some ids; a blank in front of it is dropped."""
        spelled = self.spelling.spell(np.frombuffer(ids, "<u4"))[0].tobytes()
        return (spelled[1:] if spelled.startswith(b" ") else spelled).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, by_agenda: bool = True) -> PieceCodec:
    """The codec of a vocabulary, made once by every Python worker."""
    return PieceCodec(path, by_agenda)


def encode(docs: DataFrame, path: str, text: str = "text", by_agenda: bool = True) -> DataFrame:
    """Add ``ids`` (little-endian unsigned 32-bit numbers with begin and end) and ``agrees``.

    Columns of these names are replaced.
    """
    docs = docs.drop("ids", "agrees")
    schema = docs.select("*", F.lit(b"").alias("ids"), F.lit(True).alias("agrees")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for first, end, ids, at, agrees, _, _ in codec(path, by_agenda).encode_arrays(column):
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(first, end - first).columns, binary_array(ids, at), pa.array(agrees)],
                    names=[*batch.schema.names, "ids", "agrees"])

    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass: replaces the text by ``ids``, ``agrees`` and ``decoded``."""
    docs = docs.drop("ids", "agrees", "decoded")
    names = [c for c in docs.columns if c != text]
    schema = docs.select(*names, F.lit(b"").alias("ids"), F.lit(True).alias("agrees"),
                         F.lit("").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for first, end, ids, at, agrees, spelled, spelled_at in codec(path).encode_arrays(column):
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(n)) for n in names), binary_array(ids, at),
                     pa.array(agrees), decoded_array(spelled, spelled_at)],
                    names=[*names, "ids", "agrees", "decoded"])

    return docs.mapInArrow(run, schema)


def decoded_array(spelled: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A column of texts; bytes that are no UTF-8 are replaced as the library does."""
    try:
        pa.py_buffer(np.ascontiguousarray(spelled)).to_pybytes().decode()
    except UnicodeDecodeError:
        return pa.array([spelled[a:b].tobytes().decode("utf-8", "replace")
                         for a, b in zip(offsets[:-1], offsets[1:])], pa.string())
    return binary_array(spelled, offsets, pa.string())


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the text of the column ``ids``; null ids give a null text."""
    encoded = encoded.drop("decoded")
    schema = encoded.select("*", F.lit(None).cast("string").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = [None if x.as_py() is None else codec(path).decode(x.as_py()) for x in column]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())],
                names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
