"""Ids of many texts at once.

Texts are cut where no id can reach across, which a table of neighbouring bytes tells. Most parts repeat, so
the distinct ones are found by their hashes and only those not met before are encoded; the ids
of all texts are then gathered from flat arrays. Work and memory are bounded per slice of
``CHUNK_BYTES``; a longer text is handled in slices that end at a cut.

Parts are told apart by 64-bit hashes, so callers compare what the ids spell with the text and encode a
text that differs part by part, without hashes (``encode_plainly``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from postweave.llm.batches import CHUNK_BYTES, range_hashes

# Distinct parts of texts that a Python worker remembers: so many recent ones, and as many from before.
REMEMBERED_PARTS = 500_000


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``flat[start:start + size]`` of all pairs, one after the other."""
    sizes = sizes.astype(np.int64, copy=False)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    if total <= 4 * CHUNK_BYTES or len(sizes) < 2:
        return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(total)]
    # A slice at a time, to bound the memory of the places.
    at = np.searchsorted(ends, np.arange(0, total, 2 * CHUNK_BYTES))
    cuts = [0, *dict.fromkeys(at[at > 0].tolist()), len(sizes)]
    return np.concatenate([gathered(flat, starts[a:b], sizes[a:b]) for a, b in zip(cuts, cuts[1:])])


class Remembered:
    """Ids of parts, found by the hashes of the parts."""

    def __init__(self):
        self.hashes = np.zeros(0, np.uint64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.right = np.zeros(0, bool)
        self.flat = np.zeros(0, np.uint32)

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes, -1 where they are not known."""
        if not len(self):
            return np.full(len(hashes), -1)
        places = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        return np.where(self.hashes[places] == hashes, places, -1)

    def add(self, hashes: np.ndarray, flat: np.ndarray, sizes: np.ndarray, right: np.ndarray) -> None:
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        order = np.argsort(hashes)
        places = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, places, hashes[order])
        self.starts = np.insert(self.starts, places, starts[order])
        self.sizes = np.insert(self.sizes, places, sizes[order])
        self.right = np.insert(self.right, places, right[order])
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32, copy=False)])


class PartEncoder:
    """Encodes texts part by part.

    ``can_cut`` says for every pair of neighbouring bytes (256 x 256) that a part may end between
    them. ``encode_parts`` gives the ids of some parts and whether each is right. ``no_cut`` may name places
    in the bytes before which no part begins, whatever the table says.
    """

    def __init__(self, can_cut: np.ndarray, encode_parts: Callable[[list[bytes]], tuple[list, list[bool]]],
                 no_cut: Callable[[np.ndarray], np.ndarray] | None = None,
                 remembered: int = REMEMBERED_PARTS):
        self.can_cut, self.encode_parts, self.no_cut = can_cut.ravel(), encode_parts, no_cut
        self.remembered = remembered
        self.known, self.older = Remembered(), Remembered()

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """True where a part begins; every text begins a part."""
        begins = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            pairs = data[:-1].astype(np.uint16) << 8 | data[1:]
            begins[1:-1] = self.can_cut[pairs]
            if self.no_cut is not None:
                begins[self.no_cut(data)] = False
        begins[offsets] = True
        return begins[:-1]

    def _slice(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of consecutive parts that fill ``data``, and for each part their number and rightness."""
        ends = np.append(starts[1:], len(data))
        encoded = pa.array(range_hashes(data, starts, ends)).dictionary_encode()
        hashes = encoded.dictionary.to_numpy()
        which = encoded.indices.to_numpy()
        if len(self.known) > self.remembered:
            # What is not met again until the next change is forgotten.
            self.known, self.older = Remembered(), self.known
        places = self.known.find(hashes)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            self._learn(data, starts, ends, hashes, which, missing)
            places = self.known.find(hashes)
        places = places[which]
        sizes = self.known.sizes[places]
        return gathered(self.known.flat, self.known.starts[places], sizes), sizes, self.known.right[places]

    def _learn(self, data, starts, ends, hashes, which, missing) -> None:
        """Take over or encode the parts whose hashes are not known."""
        old = self.older.find(hashes[missing])
        again, at = missing[old >= 0], old[old >= 0]
        if len(again):
            sizes = self.older.sizes[at]
            self.known.add(hashes[again], gathered(self.older.flat, self.older.starts[at], sizes), sizes,
                           self.older.right[at])
        new = missing[old < 0]
        if len(new):
            example = np.zeros(len(hashes), np.int64)
            example[which] = np.arange(len(which))
            parts = [data[a:b].tobytes() for a, b in zip(
                starts[example[new]].tolist(), ends[example[new]].tolist())]
            ids, right = self.encode_parts(parts)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.concatenate([np.asarray(x, np.uint32) for x in ids])
            self.known.add(hashes[new], flat, sizes, np.asarray(right, bool))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, where those of each text begin (and the last ones end), and rightness by text."""
        begins = self.cuts(data, offsets)
        starts = np.flatnonzero(begins)
        ids, sizes, right = [], [], []
        at = 0
        while at < len(starts):
            end = int(np.searchsorted(starts, starts[at] + CHUNK_BYTES, "right"))
            end = max(end, at + 1)
            first, last = int(starts[at]), int(starts[end]) if end < len(starts) else len(data)
            found = self._slice(data[first:last], starts[at:end] - first)
            for into, values in zip((ids, sizes, right), found):
                into.append(values)
            at = end
        if not ids:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64), np.ones(len(offsets) - 1, bool)
        before = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        wrong = np.concatenate([[0], np.cumsum(~np.concatenate(right))])
        parts = np.searchsorted(starts, offsets)
        return np.concatenate(ids), before[parts], wrong[parts[1:]] == wrong[parts[:-1]]

    def encode_plainly(self, text: bytes) -> np.ndarray:
        """Ids of one text without looking anything up."""
        data = np.frombuffer(text, np.uint8)
        starts = np.flatnonzero(self.cuts(data, np.array([0, len(data)]))).tolist()
        parts = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
        return np.concatenate([np.zeros(0, np.uint32), *(
            np.asarray(x, np.uint32) for x in self.encode_parts(parts)[0])]) if parts else np.zeros(0, np.uint32)


class Spelling:
    """The bytes that ids stand for."""

    def __init__(self, spelled: list[bytes]):
        self.spelled = spelled
        self.sizes = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of some ids, and the number of bytes of each."""
        sizes = self.sizes[ids]
        if len(ids) <= CHUNK_BYTES:
            return gathered(self.flat, self.starts[ids], sizes), sizes
        return np.concatenate([gathered(self.flat, self.starts[part], self.sizes[part]) for part in (
            ids[i:i + CHUNK_BYTES] for i in range(0, len(ids), CHUNK_BYTES))]), sizes


def different_texts(data: np.ndarray, offsets: np.ndarray, spelled: np.ndarray,
                    spelled_at: np.ndarray) -> Iterator[int]:
    """Numbers of texts that are not what was spelled for them."""
    if len(data) == len(spelled) and np.array_equal(offsets, spelled_at) and np.array_equal(data, spelled):
        return
    for i in range(len(offsets) - 1):
        own = data[offsets[i]:offsets[i + 1]]
        if not np.array_equal(own, spelled[spelled_at[i]:spelled_at[i + 1]]):
            yield i


def replaced(values: np.ndarray, offsets: np.ndarray, new: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``values`` with those of some texts replaced, and the new offsets."""
    parts = [new[i] if i in new else values[a:b] for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:]))]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def binary_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A binary column (or one of ``kind``) of ``values[offsets[i]:offsets[i + 1]]``, without a copy."""
    width = values.dtype.itemsize
    ends = (np.asarray(offsets, np.int64) * width)
    if ends[-1] >= 1 << 31:
        raise ValueError("a slice of texts has more than 2 GB of ids")
    return pa.Array.from_buffers(kind or pa.binary(), len(offsets) - 1, [
        None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
