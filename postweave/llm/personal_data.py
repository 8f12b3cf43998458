"""Personal data found by patterns and by a linear-chain conditional random field.

``pattern_spans`` finds what patterns and checksums can tell for certain. ``Field`` labels the words of
every line by Viterbi decoding; its features are word shapes (kinds of characters with
repetitions put together, lengths and numbers of digits) of a word and its neighbours, so it also finds
what the patterns miss: secrets, phone numbers without a country, cards among other digits. Spans of the field that
overlap a pattern's are dropped, and, if asked for, those that cannot be of their kind.

The field is trained by the driver from a small table of lines with labelled spans, at most
``TRAINING_LINES`` of them, by maximum likelihood. ``labelled_lines`` holds a table that was labelled by hand;
``weak_labels`` makes one from documents with looser patterns, which shows the field how the corpus reads. Decoding runs in numpy over batches of lines
of similar length.

Defined cases: a null text has no spans. Offsets count code points, ends are exclusive. Lines end at a line
feed, words at ASCII white space. Repeated rows give repeated result rows; other columns pass through
``find_spans``. With nothing to train on, the field finds nothing. An empty table gives an empty result. The patterns read a
text of any length once; a very long line is decoded word by word, in time that grows with its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postweave.llm.batches import IS_SPACE, mixed, range_hashes, runs, text_chunks

# The kinds of the contract with their patterns, in order.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
# The same for texts of any length: all starts within one run of characters share what follows the run, so only
# the first one is tried, and what was read is not given back.
_PHONE_LIKE = re.compile(r"[+(]?[0-9][\x20().0-9-]*[0-9]")
_RUN = re.compile(r"[A-Za-z0-9._%+-]++(@?)")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")

# Kinds that only the field finds.
SECRET = "secret"
ORDER = {kind: i for i, kind in enumerate((*KINDS, SECRET))}
# What the field tells apart: one word, or the first and further words of a span.
LABELS = ("", "email", "ip", "secret", "card", "phone", "card+", "phone+")
_CONTINUES = {4: 6, 5: 7}

TRAINING_LINES = 1500
TRAINING_DOCUMENTS = 600
TRAINING_CHARACTERS = 2000
STEPS = 60
PENALTY = 1e-3
# The arrays of a chunk stay small; lines of a chunk are decoded side by side.
CHUNK_BYTES = 500_000


def _valid_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of ``EMAIL``: from each run that an at sign ends, or what an earlier match left of it."""
    done = 0
    for run in _RUN.finditer(text):
        first = max(run.start(), done)
        if run[1] and first < run.end() - 1:
            domain = _DOMAIN.match(text, run.end())
            if domain:
                done = domain.end()
                yield first, done


def pattern_spans(text: str | None, strict: bool = True) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by start and kind; without ``strict``, cards need no checksum."""
    found = []
    if not text:
        return found
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _valid_ip(m[0])]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _digits(m[0])
                if 14 <= len(digits) <= 19 and (not strict or _luhn(digits)):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text)
                      if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


# Kinds of characters: digits, lower and upper case, other letters, and each mark by itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[97:123], _SHAPE[65:91], _SHAPE[128:] = 48, 97, 65, 200
# For the set of kinds in a word: letters, digits, and marks in a few groups.
_GROUP = np.full(256, 5, np.uint64)
for _group, _members in enumerate((range(48, 58), range(97, 123), range(65, 91), range(128, 256), b".,;:!?")):
    _GROUP[list(_members)] = _group
_GROUP[list(b"@")], _GROUP[list(b"+")], _GROUP[list(b"\"'")] = 6, 7, 8


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Hashed features of words, one column per template.

    ``lines`` numbers the line of each word; neighbours in other lines do not count.
    """
    shape = _SHAPE[data]
    inside = ~IS_SPACE[data]
    keep = inside.copy()
    keep[1:] &= shape[1:] != shape[:-1]
    keep[starts] = True
    # Repetitions are put together; a word's shape is then a range of what is left.
    at = np.concatenate([[0], np.cumsum(keep)])
    short = range_hashes(shape[keep], at[starts], at[ends])
    digits = np.concatenate([[0], np.cumsum(shape == 48)])
    digits = (digits[ends] - digits[starts]).astype(np.uint64)
    length = (ends - starts).astype(np.uint64)
    size = np.minimum(length, 12) + (length > 20) + (length > 32)
    present = np.zeros(len(starts), np.uint64)
    bits = np.left_shift(np.uint64(1), _GROUP[data])
    if len(starts):
        bits[~inside] = 0
        present = np.bitwise_or.reduceat(bits, starts)
    count = np.minimum(digits, 20)
    detailed = mixed(short * np.uint64(3) + count * np.uint64(64) + size)
    groups = mixed((present << np.uint64(16)) + (count << np.uint64(8)) + size)
    same = np.zeros(len(starts) + 1, bool)
    same[1:-1] = lines[1:] == lines[:-1]
    before, after = np.zeros_like(short), np.zeros_like(short)
    before[1:], after[:-1] = short[:-1], short[1:]
    before[~same[:-1]] = after[~same[1:]] = 1
    columns = (short, detailed, groups, mixed(present + np.uint64(7)), before, after)
    return np.stack([mixed(c + np.uint64(k << 40)) for k, c in enumerate(columns)], axis=1)


@dataclass(frozen=True)
class Field:
    """A trained field: weights of features and of neighbouring labels."""

    features: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        total = np.zeros((len(features), len(LABELS)), np.float32)
        for column in features.T:
            at = np.minimum(np.searchsorted(self.features, column), len(self.features) - 1)
            known = np.flatnonzero(self.features[at] == column)
            total[known] += self.weights[at[known]]
        return total

    def label(self, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The most likely labels of the words; line ``i`` has words ``offsets[i]:offsets[i + 1]``."""
        if not len(self.features) or not len(features):
            return np.zeros(len(features), np.int8)
        scores = self.scores(features)
        order, sizes, active = _by_length(offsets)
        came = np.zeros((len(features), len(LABELS)), np.int8)
        best = scores[offsets[:-1][order]] + self.first
        last = np.zeros((len(order), len(LABELS)), np.float32)
        for t in range(len(active)):
            rows = offsets[:-1][order[:active[t]]] + t
            if t:
                paths = best[:active[t], :, None] + self.moves
                came[rows] = paths.argmax(axis=1)
                best = paths.max(axis=1) + scores[rows]
            last[:active[t]] = best
        found = np.zeros(len(features), np.int8)
        label = last.argmax(axis=1)
        for t in range(len(active) - 1, -1, -1):
            rows = offsets[:-1][order[:active[t]]] + t
            found[rows] = label[:active[t]]
            label[:active[t]] = came[rows, label[:active[t]]]
        return found


def _by_length(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines from the longest, their lengths, and how many are longer than each position."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    order = order[:np.count_nonzero(sizes)]
    sizes = sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    return order, sizes, len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), "right")


def train(lines: list[tuple[str, list[tuple[str, int, int]]]], steps: int = STEPS) -> Field:
    """A field from lines with the spans of their labels, by gradient ascent on the likelihood."""
    texts = pa.array([text for text, _ in lines], pa.string())
    parts, truth, sizes = [], [], []
    for start, end, data, offsets in text_chunks(texts, CHUNK_BYTES):
        starts, ends, words = runs(~IS_SPACE[data], offsets)
        parts.append(word_features(data, starts, ends, np.repeat(np.arange(end - start), np.diff(words))))
        sizes.append(np.diff(words))
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        for i in range(end - start):
            own = slice(words[i], words[i + 1])
            label = np.zeros(words[i + 1] - words[i], np.int8)
            first = points[starts[own]] - points[offsets[i]]
            last = points[ends[own]] - points[offsets[i]]
            for kind, a, b in lines[start + i][1]:
                hit = np.flatnonzero((first < b) & (last > a) & (label == 0))
                if kind in LABELS and len(hit):
                    label[hit] = LABELS.index(kind)
                    label[hit[1:]] = _CONTINUES.get(LABELS.index(kind), LABELS.index(kind))
            truth.append(label)
    if not parts or not any(t.any() for t in truth):
        return Field(np.zeros(0, np.uint64), np.zeros((0, len(LABELS)), np.float32),
                     np.zeros((len(LABELS),) * 2, np.float32), np.zeros(len(LABELS), np.float32))
    hashed = np.concatenate(parts)
    known, which = np.unique(hashed, return_inverse=True)
    which = which.reshape(hashed.shape)
    labels = np.concatenate(truth)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return _ascend(known, which, labels, offsets, steps)


def _ascend(known: np.ndarray, which: np.ndarray, labels: np.ndarray, offsets: np.ndarray,
            steps: int) -> Field:
    count = len(LABELS)
    order, sizes, active = _by_length(offsets)
    begin = offsets[:-1][order]
    weights = [np.zeros((len(known), count)), np.zeros((count, count)), np.zeros(count)]
    rate = [np.full(w.shape, 0.1) for w in weights]
    sign = [np.zeros(w.shape) for w in weights]
    # What the labels themselves show, minus what the weights expect, is the gradient.
    shown = [np.zeros((len(known), count)), np.zeros((count, count)), np.zeros(count)]
    for column in which.T:
        np.add.at(shown[0], (column, labels), 1.0)
    inner = np.ones(len(labels), bool)
    inner[begin] = False
    np.add.at(shown[1], (labels[:-1][inner[1:]], labels[1:][inner[1:]]), 1.0)
    np.add.at(shown[2], labels[begin], 1.0)
    for _ in range(steps):
        scores = sum(weights[0][column] for column in which.T)
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        moves, first = np.exp(weights[1]), np.exp(weights[2])
        forward, backward = np.zeros_like(scores), np.ones_like(scores)
        expected_moves = np.zeros((count, count))
        for t in range(len(active)):
            rows = begin[:active[t]] + t
            step = scores[rows] * (first if t == 0 else forward[rows - 1] @ moves)
            forward[rows] = step / step.sum(axis=1, keepdims=True)
        for t in range(len(active) - 2, -1, -1):
            rows = begin[:active[t + 1]] + t
            ahead = scores[rows + 1] * backward[rows + 1]
            joint = forward[rows][:, :, None] * moves * ahead[:, None, :]
            total = joint.sum(axis=(1, 2), keepdims=True)
            expected_moves += (joint / total).sum(axis=0)
            step = ahead @ moves.T
            backward[rows] = step / step.sum(axis=1, keepdims=True)
        share = forward * backward
        share /= share.sum(axis=1, keepdims=True)
        expected = np.zeros_like(weights[0])
        for column in which.T:
            for k in range(count):
                expected[:, k] += np.bincount(column, share[:, k], len(known))
        for k, wanted in enumerate((expected, expected_moves, share[begin].sum(axis=0))):
            slope = shown[k] - wanted - PENALTY * len(begin) * weights[k] / 10
            turned = sign[k] * np.sign(slope)
            rate[k] = np.clip(np.where(turned > 0, rate[k] * 1.2, np.where(turned < 0, rate[k] * 0.5, rate[k])),
                              1e-4, 1.0)
            weights[k] = weights[k] + np.sign(slope) * rate[k]
            sign[k] = np.sign(slope)
    return Field(known, *(w.astype(np.float32) for w in weights))


_HEX = re.compile(r"(?<![0-9A-Za-z])(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])")


def weak_labels(docs: DataFrame, documents: int = TRAINING_DOCUMENTS,
                lines: int = TRAINING_LINES) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A small labelled table: lines of the documents with digits that hash smallest.

    Lines with a span come first. Both numbers are bounds of the training table only, as is the length of its lines.
    """
    # Ids are ranked without their texts, which are then looked up for the few chosen ones.
    ids = docs.filter(F.col("text").rlike("[0-9]") & F.col("doc_id").isNotNull()).select(
        "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    parted = chosen.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).filter(
        "line <> ''").filter(
        F.length("line") <= TRAINING_CHARACTERS)
    marked = F.col("line").rlike(r"[0-9]{4}|[0-9]\.[0-9]|@")
    first = parted.orderBy(~marked, F.xxhash64("doc_id", "at"), "line").limit(lines)
    found = []
    for row in first.select("line").collect():
        spans = pattern_spans(row["line"], strict=False)
        spans += [(SECRET, m.start(), m.end()) for m in _HEX.finditer(row["line"])]
        found.append((row["line"], _apart(spans)))
    return found


def _apart(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans without those that overlap an earlier kind's."""
    kept: list[tuple[str, int, int]] = []
    for span in sorted(spans, key=lambda s: (s[0] in ("card", SECRET), s[1])):
        if all(span[2] <= a or b <= span[1] for _, a, b in kept):
            kept.append(span)
    return kept


def field_spans(column: pa.Array, field: Field, checked: bool = False) -> Iterator[list[tuple[str, int, int]]]:
    """For each text the field's spans, without marks at their ends; ``checked`` drops what cannot be of its kind."""
    for start, end, data, offsets in text_chunks(column, CHUNK_BYTES):
        starts, ends, words = runs(~IS_SPACE[data], offsets)
        # Texts end lines as well.
        breaks = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10)]))
        line = np.searchsorted(breaks, starts, "right")
        labels = field.label(word_features(data, starts, ends, line),
                             np.concatenate([[0], np.flatnonzero(np.diff(line)) + 1, [len(line)]])
                             if len(line) else np.zeros(1, np.int64))
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        hits = np.flatnonzero(labels)
        of = np.searchsorted(words, hits, "right") - 1
        found: list[list[tuple[str, int, int]]] = [[] for _ in range(end - start)]
        previous = None
        for word, text in zip(hits.tolist(), of.tolist()):
            label = int(labels[word])
            if label >= 6 and previous == (word - 1, label) and line[word] == line[word - 1]:
                last = found[text][-1]
                found[text][-1] = (last[0], last[1], int(ends[word]))
            else:
                found[text].append((LABELS[label].rstrip("+"), int(starts[word]), int(ends[word])))
            previous = (word, _CONTINUES.get(label, label))
        for i, spans in enumerate(found):
            yield [(kind, int(points[a] - points[offsets[i]]), int(points[b] - points[offsets[i]]))
                   for kind, a, b in (_trimmed(data, *s) for s in spans)
                   if a < b and (not checked or _possible(kind, data[a:b].tobytes().decode()))]


def _possible(kind: str, text: str) -> bool:
    """Whether what the field takes for a kind can be one: it sees shapes, not checksums."""
    digits = _digits(text)
    if kind == "card":
        return 14 <= len(digits) <= 19 and _luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and _PHONE_LIKE.fullmatch(text) is not None
    if kind == "ip":
        return len(digits) >= 4 and IP.fullmatch(text) is not None and _valid_ip(text)
    if kind == "email":
        return EMAIL.search(text) is not None
    return len(text) >= 16 and bool(digits) and len(digits) < len(text)


def _trimmed(data: np.ndarray, kind: str, a: int, b: int) -> tuple[str, int, int]:
    text = data[a:b].tobytes()
    # The bracket of an area code is part of the number.
    opening = b"\"'[{<,.;:=%&*#$" if kind == "phone" and b")" in text else b"\"'([{<,.;:=%&*#$"
    left = len(text) - len(text.lstrip(opening))
    right = len(text.rstrip(b"\"')]}>,.;:=!?%&*#$+-"))
    return kind, a + left, a + max(left, right)


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in sorted(spans, key=lambda s: (s[1], ORDER[s[0]])))


def find_spans(docs: DataFrame, field: Field, text: str = "text", checked: bool = False) -> DataFrame:
    """Add ``base_spans`` and ``spans`` as ``kind:start:end`` lists, and a count per base kind.

    With ``checked``, spans of the field that cannot be of their kind are dropped, like cards that fail their checksum.
    Columns of these names are replaced.
    """
    counts = [f"n_{kind}" for kind in KINDS]
    docs = docs.drop("base_spans", "spans", *counts)
    schema = docs.select("*", F.lit("").alias("base_spans"), F.lit("").alias("spans"),
                         *(F.lit(0).cast("bigint").alias(c) for c in counts)).schema
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            base, every, numbers = [], [], []
            for value, more in zip(column, field_spans(column, shared.value, checked)):
                own = pattern_spans(value.as_py())
                more = [s for s in more if all(s[2] <= a or b <= s[1] for _, a, b in own)]
                base.append(written(own))
                every.append(written([*own, *more]))
                numbers.append([sum(kind == s[0] for s in own) for kind in KINDS])
            columns = np.array(numbers, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(base, pa.string()), pa.array(every, pa.string()),
                 *(pa.array(columns[:, k].copy()) for k in range(len(KINDS)))],
                names=[*batch.schema.names, "base_spans", "spans", *counts])

    return docs.mapInArrow(run, schema)
