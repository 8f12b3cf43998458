"""Stretches of a text that repeat with a period, and texts without the repetitions.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal), at least
``LEAST_LENGTH`` words and ``LEAST_EXPONENT`` periods long, that cannot be extended on either side. All texts of a
slice are searched at once, with a word between any two that equals no other.

* Periods below ``DIRECT_PERIODS`` are found by comparing each word with that ``q`` further on.
* Longer ones are searched in scales ``P <= q < 2 P``. Every gram of ``2 P`` words gets a hash, and the grams that
  are least in some window of ``P`` neighbours are the scale's minimizers. A gram holds at least one period, so within a
  run equal grams are a multiple of ``q`` apart; the run has at least ``2 q + 1`` grams and a window is no
  longer than ``q``, so the least gram of its first window is a minimizer again ``q`` further on, with no equal one between.
  Pairs of next equal minimizers at a distance of the scale are therefore enough to find every run, and there
  are at most as many as minimizers. Each is extended word by word until the period breaks, once per run.

The hash of a gram is made from those of its halves, so each scale costs one pass. Words are compared by 64-bit hashes.

Defined cases: a null or empty text has no words and no runs. Repeated rows give repeated result rows. Columns named like
results are replaced, others pass through; an empty table gives an empty result. A very long text is handled alone: memory
is a fixed multiple of it, and time grows as ``n log(n)^2``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postweave.llm.batches import IS_SPACE, mixed, runs, sliced_hashes, text_chunks
from postweave.llm.parts import binary_array, gathered

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
# Shorter periods are searched by direct comparison; a power of two.
DIRECT_PERIODS = 8

_MIX = np.uint64(0xD6E8FEB86659FD93)
_SEPARATOR = np.uint64(0xA5A5_5A5A_0F0F_F0F0)


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """The least (or greatest) of every ``width`` neighbours; ``width`` is a power of two."""
    step = 1
    while step < width:
        values = least(values[:-step], values[step:])
        step *= 2
    return values


def _minimizers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the grams that are least in some window; all of them where equal ones are."""
    least = _sliding(grams, window, np.minimum)
    padded = np.zeros(len(least) + 2 * (window - 1), np.uint64)
    padded[window - 1:window - 1 + len(least)] = least
    return np.flatnonzero(_sliding(padded, window, np.maximum) == grams)


def _matching(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ``at`` on, in the direction of ``step``, equal the one ``lag`` further on."""
    size, found = 64, 0
    while True:
        if step > 0:
            first, end = at + found, min(at + found + size, len(words) - lag)
        else:
            first, end = max(at - found - size + 1, 0), at - found + 1
        if end <= first:
            return found
        differs = words[first:end] != words[first + lag:end + lag]
        if step < 0:
            differs = differs[::-1]
        if differs.any():
            return found + int(differs.argmax())
        found += end - first
        size *= 4


def _seeds(words: np.ndarray, lengths: np.ndarray, direct: int, exponent: int) -> Iterator[tuple]:
    """``(places, lags)`` of pairs of next equal minimizers, scale by scale.

    ``lengths`` are those of the consecutive texts in ``words``, separators included.
    """
    grams, width, where = words, 1, np.arange(len(words))
    owners = np.repeat(np.arange(len(lengths)), lengths)
    period = direct
    while True:
        # Texts too short for this scale go.
        fits = lengths[owners[where]] > exponent * period
        if not fits.all():
            grams, where = grams[fits], where[fits]
        while width < 2 * period:
            if len(grams) <= width:
                return
            grams, where = mixed(grams[:-width] * _MIX + grams[width:]), where[:-width]
            width *= 2
        if len(grams) < period:
            return
        at = _minimizers(grams, period)
        order = np.argsort(grams[at], kind="stable")
        value, at = grams[at][order], at[order]
        lags = at[1:] - at[:-1]
        chosen = np.flatnonzero((value[1:] == value[:-1]) & (lags >= period) & (lags < 2 * period))
        if len(chosen):
            yield where[at[:-1][chosen]], lags[chosen]
        period *= 2


def _prime_factors(number: int) -> list[int]:
    factors, factor = [], 2
    while factor * factor <= number:
        if number % factor == 0:
            factors.append(factor)
            while number % factor == 0:
                number //= factor
        factor += 1
    return factors + [number] if number > 1 else factors


def _is_smallest(words: np.ndarray, start: int, period: int) -> bool:
    """True if no shorter period holds in a stretch of at least two periods from ``start``."""
    for factor in _prime_factors(period):
        shorter = period // factor
        if np.array_equal(words[start:start + period], words[start + shorter:start + shorter + period]):
            return False
    return True


def find_runs(words: np.ndarray, lengths: np.ndarray, least_length: int = LEAST_LENGTH,
              least_exponent: int = LEAST_EXPONENT, direct: int = DIRECT_PERIODS) -> np.ndarray:
    """Rows ``(start, length, period)`` of all runs, by start and then period.

    ``words`` are numbers; consecutive texts of the given ``lengths`` end with a number that occurs once.
    ``least_exponent`` is at least 4, on which the search by minimizers relies.
    """
    if least_exponent < 4:
        raise ValueError("runs of fewer than four periods are not supported")
    found = []
    longest = int(lengths.max()) if len(lengths) else 0
    for lag in range(1, direct):
        least = max(least_length, least_exponent * lag) - lag
        if longest <= least:
            break
        same = np.zeros(max(len(words) - lag, 0) + 2, np.int8)
        same[1:-1] = words[lag:] == words[:-lag]
        turns = np.flatnonzero(np.diff(same))
        starts, ends = turns[::2], turns[1::2]
        for k in np.flatnonzero(ends - starts >= least).tolist():
            start = int(starts[k])
            if lag == 1 or _is_smallest(words, start, lag):
                found.append((start, int(ends[k]) - start + lag, lag))
    for places, lags in _seeds(words, lengths, direct, least_exponent):
        last = (0, 0)
        for k in np.lexsort((places, lags)).tolist():
            at, lag = int(places[k]), int(lags[k])
            if lag == last[0] and at < last[1]:
                continue
            start = at + 1 - _matching(words, at, lag, -1)
            end = at + _matching(words, at, lag, 1)
            last = (lag, end)
            length = end - start + lag
            if length >= max(least_length, least_exponent * lag) and _is_smallest(words, start, lag):
                found.append((start, length, lag))
    rows = np.array(found, np.int64).reshape(-1, 3)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _searched(column: pa.Array, **limits) -> Iterator[tuple]:
    """Slices of texts with the number of words, runs and remaining text of each."""
    for first, end, data, offsets in text_chunks(column):
        starts, ends, before = runs(~IS_SPACE[data], offsets)
        texts = end - first
        counts = np.diff(before)
        owner = np.repeat(np.arange(texts), counts)
        # Every text is followed by a number of its own.
        places = np.arange(len(starts)) + owner
        words = np.empty(len(starts) + texts, np.uint64)
        words[places] = sliced_hashes(data, starts, ends)
        bases = before[:-1] + np.arange(texts)
        words[bases + counts] = mixed(np.arange(texts).astype(np.uint64) + _SEPARATOR)
        found = find_runs(words, counts + 1, **limits)
        # Words after the first period of a run.
        covered = np.zeros(len(words) + 1, np.int64)
        np.add.at(covered, found[:, 0] + found[:, 2], 1)
        np.add.at(covered, found[:, 0] + found[:, 1], -1)
        kept = np.cumsum(covered)[places] == 0
        own = np.searchsorted(bases, found[:, 0], "right") - 1
        found[:, 0] -= bases[own]
        run_offsets = np.searchsorted(own, np.arange(texts + 1))
        # Kept words, each but the last of a text followed by a space.
        kept_before = np.searchsorted(np.flatnonzero(kept), before)
        pieces = np.empty((int(kept.sum()), 2), np.int64)
        sizes = np.ones_like(pieces)
        pieces[:, 0], pieces[:, 1] = starts[kept], len(data)
        sizes[:, 0] = (ends - starts)[kept]
        sizes[kept_before[1:][np.diff(kept_before) > 0] - 1, 1] = 0
        text = gathered(np.append(data, np.uint8(32)), pieces.ravel(), sizes.ravel())
        total = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))])
        yield first, end, counts, found, run_offsets, text, total[kept_before]


def collapse_runs(docs: DataFrame, text: str = "text", least_length: int = LEAST_LENGTH,
                  least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """Add ``n_words``, ``runs`` and ``collapsed``, the words that remain, joined by single spaces.

    ``runs`` are by start and then period. A word remains unless some run holds it after its first period.
    """
    docs = docs.drop("n_words", "runs", "collapsed")
    schema = docs.select(
        "*", F.lit(0).cast("bigint").alias("n_words"),
        F.array(F.struct(*(F.lit(0).cast("bigint").alias(c) for c in ("start", "length", "period")))).alias("runs"),
        F.lit("").alias("collapsed")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for first, end, counts, found, at, kept, kept_at in _searched(
                    column, least_length=least_length, least_exponent=least_exponent):
                entries = pa.StructArray.from_arrays(
                    [pa.array(np.ascontiguousarray(found[:, i])) for i in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(first, end - first).columns, pa.array(counts.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), entries),
                     binary_array(kept, kept_at, pa.string())],
                    names=[*batch.schema.names, "n_words", "runs", "collapsed"])

    return docs.mapInArrow(run, schema)
