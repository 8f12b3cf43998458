"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams (one to three letters, words padded with blanks) of
a language by rank. A document's own ranking is compared with every profile by the
out-of-place distance: the sum, over the document's n-grams, of how far each is from its
place in the profile, and the profile's length for n-grams that it lacks. The closest profile
wins; ties go to the first name.

Profiles are learned from a bounded sample of labelled documents per language
(``SAMPLE_PER_LANGUAGE``, the smallest hashes of the ids), so they fit every task. Whole texts
are read both for learning and for predicting; ``lang``, ``source`` and ``doc_id`` take no
part in a prediction. A very long text is handled alone, with some 100 bytes of memory a character.

Defined cases: a null text or one without letters is ``und`` with score 0; so is every text
if nothing could be learned. Rows with a null ``lang`` or text are not learned from. Repeated
rows give repeated result rows. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from postweave.llm.batches import text_chunks
from postweave.llm.columns import broadcast_if_small
from postweave.storage import materialize

# Places of a profile, and of a document's own ranking.
PLACES = 400
# Labelled documents per language that a profile is learned from.
SAMPLE_PER_LANGUAGE = 1000
# Of large languages so many times the sample are ranked.
SPARE = 3
UNDETERMINED = "und"
# Small enough for the arrays of a chunk to stay in a core's cache.
CHUNK_BYTES = 100_000
# A document that is this close to no profile is not in a known language.
LEAST_SCORE = 0.15

_BITS = 21

@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case letter of every code point, 0 for what is not a letter."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        letter = chr(point)
        if letter.isalpha():
            low = letter.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, n-gram, count)`` of some texts, ordered by document and n-gram.

    An n-gram is three code points in one number; a blank is 1 and 0 fills short n-grams.
    """
    texts = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    # Every code point has one byte that does not continue another.
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(points))
    letters = _letters()[texts]
    # Blanks stand between texts and for each run of other characters.
    edge = np.ones(len(letters), bool)
    edge[1:] = owner[1:] != owner[:-1]
    size = len(letters) + int(edge.sum())
    at = np.arange(len(letters)) + np.cumsum(edge)
    padded, of = np.ones(size + 1, np.int64), np.full(size + 1, -1, np.int64)
    padded[at] = np.where(letters == 0, 1, letters)
    of[at] = owner
    keep = np.ones(size + 1, bool)
    keep[1:] = (padded[1:] != 1) | (padded[:-1] != 1)
    padded, of = padded[keep], of[keep]
    # A small alphabet leaves room for the document in the same number.
    place = np.zeros(0x110000, np.int64)
    place[[0, 1]] = place[padded] = 1
    alphabet = np.flatnonzero(place)
    place[alphabet] = np.arange(len(alphabet))
    code = place[padded]
    bits = int(len(alphabet) - 1).bit_length()
    first, second, third = code[:-2], code[1:-1], code[2:]
    parts = []
    letter = code != 1
    parts.append((of[letter], code[letter] << (2 * bits)))
    two = letter[:-1] | letter[1:]
    parts.append((np.where(letter[:-1], of[:-1], of[1:])[two],
                  (code[:-1][two] << (2 * bits)) | (code[1:][two] << bits)))
    three = letter[1:-1]
    parts.append((of[1:-1][three], (first[three] << (2 * bits)) | (second[three] << bits) | third[three]))
    documents = np.concatenate([p[0] for p in parts])
    grams = np.concatenate([p[1] for p in parts])
    if 3 * bits + int(len(offsets)).bit_length() < 63:
        keys = np.sort((documents << (3 * bits)) | grams)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        documents, grams = keys[new] >> (3 * bits), keys[new] & ((1 << (3 * bits)) - 1)
    else:
        order = np.lexsort((grams, documents))
        documents, grams = documents[order], grams[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (documents[1:] != documents[:-1])
        documents, grams = documents[new], grams[new]
    counts = np.diff(np.append(np.flatnonzero(new), len(new)))
    mask = (1 << bits) - 1
    wide = ((alphabet[grams >> (2 * bits)] << (2 * _BITS))
            | (alphabet[(grams >> bits) & mask] << _BITS) | alphabet[grams & mask])
    return documents, wide, counts


def _ranked(documents: np.ndarray, counts: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and ranks (from 0) of the most frequent n-grams of each document."""
    most = int(counts.max(initial=0))
    size = int(len(counts)).bit_length()
    if int(documents.max(initial=0) + 1).bit_length() + most.bit_length() + size < 63:
        # Document, falling count and row in one number.
        keys = ((documents << most.bit_length()) + (most - counts)) << size
        keys |= np.arange(len(counts))
        keys.sort()
        order = keys & ((1 << size) - 1)
    else:
        order = np.lexsort((-counts, documents))
    # Rows of a document stay together, so its ranks start where its rows do.
    rows = np.bincount(documents)
    rank = np.arange(len(order)) - np.repeat(np.cumsum(rows) - rows, rows)
    first = rank < places
    return order[first], rank[first]


@dataclass(frozen=True)
class Profiles:
    """Ranked n-grams of some languages, in the order of their names."""

    names: list[str]
    grams: np.ndarray
    # One row per n-gram, one column per language: its place, or ``places`` where it has none.
    places: np.ndarray
    length: int

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Names and scores of a column of texts."""
        names, scores = [], []
        for start, end, data, offsets in text_chunks(column, CHUNK_BYTES):
            rows = end - start
            documents, grams, counts = _grams(data, offsets)
            row, rank = _ranked(documents, counts, self.length)
            documents, grams = documents[row], grams[row]
            size = np.bincount(documents, minlength=rows)
            best, score = np.full(rows, -1), np.zeros(rows)
            if len(self.names):
                at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
                known = self.grams[at] == grams
                place = np.where(known[:, None], self.places[at], self.length)
                gap = np.where(place < self.length, np.abs(place - rank[:, None]), self.length)
                distance = np.stack([np.bincount(documents, gap[:, k], rows)
                                     for k in range(len(self.names))], axis=1)
                best = np.where(size > 0, distance.argmin(axis=1), -1)
                worst = np.maximum(size, 1) * self.length
                score = np.where(size > 0, 1 - distance.min(axis=1) / worst, 0.0)
            names.extend(self.names[b] if b >= 0 else UNDETERMINED for b in best)
            scores.append(score)
        return names, np.concatenate(scores) if scores else np.zeros(0)


def smallest_hashes(rows: DataFrame, per_language: int) -> DataFrame:
    """The distinct ``(doc_id, lang)`` with the ``per_language`` smallest hashes of each language, stored.

    Languages are counted first; of one with many documents only hashes below a bound, which about ``SPARE`` times as many
    as wanted have, are ranked. So a language's task gets a few thousand ids, however many tasks read them. If the bound
    leaves too few after all, all of them are ranked.
    """
    counts = materialize(rows.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    share = F.lit(float(SPARE * per_language)) / F.col("rows")
    hashed = rows.withColumn("hash", F.xxhash64("doc_id"))
    by_hash = Window.partitionBy("lang").orderBy("hash", "doc_id")

    def ranked(of: DataFrame) -> DataFrame:
        return materialize(of.select("doc_id", "lang", "hash").distinct().withColumn(
            "place", F.row_number().over(by_hash)).filter(F.col("place") <= per_language).select(
            "doc_id", "lang"), "sample")

    # Hashes are spread evenly over all 64-bit numbers.
    bounded = hashed.join(broadcast_if_small(counts), "lang").filter(
        (share >= 1) | (F.col("hash").cast("double") < share * 2.0 ** 64 - 2.0 ** 63))
    found = ranked(bounded)
    left = found.groupBy("lang").agg(F.count("*").alias("found"))
    short = counts.join(left, "lang", "left").filter(
        (F.col("rows") > SPARE * per_language) & (F.coalesce("found", F.lit(0)) < per_language))
    return found if short.isEmpty() else ranked(hashed)


def learn_profiles(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE,
                   places: int = PLACES) -> Profiles:
    """Profiles from ``labelled(doc_id, text, lang)``: rows to learn from only.

    The n-grams of the sample are counted by Spark tasks; one row per language and n-gram
    that is among the most frequent ones comes to the driver.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = smallest_hashes(usable.select("doc_id", "lang"), per_language)
    chosen = usable.select("doc_id", "lang", "text").join(
        broadcast_if_small(sample), ["doc_id", "lang"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spoken = batch.column(1)
            for start, end, data, offsets in text_chunks(batch.column(0), CHUNK_BYTES):
                documents, grams, counts = _grams(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [spoken.slice(start, end - start).take(pa.array(documents)), pa.array(grams),
                     pa.array(counts)], names=["lang", "gram", "rows"])

    counted = (
        chosen.select("text", "lang").mapInArrow(count, "lang string, gram bigint, rows bigint")
        .groupBy("lang", "gram").agg(F.sum("rows").alias("rows"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("rows"), "gram")
    top = (
        counted.withColumn("place", F.row_number().over(order) - 1)
        .filter(F.col("place") < places).select("lang", "gram", "place").toPandas()
    )
    names = sorted(top["lang"].unique())
    grams = np.sort(top["gram"].unique().astype(np.int64))
    ranks = np.full((len(grams), len(names)), places, np.int32)
    columns = {name: k for k, name in enumerate(names)}
    ranks[np.searchsorted(grams, top["gram"]), top["lang"].map(columns)] = top["place"]
    return Profiles(names, grams, ranks, places)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (1: every n-gram in its place, 0: none known).

    Columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            names, scores = shared.value.predict(batch.column(at))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """The documents that nothing is learned from: a quarter, by the checksum of the id."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def learning_rows(docs: DataFrame) -> DataFrame:
    """The rows that profiles may be learned from."""
    return docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id")))
