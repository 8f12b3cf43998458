"""Quality rules from how often lines occur in the documents of a host.

1. ``text_metrics`` reads every whole text once: counts of words, symbols, repeated lines and
   repeated words, and the base rule that rests on them.
2. Lines are normalised (white space at the ends stripped, A-Z lower-cased, digits made
   equal) and hashed together with the host. A document counts once for each of its lines.
   Counts are combined map-side, so a line that a third of all documents share, or a host with
   a third of all rows, is no hot spot.
3. A line found in more than ``most_documents`` documents of its host is removed; a document
   that keeps less than ``least_kept`` of its words is depleted and rejected, and so is one
   that fails the base rule.

Defined cases: a null text has no words and fails the base rule. A null host is a host of its
own. Rows with a null id get their base metrics; their lines count like others, but none of
them is rejected for depletion. Repeated rows count as one document. Columns other than
the named ones pass through ``clean_lines`` unchanged; an empty table gives an empty result. A very long text is handled
alone, with arrays of a fixed number of bytes per character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postweave.llm.batches import IS_SPACE, range_hashes, runs, text_chunks, window_hashes
from postweave.llm.columns import BROADCAST_ROWS, SPACES, lower_ascii
from postweave.operators.joins import HOT_ROWS, salted_join
from postweave.storage import materialize

# A line in more documents of a host than this is removed ...
MOST_DOCUMENTS = 20
# ... and so many percent of a document's words must be left.
LEAST_KEPT = 50

# The base rule of the contract.
LEAST_WORDS = 50
REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 3

_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count_metrics(column: pa.Array) -> np.ndarray:
    """One row per text with the numbers of ``METRICS``."""
    found = [np.zeros((0, len(METRICS)), np.int64)]
    for start, end, data, offsets in text_chunks(column):
        rows = np.zeros((end - start, len(METRICS)), np.int64)
        inside = ~IS_SPACE[data]
        starts, ends, words = runs(inside, offsets)
        hashes = range_hashes(data, starts, ends)
        # Bytes that do not continue a code point.
        letters = np.concatenate([[0], np.cumsum(inside & ((data & 0xC0) != 0x80))])
        symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[data])])
        rows[:, 0] = np.diff(words)
        rows[:, 1] = np.diff(letters[offsets])
        rows[:, 2] = np.diff(symbols[offsets])
        line_starts, line_ends, lines = runs(data != 10, offsets)
        # Lines without a word do not count.
        worded = np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends)
        line_hashes = range_hashes(data, line_starts, line_ends)
        triples = window_hashes(hashes, REPEAT_WINDOW)
        for i in range(end - start):
            own = line_hashes[lines[i]:lines[i + 1]][worded[lines[i]:lines[i + 1]]]
            rows[i, 3] = len(own) - len(np.unique(own))
            size = words[i + 1] - words[i]
            if size > REPEAT_WINDOW:
                windows = triples[words[i]:words[i + 1] - REPEAT_WINDOW + 1]
                _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
                repeated = times[which] > 1
                covered = np.zeros(size, bool)
                for k in range(REPEAT_WINDOW):
                    covered[k:k + len(windows)] |= repeated
                rows[i, 4] = covered.sum()
        found.append(rows)
    return np.concatenate(found)


def text_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the numbers of ``METRICS`` and ``base_failed`` to every row, replacing such columns."""
    docs = docs.drop(*METRICS, "base_failed")
    schema = docs.select("*", *(F.lit(0).cast("bigint").alias(m) for m in METRICS)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = count_metrics(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(rows[:, k]) for k in range(len(METRICS)))],
                names=[*batch.schema.names, *METRICS])

    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return docs.mapInArrow(run, schema).withColumn("base_failed", failed)


def normalised(line: Column) -> Column:
    """What lines must have in common to count as the same: digits are all alike."""
    return F.translate(lower_ascii(F.btrim(line, F.lit(SPACES))), "123456789", "000000000")


def line_rows(docs: DataFrame, host: str = "source") -> DataFrame:
    """``(doc_id, position, line, words)``: hash and number of words of every line with a word."""
    lines = docs.filter(F.col("doc_id").isNotNull()).select(
        "doc_id", host, F.posexplode(F.split("text", "\n", -1)).alias("position", "raw"))
    plain = lines.select("doc_id", host, "position", normalised(F.col("raw")).alias("plain"))
    return plain.filter(F.col("plain") != "").select(
        "doc_id", "position", F.xxhash64(F.lit("host"), F.col(host), F.col("plain")).alias("line"),
        (F.regexp_count("plain", F.lit("[\\x20\\x09-\\x0D]+")) + 1).alias("words"))


def frequent_lines(lines: DataFrame, most_documents: int = MOST_DOCUMENTS) -> DataFrame:
    """``(line, documents)`` of the lines in more than ``most_documents`` documents."""
    return lines.select("doc_id", "line").groupBy("line").agg(
        F.count("*").alias("rows"), F.count_distinct("doc_id").alias("documents")).filter(
        F.col("documents") > most_documents)


def removed_words(docs: DataFrame, host: str = "source", most_documents: int = MOST_DOCUMENTS,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(doc_id, n_removed_lines, n_removed_words)`` of the documents with frequent lines."""
    lines = materialize(line_rows(docs, host), "quality-lines")
    frequent = materialize(frequent_lines(lines, most_documents), "frequent-lines")
    if frequent.count() <= BROADCAST_ROWS:
        hit = lines.join(F.broadcast(frequent.select("line")), "line")
    else:
        hot = frequent.filter(F.col("rows") > hot_rows).select("line", "rows")
        hit = salted_join(lines, frequent.select("line"), "line", "doc_id", hot, hot_rows=hot_rows)
    # Repeated rows of a document have the same lines at the same positions.
    once = hit.groupBy("doc_id", "position").agg(F.max("words").alias("words"))
    return once.groupBy("doc_id").agg(
        F.count("*").alias("n_removed_lines"), F.sum("words").alias("n_removed_words"))


def judge(docs: DataFrame, host: str = "source", most_documents: int = MOST_DOCUMENTS,
          least_kept: int = LEAST_KEPT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(doc_id, metrics, base_failed, n_removed_words, kept)`` for every row of ``docs``."""
    removed = removed_words(docs, host, most_documents, hot_rows)
    measured = text_metrics(docs.select("doc_id", "text")).drop("text")
    gone = F.coalesce("n_removed_words", F.lit(0)).cast("bigint")
    depleted = (100 * (F.col("n_words") - gone) < least_kept * F.col("n_words"))
    return measured.join(removed, "doc_id", "left").select(
        "doc_id", *METRICS, "base_failed", gone.alias("n_removed_words"),
        (~F.col("base_failed") & ~depleted).alias("kept"))


def clean_lines(docs: DataFrame, host: str = "source", most_documents: int = MOST_DOCUMENTS,
                least_kept: int = LEAST_KEPT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The kept documents, with the frequent lines of their host removed from ``text``."""
    docs = docs.drop("_frequent")
    lines = materialize(line_rows(docs, host), "quality-lines")
    frequent = frequent_lines(lines, most_documents).select("line")
    hits = materialize(lines.select("doc_id", "line").distinct().join(frequent, "line", "left_semi")
                       .groupBy("doc_id").agg(F.collect_list("line").alias("_frequent")), "hits")
    verdicts = judge(docs, host, most_documents, least_kept, hot_rows).filter("kept").select(
        "doc_id").distinct()
    kept = docs.join(verdicts, "doc_id", "left_semi").join(hits, "doc_id", "left")
    left = F.filter(F.split("text", "\n", -1), lambda x: ~F.coalesce(F.array_contains(
        "_frequent", F.xxhash64(F.lit("host"), F.col(host), normalised(x))), F.lit(False)))
    return kept.withColumn("text", F.array_join(left, "\n")).select(*docs.columns)
