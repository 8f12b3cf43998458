"""A corpus pipeline: from raw documents to encoded training documents.

Every stage takes ``(spark, docs, folder)`` and returns a frame that is written and read again as
the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from postweave.llm import (  # noqa: E402
    decontamination, language, line_dedup, ngram_join, piece_encoding)
from postweave.llm.queries import vocabulary  # noqa: E402
from postweave.sources.derive import table  # noqa: E402
from postweave.storage import discard, materialize, noted_tables  # noqa: E402


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep documents in a known language, which becomes their ``lang``."""
    profiles = language.learn_profiles(language.learning_rows(docs))
    known = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= language.LEAST_SCORE)
    return language.identify(docs, profiles).filter(known).withColumn(
        "lang", F.col("lang_pred")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Remove lines that many different documents share, but for the first of them; documents without any word left go.

    Exact copies count once, and of near copies the first stays whole: else all lines that ten of them share would go
    from every one.
    """
    kept = line_dedup.dedup_lines(line_dedup.distinct_texts(docs), keep_first=True)
    emptied = (F.col("n_dropped") > 0) & ~F.col("text").rlike(line_dedup.HAS_WORD)
    return kept.filter(~emptied).withColumn(
        "n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep the document with the smallest id of each group of similar documents.

    Repeated rows of a document are reduced to one; rows without an id stay.
    """
    groups = ngram_join.similar_documents(docs)
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    ours = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return ours.unionByName(docs.filter(F.col("doc_id").isNull())).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Remove documents with a passage of the benchmark; those without an id are searched by a number."""
    items = table(spark, folder, "benchmark")

    def clean(rows: DataFrame, key: str) -> DataFrame:
        searched = rows.select(F.col(key).alias("doc_id"), "text")
        found = decontamination.decontaminate(searched, items)
        hit = found.filter("contaminated").select(F.col("doc_id").alias(key)).distinct()
        return rows.join(hit, key, "left_anti").select(*docs.columns)

    kept = clean(docs.filter(F.col("doc_id").isNotNull()), "doc_id")
    unnamed = decontamination.number_unnamed(docs)
    return kept if unnamed.isEmpty() else kept.unionByName(clean(unnamed, "_row"))


def encode_pieces(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Ids of every document, and the digest of the text they decode to."""
    path = vocabulary("piece_bpe_32k.model")
    return piece_encoding.round_trip(docs.select("doc_id", "lang", "source", "text"), path).select(
        "doc_id", "lang", "source", "ids", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding and decoding", encode_pieces),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; a stage's own tables go once its result is written, and that after the next."""
    docs, previous = table(spark, folder, "documents"), None
    for name, stage in STAGES[:-1]:
        with noted_tables() as made:
            stored = materialize(stage(spark, docs, folder), name.replace(" ", "-"))
        discard(*(t for t in made if t is not stored), *([previous] if previous is not None else []))
        docs = previous = stored
    return STAGES[-1][1](spark, docs, folder)


# Language ID and the encoding are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None
