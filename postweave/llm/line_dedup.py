"""Lines that repeat across documents, found by sorting line hashes and kept as bitmaps.

1. Every line becomes ``(hash, document, position)``; its key is the line stripped of ASCII
   white space with A-Z lower-cased, hashed to 128 bits.
2. The rows are range-partitioned by hash and document and sorted by position within: a key
   that a third of all documents have is spread over as many partitions as it needs. A window
   streams over each partition and marks a document's first occurrence of a key.
3. First occurrences are summed per key, map-side first: the number of its documents.
4. Lines to drop are or-ed into bitmaps of 64 lines. Only words with a dropped line are kept,
   so a document without one costs nothing, and no text is sent until it is rebuilt.

Everything is built-in functions. Defined cases: a null or empty text is one empty line; lines
with an empty key are always kept; lines end at a line feed only. Repeated rows of a document
count as one document and are all rebuilt. Documents with a null id are kept as they are and
their lines are not counted. Other columns pass through unchanged. The rows of a very long text are spread like
any others, and it is put together again in one pass over its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from postweave.llm.columns import BROADCAST_ROWS, SPACES, broadcast_if_small, lower_ascii
from postweave.operators.joins import HOT_ROWS, salted_join
from postweave.storage import materialize

# A key found in this many documents is boilerplate.
LEAST_DOCUMENTS = 10
# A text with a word.
HAS_WORD = "[^\\x20\\x09-\\x0D]"
# Lines of one bitmap word.
WORD = 64


def line_key(line: Column) -> Column:
    """What two lines must have in common to count as the same."""
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, position, first_hash, second_hash)`` of all lines with a key."""
    lines = docs.filter(F.col("doc_id").isNotNull()).select(
        "doc_id", F.posexplode(split_lines(F.col("text"))).alias("position", "line"))
    keyed = lines.select("doc_id", "position", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.col("key") != "").select(
        "doc_id", "position", F.xxhash64("key").alias("first_hash"),
        F.xxhash64(F.lit(1), "key").alias("second_hash"))


def ordered_lines(docs: DataFrame) -> DataFrame:
    """The lines ordered by hash, document and position, with ``place`` among equal ones.

    ``place`` is 1 for the first occurrence of a key in a document.
    """
    key = ["first_hash", "second_hash", "doc_id"]
    streamed = Window.partitionBy(*key).orderBy("position")
    return (
        line_rows(docs).repartitionByRange(*key).dropDuplicates([*key, "position"])
        .sortWithinPartitions(*key, "position")
        .withColumn("place", F.row_number().over(streamed))
    )


def document_counts(lines: DataFrame) -> DataFrame:
    """``(first_hash, second_hash, documents)``: in how many documents each key occurs."""
    return lines.filter(F.col("place") == 1).groupBy("first_hash", "second_hash").agg(
        F.count("*").alias("documents"), F.min("doc_id").alias("first_document"))


def drop_bitmaps(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS,
                 keep_first: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(doc_id, n_dropped, bitmap)`` of the documents that lose lines.

    ``bitmap`` lists ``(word, bits)`` in order: bit ``b`` of word ``w`` is set if line
    ``64 w + b`` goes; all other lines stay. With ``keep_first`` a key's first line in its
    smallest document stays.
    """
    lines = materialize(ordered_lines(docs), "lines")
    counts = materialize(
        document_counts(lines).filter(F.col("documents") >= least_documents), "frequent-lines")
    if counts.count() <= BROADCAST_ROWS:
        found = lines.join(F.broadcast(counts), ["first_hash", "second_hash"])
    else:
        # The second hash is compared after the join on the first.
        hot = lines.groupBy("first_hash").agg(F.count("*").alias("rows")).filter(
            F.col("rows") > hot_rows)
        both = counts.groupBy("first_hash").agg(F.collect_list(F.struct(
            "second_hash", "first_document")).alias("same"))
        found = salted_join(lines, both, "first_hash", "doc_id", hot, hot_rows=hot_rows).withColumn(
            "hit", F.filter("same", lambda x: x["second_hash"] == F.col("second_hash"))[0]
        ).filter(F.col("hit").isNotNull()).withColumn("first_document", F.col("hit.first_document"))
    if keep_first:
        found = found.filter((F.col("place") > 1) | (F.col("doc_id") != F.col("first_document")))
    word = F.floor(F.col("position") / WORD).cast("int")
    bit = F.expr(f"shiftleft(1L, position % {WORD})")
    words = found.groupBy("doc_id", word.alias("word")).agg(
        F.bit_or(bit).alias("bits"), F.count("*").alias("lines"))
    return words.groupBy("doc_id").agg(
        F.sum("lines").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("bitmap"))


def dense_words(bitmap: Column) -> Column:
    """The words of a bitmap up to its last one, as an array without gaps."""
    words = F.transform(bitmap, lambda x: x["word"])
    before = F.concat(F.array(F.lit(-1)), F.slice(words, F.lit(1), F.size(words) - 1))
    return F.flatten(F.zip_with(bitmap, before, lambda x, last: F.concat(
        F.array_repeat(F.lit(0).cast("bigint"), x["word"] - last - 1), F.array(x["bits"]))))


def kept_text(text: Column, words: Column) -> Column:
    """The lines of ``text`` that the bits of ``words`` do not drop, in one pass over them.

    ``words`` is looked at for every line, so it should be a column and no expression.
    """
    def stays(_: Column, i: Column) -> Column:
        bit = F.getbit(F.get(words, F.floor(i / WORD).cast("int")), i % WORD)
        return F.coalesce(bit, F.lit(0)) == 0

    return F.array_join(F.filter(split_lines(text), stays), "\n")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """Keep the document with the smallest id of those with the same text.

    Texts without words and rows without an id stay. Texts are compared by 128 bits.
    """
    digest = F.unhex(F.md5("text")).alias("_digest")
    named = docs.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(HAS_WORD)).select("doc_id", digest)
    firsts = materialize(named.groupBy("_digest").agg(
        F.min("doc_id").alias("_first"), F.count("*").alias("rows")).filter(F.col("rows") > 1), "copied-texts")
    if firsts.count() <= BROADCAST_ROWS:
        found = named.join(F.broadcast(firsts), "_digest")
    else:
        hot = firsts.filter(F.col("rows") > HOT_ROWS).select("_digest", "rows")
        found = salted_join(named, firsts.drop("rows"), "_digest", "doc_id", hot)
    copies = materialize(found.filter(F.col("doc_id") != F.col("_first")).select(
        "doc_id", "_digest").distinct(), "copies")
    return docs.withColumn("_digest", digest).join(
        broadcast_if_small(copies), ["doc_id", "_digest"], "left_anti").select(*docs.columns)


def dedup_lines(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS,
                keep_first: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``docs`` with the kept lines as ``text``, and ``n_lines`` and ``n_dropped`` added.

    A null text becomes empty. Columns named like the added ones are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped", "_dropped", "_bitmap")
    bitmaps = drop_bitmaps(docs, least_documents, keep_first, hot_rows).select(
        "doc_id", F.col("n_dropped").alias("_dropped"), dense_words(F.col("bitmap")).alias("_bitmap"))
    text = F.coalesce("text", F.lit(""))
    return docs.join(bitmaps, "doc_id", "left").withColumns({
        "n_lines": F.size(split_lines(F.col("text"))).cast("bigint"),
        "n_dropped": F.coalesce("_dropped", F.lit(0)).cast("bigint"),
        "text": F.when(F.col("_bitmap").isNull(), text).otherwise(
            kept_text(F.col("text"), F.col("_bitmap"))),
    }).select(*docs.columns, "n_lines", "n_dropped")
