"""Benchmark passages in documents, found with a positional inverted index.

1. *Index.* The words of all documents that occur in the benchmark at all become postings
   ``(term, doc_id, position)`` of a stored table. The benchmark's vocabulary is sent to
   every executor if it is small, and joined by shuffling otherwise.
2. *Rarest first.* The terms of every passage are ranked by how often the documents have them.
   A passage with a term that no document has cannot occur.
3. *Intersection.* Postings of a passage's rarest term, shifted by its place in the passage, are
   where it could start; they are intersected with the shifted postings of the second rarest.
   What is left is rare, and is counted against the shifted postings of all the other terms.
4. *Matches.* ``phrase_matches`` keeps starts that all terms agree on; ``proximity_matches`` takes
   two terms and a distance.

Everything is built-in functions. Words are runs of letters, digits and non-ASCII characters
with A-Z lower-cased. A window is 10 consecutive words of an item; an item with fewer words, but
at least one, is one window.

Defined cases: a null text has no words; documents or items without words match nothing. Rows with
a null id are not indexed and have no matches in ``decontaminate``, and are searched by a number in
``decontaminate_rows``; items with a null id are ignored. Repeated rows of
a document are matched once and reported for each row, and rows of one id with different texts share their
positions, so ids should be unique; repeated items count once. Very long texts become postings like any others. Other columns are ignored, and empty tables
give no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from postweave.llm.columns import BROADCAST_ROWS, broadcast_if_small, lower_ascii
from postweave.operators.joins import HOT_ROWS, salted_join
from postweave.storage import materialize

# Words of a window.
WIDTH = 10

# What separates words, and what words consist of.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
# The same before A-Z are lower-cased.
RAW_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
RAW_WORDS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def word_rows(texts: DataFrame, key: str) -> DataFrame:
    """``(key, position, term)``: positions count from 0 or 1, without gaps within a text."""
    words = texts.filter(F.col(key).isNotNull()).select(
        key, F.posexplode(F.split("text", RAW_SEPARATORS, -1)).alias("position", "word"))
    return words.filter(F.col("word") != "").select(
        key, "position", lower_ascii(F.col("word")).alias("term"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(RAW_WORDS)), F.lit(0)).cast("bigint")


def windows(items: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The distinct windows as ``(window, length, offset, term)``, and ``(window, item_id)``."""
    words = F.filter(F.split(lower_ascii(F.col("text")), SEPARATORS, -1), lambda w: w != "")
    listed = items.filter(F.col("item_id").isNotNull()).select("item_id", words.alias("words")).filter(
        F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    cut = listed.select("item_id", F.explode(F.transform(
        starts, lambda i: F.slice("words", i, width))).alias("words"))
    named = materialize(cut.select("item_id", F.unhex(F.sha2(F.concat_ws(" ", "words"), 256)).alias("window"),
                                   "words").distinct(), "windows")
    distinct = named.dropDuplicates(["window"]).select(
        "window", F.size("words").alias("length"), F.posexplode("words").alias("offset", "term"))
    return distinct, named.select("window", "item_id").distinct()


def build_index(docs: DataFrame, terms: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The stored postings ``(term_id, doc_id, position)`` of the ``terms(term, term_id)``."""
    words = word_rows(docs.select("doc_id", "text"), "doc_id")
    if terms.count() <= BROADCAST_ROWS:
        found = words.join(F.broadcast(terms), "term")
    else:
        found = salted_join(words, terms, "term", "position", hot_rows=hot_rows)
    return materialize(found.select("term_id", "doc_id", "position"), "postings")


def number_terms(words: DataFrame) -> DataFrame:
    """``(term, term_id)`` of the distinct words of ``words(term)``, stored."""
    return materialize(words.select("term").distinct().select(
        "term", F.monotonically_increasing_id().alias("term_id")), "terms")


def _starts(index: DataFrame, wanted: DataFrame, hot: DataFrame, hot_rows: int) -> DataFrame:
    """``(window, doc_id, start)`` of the postings that ``wanted(term_id, window, offset)`` asks for.

    ``hot(term_id, rows)`` lists the terms with many postings, which are spread by document.
    """
    wanted = wanted.select("term_id", "window", "offset")
    found = index.join(F.broadcast(wanted), "term_id") if wanted.count() <= BROADCAST_ROWS else (
        salted_join(index, wanted, "term_id", "doc_id", hot, hot_rows=hot_rows))
    return found.select("window", "doc_id", (F.col("position") - F.col("offset")).alias("start")).filter(
        F.col("start") >= 0)


def phrase_matches(index: DataFrame, windows: DataFrame, terms: DataFrame,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(window, doc_id, start, length)``: every exact occurrence of every window."""
    counts = materialize(index.groupBy("term_id").agg(F.count("*").alias("rows")), "term-counts")
    hot = counts.filter(F.col("rows") > hot_rows)
    known = windows.join(terms, "term").join(counts, "term_id", "left")
    every = Window.partitionBy("window")
    ranked = materialize(
        known.withColumn("least", F.min(F.coalesce("rows", F.lit(0))).over(every))
        .filter(F.col("least") > 0)
        .withColumn("rank", F.row_number().over(every.orderBy("rows", "offset")))
        .select("window", "length", "offset", "term_id", "rank"), "ranked-terms")
    first = _starts(index, ranked.filter("rank = 1"), hot, hot_rows)
    second = _starts(index, ranked.filter("rank = 2"), hot, hot_rows)
    lengths = ranked.select("window", "length").distinct()
    place = ["window", "doc_id", "start"]
    # Passages of a single word have no second term.
    single = first.join(broadcast_if_small(lengths.filter("length = 1").select("window")), "window",
                        "left_semi")
    both = first.join(second, place, "left_semi").unionByName(single).distinct()
    both = materialize(both, "intersected")
    others = ranked.filter("rank > 2").select("window", "length", "offset", "term_id")
    documents = broadcast_if_small(materialize(both.select("doc_id").distinct(), "matched"))
    rest = index.join(documents, "doc_id", "left_semi")
    small = broadcast_if_small(others)
    expected = both.join(small, "window").select(
        *place, "length", "term_id", (F.col("start") + F.col("offset")).alias("position"))
    full = (
        expected.join(rest.distinct(), ["doc_id", "position", "term_id"])
        .groupBy(*place, "length").agg(F.count("*").alias("rows"))
        .filter(F.col("rows") == F.col("length") - 2).drop("rows")
    )
    short = both.join(broadcast_if_small(lengths.filter("length <= 2")), "window")
    return full.unionByName(short.select(*full.columns))


def proximity_matches(index: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """``(pair, doc_id, position, other)``: both terms at most ``within`` words apart.

    ``pairs`` is ``(pair, first_id, second_id)``. Positions are compared in strips of ``within``
    words, so a term's postings meet only those of the same and the next strips.
    """
    strip = F.floor(F.col("position") / within)
    first = index.join(pairs, F.col("term_id") == F.col("first_id")).select(
        "pair", "doc_id", "position", F.explode(F.array(strip - 1, strip, strip + 1)).alias("strip"))
    second = index.join(pairs, F.col("term_id") == F.col("second_id")).select(
        "pair", "doc_id", F.col("position").alias("other"), strip.alias("strip"))
    near = F.abs(F.col("position") - F.col("other")) <= within
    return first.join(second, ["pair", "doc_id", "strip"]).filter(
        near & (F.col("position") != F.col("other"))).drop("strip").distinct()


def hit_words(matches: DataFrame) -> DataFrame:
    """``(doc_id, n_hit)``: words inside any match, each counted once."""
    spans = matches.select("doc_id", "start", (F.col("start") + F.col("length")).alias("end")).groupBy(
        "doc_id", "start").agg(F.max("end").alias("end"))
    before = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max("end").over(before), F.lit(0))
    fresh = F.greatest(F.col("end") - F.greatest("start", covered), F.lit(0))
    return spans.withColumn("fresh", fresh).groupBy("doc_id").agg(F.sum("fresh").alias("n_hit"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(doc_id, n_words, n_hit, item_ids, contaminated)`` for every row of ``docs``.

    ``item_ids`` lists the items with a window in the document, in string order.
    """
    cut, owners = windows(items.select("item_id", "text"), width)
    cut = materialize(cut, "window-terms")
    terms = number_terms(cut)
    index = build_index(docs, terms, hot_rows)
    matches = materialize(phrase_matches(index, cut, terms, hot_rows), "matches")
    owned = matches.select("doc_id", "window").distinct().join(
        broadcast_if_small(owners), "window").select("doc_id", "item_id").distinct()
    listed = owned.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids"))
    found = hit_words(matches).join(listed, "doc_id")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return docs.select("doc_id", word_count(F.col("text")).alias("n_words")).join(
        found, "doc_id", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        (n_hit > 0).alias("contaminated"))


def number_unnamed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a null id and their number ``_row``, stored."""
    return materialize(docs.filter(F.col("doc_id").isNull()).withColumn(
        "_row", F.monotonically_increasing_id()), "unnamed")


def decontaminate_rows(docs: DataFrame, items: DataFrame, width: int = WIDTH,
                       hot_rows: int = HOT_ROWS) -> DataFrame:
    """As ``decontaminate``, with rows that have a null id searched as well, each on its own."""
    found = decontaminate(docs.filter(F.col("doc_id").isNotNull()), items, width, hot_rows)
    unnamed = number_unnamed(docs.select("doc_id", "text"))
    if unnamed.isEmpty():
        return found
    numbered = unnamed.select(F.col("_row").alias("doc_id"), "text")
    others = decontaminate(numbered, items, width, hot_rows)
    return found.unionByName(others.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
