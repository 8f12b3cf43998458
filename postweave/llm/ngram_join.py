"""Groups of documents whose word shingles overlap, by a T-occurrence search.

Two documents are linked if the Jaccard similarity of their shingle sets reaches a threshold
``s``. The search is exact up to collisions of 64-bit hashes and never lists the pairs of a
group:

1. *Classes.* Documents with equal sets are one class; its smallest id stands for all.
2. *Prefixes.* Of ``n`` shingles in hash order, two linked documents share at least
   ``t(n) = 1 + n // 16`` among the first ``n - ceil(s n) + t(n)`` of either. Only these
   are put into inverted lists, and lists of one document are dropped.
3. *Short lists.* Of each class one document goes on. A document with fewer than ``t`` of its prefix shingles in longer lists has
   no partner. Any other sets its ``t - 1`` longest lists aside, as a linked document must
   also be found in one of the others.
4. *Groups.* Every short list names its smallest document; all documents with a list of the
   same name form a group. Linked documents meet in a group, and a document is in as many
   groups as its short lists have names. Groups of many shingles are cut into blocks, and
   all pairs of blocks are searched by different tasks.
5. *Search.* Within a pair of blocks, ``search_links`` runs DivideSkip over the full sets.
   It returns links that connect all linked documents, at most one less than documents.
6. *Components* of the links, handed back to the members of the classes.

Defined cases: a null or wordless text has an empty set, is linked with nothing and is its own
component. A text of fewer than five words is one shingle. A very long text is handled alone; its set takes 8 bytes a
shingle. Repeated rows give repeated result
rows. Rows without an id take part in no group and keep a null component. All columns but
``doc_id`` and ``text`` are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postweave.llm.batches import (
    IS_SPACE, LOWER, binary_column, list_column, mixed, range_hashes, runs, text_chunks,
    window_hashes)
from postweave.llm.columns import broadcast_if_small
from postweave.operators.graph import component_stars
from postweave.operators.joins import HOT_ROWS, salted_join
from postweave.storage import materialize

WIDTH = 5
# Similarity in percent.
SIMILARITY = 80
# One more shingle for so many is expected to be shared within the prefixes.
SHARED_OF = 16
# Shingles of one block of a group: 8 bytes each, held several times by a task.
BLOCK_SHINGLES = 500_000
# DivideSkip: the more a probe costs against a merged entry, the fewer lists are set aside.
PROBE_COST = 0.01

_SETS = "doc_id bigint, n_shingles bigint, class binary, prefix array<bigint>"
_MEMBERS = "doc_id bigint, shingles binary"


def shared_at_least(n: int) -> int:
    """Shingles that two linked documents of ``n`` and more share within their prefixes."""
    return 1 + n // SHARED_OF


def least_overlap(n: int, similarity: int = SIMILARITY) -> int:
    """The shingles a set of ``n`` shares with any linked set, at least."""
    return -(-similarity * n // 100)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles.

    A-Z are lower-cased and words end at ASCII white space.
    """
    for _, _, data, offsets in text_chunks(column):
        data = LOWER[data]
        starts, ends, words = runs(~IS_SPACE[data], offsets)
        hashes = range_hashes(data, starts, ends)
        windows = window_hashes(hashes, width)
        for a, b in zip(words[:-1], words[1:]):
            if b - a >= width:
                yield np.unique(windows[a:b - width + 1])
            else:
                # Shorter sequences start from another number than full shingles.
                yield window_hashes(hashes[a:b], b - a) if b > a else hashes[:0]


def _class_of(shingles: np.ndarray) -> bytes | None:
    if not len(shingles):
        return None
    other = mixed(shingles + np.uint64(1))
    return np.array([len(shingles), shingles.sum(), other.sum()], np.uint64).tobytes()


def set_table(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """``(doc_id, n_shingles, class, prefix)``; equal sets have an equal class, null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes, prefixes = [], [], []
            for shingles in shingle_sets(batch.column(1), width):
                n = len(shingles)
                sizes.append(n)
                classes.append(_class_of(shingles))
                prefix = shingles[:n - least_overlap(n, similarity) + shared_at_least(n)]
                prefixes.append(prefix)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), binary_column(classes),
                 list_column(prefixes)], names=["doc_id", "n_shingles", "class", "prefix"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _SETS)


def member_table(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, shingles)`` with the whole sets as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.tobytes() for x in shingle_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), binary_column(sets)], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _MEMBERS)


def similar_documents(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY,
                      block_shingles: int = BLOCK_SHINGLES,
                      hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest id that links lead to, the document itself included.
    """
    sets = materialize(set_table(docs, width, similarity), "shingle-sets")
    named = sets.filter(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialize(named.groupBy("class").agg(
        F.min("doc_id").alias("id"), F.max("n_shingles").alias("n_shingles"),
        F.count("*").alias("rows")), "classes")
    chosen = classes.select(F.col("id").alias("doc_id"), "n_shingles")
    links = similar_pairs(docs, sets, chosen, width, similarity, block_shingles, hot_rows)
    stars = component_stars(links, hot_rows)
    labels = classes.join(stars, "id", "left").select(
        "class", F.coalesce("component", "id").alias("label"))
    hot = classes.filter(F.col("rows") > hot_rows).select("class", "rows")
    narrow = sets.select("doc_id", "n_shingles", "class")
    joined = salted_join(narrow, labels, "class", "doc_id", hot, "left", hot_rows)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id"))


def similar_pairs(docs: DataFrame, sets: DataFrame, chosen: DataFrame, width: int = WIDTH,
                  similarity: int = SIMILARITY, block_shingles: int = BLOCK_SHINGLES,
                  hot_rows: int = HOT_ROWS, every: bool = False) -> DataFrame:
    """``(src, dst)``: links that connect all linked documents among ``chosen(doc_id, n_shingles)``.

    With ``every`` all candidates are verified and each linked pair is returned once, ``src`` below
    ``dst``: with class representatives as ``chosen``, pairs of different sets. Their number grows with
    the square of a group of near copies, so components are better found without it.
    """
    groups = materialize(_groups(sets, chosen, similarity, hot_rows), "groups")
    ids = broadcast_if_small(materialize(groups.select("doc_id").distinct(), "members"))
    members = member_table(docs.join(ids, "doc_id", "left_semi"), width).dropDuplicates(["doc_id"])
    parts = _blocked(groups, block_shingles).join(members, "doc_id")

    def run(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].to_numpy()
        order = np.argsort(ids)
        shingles = table["shingles"].combine_chunks()
        found = search_links(
            [np.frombuffer(shingles[i].as_buffer(), np.uint64) for i in order],
            table["block"].to_numpy()[order], similarity, every)
        ids = ids[order]
        return pa.table({"src": pa.array([ids[a] for a, _ in found], pa.int64()),
                         "dst": pa.array([ids[b] for _, b in found], pa.int64())})

    links = parts.groupBy("name", "low", "high").applyInArrow(run, "src bigint, dst bigint")
    # A pair may meet in several groups.
    return links.distinct() if every else links


def _groups(sets: DataFrame, chosen: DataFrame, similarity: int, hot_rows: int) -> DataFrame:
    """``(name, doc_id, n_shingles)``: the documents that share short lists of a name."""
    postings = sets.filter(F.col("doc_id").isNotNull()).select(
        "doc_id", F.explode("prefix").alias("shingle"))
    # Copies are counted as well; how long a list is matters for the order only.
    lists = materialize(postings.groupBy("shingle").agg(F.count("*").alias("rows"))
                        .filter(F.col("rows") > 1), "lists")
    hot = lists.filter(F.col("rows") > hot_rows)
    listed = salted_join(postings, lists, "shingle", "doc_id", hot, hot_rows=hot_rows)
    # One document's lists, longest last; repeated rows of a document fall together.
    n = F.col("n_shingles")
    partner = F.ceil(n * similarity / 100)
    need = F.lit(1) + F.floor(partner / SHARED_OF).cast("int")
    short = (
        listed.join(chosen, "doc_id").groupBy("doc_id", "n_shingles")
        .agg(F.sort_array(F.collect_set(F.struct("rows", "shingle"))).alias("lists"))
        .withColumn("need", need).filter(F.size("lists") >= F.col("need"))
        .select("doc_id", "n_shingles",
                F.explode(F.slice("lists", F.lit(1), F.size("lists") - F.col("need") + 1)).alias("list"))
        .select("doc_id", "n_shingles", F.col("list.shingle").alias("shingle"))
    )
    short = materialize(short, "short-lists")
    names = materialize(short.groupBy("shingle").agg(
        F.min("doc_id").alias("name"), F.count("*").alias("rows")).filter(F.col("rows") > 1), "names")
    joined = salted_join(short, names.drop("rows"), "shingle", "doc_id",
                         names.filter(F.col("rows") > hot_rows).select("shingle", "rows"),
                         hot_rows=hot_rows)
    return joined.select("name", "doc_id", "n_shingles").distinct()


def _blocked(groups: DataFrame, block_shingles: int) -> DataFrame:
    """Add ``block`` and the pair ``low, high`` of blocks that a row is sent to.

    Of groups with several blocks there are at most as many as blocks in all.
    """
    sizes = groups.groupBy("name").agg(F.sum("n_shingles").alias("size"))
    blocks = F.ceil(F.col("size") / F.lit(block_shingles)).cast("int")
    large = sizes.select("name", blocks.alias("blocks")).filter(F.col("blocks") > 1)
    count = F.coalesce("blocks", F.lit(1))
    other = F.explode(F.sequence(F.lit(0), count - 1))
    return (
        groups.join(F.broadcast(large), "name", "left")
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), count).cast("int"))
        .withColumn("other", other)
        .select("name", "doc_id", "block", F.least("block", "other").alias("low"),
                F.greatest("block", "other").alias("high"))
    )


class _Components:
    """Sets that are connected so far, by union-find."""

    def __init__(self, size: int):
        self.above = list(range(size))

    def root(self, x: int) -> int:
        above = self.above
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    def join(self, x: int, y: int) -> None:
        self.above[self.root(y)] = self.root(x)


def merge_lists(entries: list[int], first: list[int], ends: list[int], least: int) -> Iterator[tuple[int, int]]:
    """``(entry, count)`` of the entries that at least ``least`` of some ascending lists hold.

    List ``j`` is ``entries[first[j]:ends[j]]``. A heap holds the next entry of each list; if the smallest is in too few,
    ``least - 1`` lists are taken off and skip by binary search to the entry that is then on top.
    """
    lists = len(first)
    at = list(first)
    heap = [entries[a] * lists + j for j, a in enumerate(at) if a < ends[j]]
    heapify(heap)
    while len(heap) >= least:
        top = heap[0] // lists
        taken = []
        while heap and heap[0] // lists == top:
            taken.append(heappop(heap) % lists)
        if len(taken) >= least:
            yield top, len(taken)
            for j in taken:
                at[j] += 1
        else:
            while len(taken) < least - 1 and heap:
                taken.append(heappop(heap) % lists)
            if not heap:
                return
            top = heap[0] // lists
            for j in taken:
                at[j] = bisect_left(entries, top, at[j], ends[j])
        for j in taken:
            if at[j] < ends[j]:
                heappush(heap, entries[at[j]] * lists + j)


def search_links(sets: list[np.ndarray], block: np.ndarray,
                 similarity: int = SIMILARITY, every: bool = False) -> list[tuple[int, int]]:
    """Links between the sets of two blocks, or within one, enough to connect all linked sets.

    Every set is looked up in the inverted lists of the sets after it, or of the second block. DivideSkip: the longest
    lists are set aside; the others are merged by a heap, and only sets found often enough to still reach the
    overlap are probed for in the long lists, by binary search, shortest list first.

    Unless ``every`` link is asked for, sets that are connected already are not looked at again: a list
    whose sets are all connected is of no use to any of them, which a place in the list remembers up to which
    all are, and a set with too few other lists is done.
    """
    two = len(np.unique(block)) > 1
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64),
                         return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    # Lists hold the numbers of their sets in ascending order; of two blocks only the second is listed.
    low = int(block.min()) if len(block) else 0
    listed = block != low if two else np.ones(len(sets), bool)
    inside = np.flatnonzero(listed[owner])
    order = inside[np.argsort(token[inside], kind="stable")]
    lengths = np.bincount(token[order], minlength=int(token.max()) + 1 if len(token) else 0)
    list_ends = np.cumsum(lengths)
    entries = owner[order].tolist()
    places = np.asarray(entries)
    known = (list_ends - lengths).tolist()
    components, links = _Components(len(sets)), []
    enough = 1 if two else 2

    def all_connected(lists: np.ndarray, q: int) -> np.ndarray:
        """Which lists hold only sets that are connected with ``q``."""
        root, found = components.root, []
        own = root(q)
        for t, start, end in zip(lists.tolist(), (list_ends - lengths)[lists].tolist(), list_ends[lists].tolist()):
            common = root(entries[start])
            at = known[t]
            while at < end and root(entries[at]) == common:
                at += 1
            known[t] = at
            found.append(at == end and common == own)
        return np.array(found, bool)

    def verified(q: int, found: list[tuple[int, int]], probed: np.ndarray) -> list[int]:
        """Which of the sets found in the short lists reach the overlap."""
        near, count = np.array(found).T
        wanted = -(-similarity * (sizes[q] + sizes[near]) // (100 + similarity))
        for left, t in zip(range(len(probed), 0, -1), probed):
            # What is still missing must not exceed the lists that are left.
            alive = count + left >= wanted
            near, count, wanted = near[alive], count[alive], wanted[alive]
            if not len(near):
                break
            held = places[list_ends[t] - lengths[t]:list_ends[t]]
            at = np.minimum(np.searchsorted(held, near), len(held) - 1)
            count = count + (held[at] == near)
        return near[count >= wanted].tolist()

    for q, n in enumerate(sizes.tolist()):
        if two and listed[q]:
            continue
        own = token[starts[q]:starts[q] + n]
        own = own[lengths[own] >= enough]
        least = least_overlap(n, similarity)
        if len(own) < least:
            continue
        if not every:
            own = own[~all_connected(own, q)]
            if len(own) < least:
                continue
        own = own[np.argsort(lengths[own], kind="stable")]
        aside = int(least / (PROBE_COST * math.log2(lengths[own[-1]] + 1) + 1)) - 1
        aside = min(max(aside, 0), least - 1)
        merged, probed = own[:len(own) - aside], own[len(own) - aside:]
        ends = list_ends[merged].tolist()
        first = (list_ends - lengths)[merged].tolist()
        if not two:
            first = [bisect_right(entries, q, a, b) for a, b in zip(first, ends)]
        # Found sets are verified a few at a time, as a link may make the rest of the search needless.
        candidates = merge_lists(entries, first, ends, least - aside)
        size = 1
        while batch := list(islice(candidates, size)):
            size *= 2
            mine = components.root(q)
            fresh = [x for x in batch if every or components.root(x[0]) != mine]
            linked = verified(q, fresh, probed) if fresh else []
            for other in linked:
                if every or components.root(other) != components.root(q):
                    components.join(q, other)
                    links.append((min(q, other), max(q, other)))
            if linked and not every and int((~all_connected(own, q)).sum()) < least:
                break
    return links
