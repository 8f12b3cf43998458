"""A stored index of vectors that answers many queries at once.

Vectors are assigned to the nearest of some centroids, their cell, and what is left of a vector is quantised in parts, one byte
each. Centroids and code books are learned from a bounded sample (``SAMPLE`` vectors); every vector is indexed. The index
is a table partitioned by cell, with codes and vectors as columns of their own.

A search looks at the cells nearest to each query. Queries meet the codes of a cell in blocks of bounded size, by sums of
looked-up products; the ``spare`` times as many best as are wanted are then compared exactly, and only their
vectors are read. With ``exact`` all cells are searched by whole vectors, in the same blocks, and nothing is missed.

Vectors without a direction are not indexed, and queries without one find nothing. Distances are cosine distances,
ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postweave.functions.vectors import RANK_DECIMALS, cosine_distance, not_zero
from postweave.operators.rows import sample_n
from postweave.storage import materialize

# Vectors that centroids and code books are learned from.
SAMPLE = 20_000
CELLS, CODES, ROUNDS, SEED = 64, 256, 12, 3
# Rows and queries of a cell that meet in one task.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 1024
# Rows of one cell that go to one file.
FILE_ROWS = 1_000_000


def _lloyd(points: np.ndarray, count: int) -> np.ndarray:
    """Centres of some points by a few rounds of k-means, from a fixed choice of points."""
    rng = np.random.default_rng(SEED)
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:count]]
    for _ in range(ROUNDS):
        nearest = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        sizes = np.bincount(nearest, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each point."""
    squares = (centres * centres).sum(axis=1)
    found = np.empty(len(points), np.int64)
    for start in range(0, len(points), 8192):
        part = points[start:start + 8192]
        found[start:start + 8192] = (squares - 2 * part @ centres.T).argmin(axis=1)
    return found


def _unit_rows(column: pa.Array) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@dataclass(frozen=True)
class VectorIndex:
    """Where an index is stored, its centroids, and for each part of a vector the code book."""

    path: str
    centroids: np.ndarray
    books: list[np.ndarray]

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum([0, *(b.shape[1] for b in self.books)])

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell and the codes of unit vectors."""
        cells = _nearest(rows, self.centroids)
        left = rows - self.centroids[cells]
        codes = [_nearest(left[:, a:b], book) for a, b, book in zip(self.ends, self.ends[1:], self.books)]
        return cells, np.stack(codes, axis=1).astype(np.uint8)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("id bigint, code binary, vec array<float>, cell int").parquet(self.path)


def build(posts: DataFrame, path: str, cells: int = CELLS, parts: int = 16, sample: int = SAMPLE) -> VectorIndex:
    """Index ``posts(id, sentence_embeddings)`` below ``path``; codes have ``parts`` bytes."""
    rows = posts.select("id", F.col("sentence_embeddings").alias("vec")).filter(not_zero(F.col("vec")))
    known = sample_n(rows, sample).select("vec").toArrow()["vec"].combine_chunks()
    if not len(known):
        index = VectorIndex(path, np.zeros((1, 1)), [np.zeros((1, 1))])
    else:
        points = _unit_rows(known)
        centroids = _lloyd(points, cells)
        left = points - centroids[_nearest(points, centroids)]
        books = [_lloyd(part, CODES) for part in np.array_split(left, min(parts, points.shape[1]), axis=1)]
        index = VectorIndex(path, centroids, books)
    shared = posts.sparkSession.sparkContext.broadcast(index)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found, codes = shared.value.encode(_unit_rows(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1),
                     pa.array(found.astype(np.int32))], names=["id", "code", "vec", "cell"])

    encoded = materialize(rows.mapInArrow(encode, "id bigint, code binary, vec array<float>, cell int"), "encoded")
    # Rows of a cell that many vectors fall into are dealt to several files.
    sizes = F.broadcast(encoded.groupBy("cell").agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("files")))
    dealt = encoded.join(sizes, "cell").withColumn("file", F.pmod(F.xxhash64("id"), F.col("files")))
    dealt.repartition("cell", "file").select("id", "code", "vec", "cell").write.mode("overwrite").partitionBy(
        "cell").parquet(path)
    return index


def _probes(queries: DataFrame, index: VectorIndex, probes: int) -> DataFrame:
    """``(query, vec, cell)``: each query with its nearest cells."""
    shared = queries.sparkSession.sparkContext.broadcast(index.centroids)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, centres = _unit_rows(batch.column(1)), shared.value
                gaps = (centres * centres).sum(axis=1) - 2 * rows @ centres.T
                chosen = np.argsort(gaps, axis=1, kind="stable")[:, :probes].astype(np.int32)
                at = pa.array(np.repeat(np.arange(len(rows)), chosen.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(chosen.ravel())],
                    names=["query", "vec", "cell"])

    rows = queries.select(F.col("id").alias("query"), F.col("sentence_embeddings").alias("vec"))
    return rows.filter(not_zero(F.col("vec"))).mapInArrow(near, "query bigint, vec array<float>, cell int")


def _best_of_rows(queries: np.ndarray, ids: np.ndarray, distances: np.ndarray, keep: int) -> pa.Table:
    """The ``keep`` smallest distances of each row of a matrix, ties to the smaller id; ids are in order."""
    distances = np.round(distances, RANK_DECIMALS)
    order = np.argsort(distances, axis=1, kind="stable")[:, :keep]
    return pa.table({
        "query": pa.array(np.repeat(queries, order.shape[1]), pa.int64()),
        "id": pa.array(ids[order].ravel(), pa.int64()),
        "distance": pa.array(np.take_along_axis(distances, order, axis=1).ravel(), pa.float64())})


def _meet(rows: DataFrame, asked: DataFrame, index: VectorIndex, keep: int, exact: bool,
          block_rows: int, block_queries: int) -> DataFrame:
    """``(query, id, distance)``: of each block of a cell the best rows for each query."""
    stored = materialize(asked, "asked")
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    probes = stored.groupBy("cell").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("groups"))
    # At most one row per centroid, of which there are at most SAMPLE.
    both = F.broadcast(materialize(sizes.join(probes, "cell"), "cells"))
    ours = rows.join(both, "cell").select(
        *rows.columns, F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    theirs = stored.join(both, "cell").select(
        "query", "vec", "cell",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1)).alias("block"),
        F.pmod(F.xxhash64("query"), F.col("groups")).cast("int").alias("group"))
    empty = pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()),
                      "distance": pa.array([], pa.float64())})
    # Only the cell's own centroid and the code books are needed by a task.
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return empty
        left = left.sort_by("id")
        wanted = _unit_rows(right["vec"].combine_chunks())
        if exact:
            near = wanted @ _unit_rows(left["vec"].combine_chunks()).T
        else:
            by = shared.value
            codes = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(len(left), -1)
            near = np.repeat(wanted @ by.centroids[left["cell"][0].as_py()][:, None], len(left), axis=1)
            for k, (a, b, book) in enumerate(zip(by.ends, by.ends[1:], by.books)):
                near += (wanted[:, a:b] @ book.T)[:, codes[:, k]]
        return _best_of_rows(right["query"].to_numpy(), left["id"].to_numpy(), 1.0 - near, keep)

    key = ("cell", "block", "group")
    return ours.groupBy(*key).cogroup(theirs.groupBy(*key)).applyInArrow(
        compare, "query bigint, id bigint, distance double")


def _first(found: DataFrame, n: int) -> DataFrame:
    ranked = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= n)


def search(index: VectorIndex, queries: DataFrame, n: int = 10, probes: int = 16, spare: int = 8,
           exact: bool = False, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``(query, id, distance)``: the ``n`` nearest indexed vectors of each of ``queries(id, sentence_embeddings)``.

    A query's own row, if it is indexed, does not count.
    """
    table = index.table(queries.sparkSession)
    asked = _probes(queries, index, len(index.centroids) if exact else probes)
    if exact:
        found = _meet(table.select("id", "vec", "cell"), asked, index, n + 1, True, block_rows, block_queries)
        return _first(found.filter("query <> id"), n).drop("place")
    rough = _meet(table.select("id", "code", "cell"), asked, index, n * spare + 1, False, block_rows, block_queries)
    chosen = _first(rough.filter("query <> id"), n * spare).select("query", "id")
    wanted = queries.select(F.col("id").alias("query"), F.col("sentence_embeddings").alias("wanted"))
    both = chosen.join(table.select("id", "vec"), "id").join(wanted, "query")
    compared = both.select("query", "id", F.round(
        cosine_distance(F.col("wanted"), F.col("vec")), RANK_DECIMALS).alias("distance"))
    return _first(compared, n).drop("place")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row with the share of the true neighbours that were found."""
    hit = truth.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))


def probes_for_recall(index: VectorIndex, queries: DataFrame, n: int = 10, least: float = 0.9,
                      first: int = 8) -> int:
    """How many cells a search must look at to find a share of the true neighbours of some sample queries.

    Doubled from ``first`` until the recall against the exact search suffices, or all cells are looked at.
    """
    truth, probes = materialize(search(index, queries, n, exact=True), "truth"), first
    while probes < len(index.centroids):
        measured = recall(search(index, queries, n, probes), truth).first()[0]
        if measured is None or measured >= least:
            return probes
        probes *= 2
    return len(index.centroids)
