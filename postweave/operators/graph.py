"""Topic graph: integrity, degrees, connected components and topic summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from postweave.operators.joins import HOT_ROWS, hot_keys, salted_join
from postweave.storage import discard, materialize


def dangling_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with an endpoint that is not a vertex."""
    known = vertices.select("id")
    lost_src = edges.join(known, edges["src"] == known["id"], "left_anti")
    present = edges.join(known, edges["src"] == known["id"], "left_semi")
    return lost_src.unionByName(present.join(known, present["dst"] == known["id"], "left_anti"))


def undirected_edges(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, without repetitions."""
    pair = edges.select("src", "dst")
    back = pair.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return pair.unionByName(back).dropDuplicates()


def in_degrees(edges: DataFrame) -> DataFrame:
    """Edges per destination."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))


def cut_edges(scored: DataFrame) -> DataFrame:
    """The edges the classifier accepts."""
    return scored.filter(F.col("prediction") == 1)


def connected_components(vertices: DataFrame, edges: DataFrame,
                         hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(id, component)`` with the smallest id of its component for every vertex.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), which keep
    components, never add edges, and end in stars around the smallest ids. Minima are
    combined map-side and popular vertices are salted, so no task sees a whole star.
    Edge directions, repetitions and loops do not matter; edges to unknown vertices
    are ignored.
    """
    ids = vertices.select("id").distinct()
    # Repetitions go first: what is left of a popular vertex is as many rows as it has neighbours.
    known = edges.select("src", "dst").distinct()
    for end, other in (("src", "dst"), ("dst", "src")):
        known = salted_join(known, ids.select(F.col("id").alias(end)), end, other,
                            hot_keys(edges, end, hot_rows), hot_rows=hot_rows)
    stars = component_stars(known, hot_rows)
    return ids.join(stars, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component"))


def component_stars(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(id, component)`` for all endpoints but the smallest of each component.

    Each round's table is deleted when its successor is complete.
    """
    links = materialize(_downward(edges.select(
        F.col("src").alias("high"), F.col("dst").alias("low"))), "links")
    before = _fingerprint(links)
    while True:
        # Among no more than hot_rows links, no vertex can have more.
        salted = before[0] > hot_rows
        renewed = materialize(
            _small_star(_large_star(links, salted, hot_rows), salted, hot_rows), "links")
        discard(links)
        links = renewed
        # Equal sets of links have equal fingerprints; a fixed point is a set of stars.
        now = _fingerprint(links)
        if now == before:
            return links.select(F.col("high").alias("id"), F.col("low").alias("component"))
        before = now


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(
        F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())


def _downward(links: DataFrame) -> DataFrame:
    return links.filter(F.col("high") != F.col("low")).select(
        F.greatest("high", "low").alias("high"), F.least("high", "low").alias("low")).distinct()


def _large_star(links: DataFrame, salted: bool, hot_rows: int) -> DataFrame:
    """Connect the larger neighbours of every vertex to its smallest neighbour or itself."""
    upward = links.select(F.col("low").alias("at"), F.col("high").alias("to"))
    both = upward.unionByName(links.select(F.col("high").alias("at"), F.col("low").alias("to")))
    star = both.groupBy("at").agg(F.min("to").alias("to"), F.count("*").alias("rows"))
    least = star.select("at", F.least("at", "to").alias("least"))
    hot = star.filter(F.col("rows") > hot_rows) if salted else None
    joined = salted_join(upward, least, "at", "to", hot, hot_rows=hot_rows) if salted else upward.join(least, "at")
    return joined.select(F.col("to").alias("high"), F.col("least").alias("low")).distinct()


def _small_star(links: DataFrame, salted: bool, hot_rows: int) -> DataFrame:
    """Connect every vertex and its smaller neighbours to the smallest of these."""
    star = links.groupBy("high").agg(F.min("low").alias("least"), F.count("*").alias("rows"))
    least = star.select("high", "least")
    hot = star.filter(F.col("rows") > hot_rows) if salted else None
    joined = salted_join(links, least, "high", "low", hot, hot_rows=hot_rows) if salted else links.join(least, "high")
    return _downward(joined.select(F.col("low").alias("high"), F.col("least").alias("low")).unionByName(
        least.select("high", F.col("least").alias("low"))))


def topic_summary(components: DataFrame, vertices: DataFrame) -> DataFrame:
    """Per component: size, most frequent label (ties to the smaller) and its share."""
    counts = (
        components.join(vertices.select("id", "label"), "id")
        .groupBy("component", "label").agg(F.count("*").alias("posts"))
    )
    ranked = Window.partitionBy("component").orderBy(F.desc("posts"), F.asc_nulls_last("label"))
    sized = counts.groupBy("component").agg(F.sum("posts").alias("size"))
    top = counts.withColumn("place", F.row_number().over(ranked)).filter("place = 1").drop("place")
    return sized.join(top, "component").select(
        "component", "size", F.col("label").alias("majority_label"),
        (F.col("posts") / F.col("size")).alias("purity"))


def vertex_labels(vertices: DataFrame, index: DataFrame) -> DataFrame:
    """The label index of every vertex; NULL for labels outside the index."""
    joined = salted_join(vertices.select("id", "label"), index, "label", "id", how="left")
    return joined.select("id", "label", "label_idx")
