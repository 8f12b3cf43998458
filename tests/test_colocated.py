"""Stored tables that meet without a shuffle."""

import pytest
from pyspark.sql import functions as F

from postweave.operators import learn, rows
from postweave.sources import colocated as C


@pytest.fixture
def stored(spark):
    posts = spark.range(300).selectExpr("id", "concat('l', id % 7) label", "array(id) tags")
    edges = spark.range(2000).selectExpr("(id * 31) % 310 src", "(id * 17) % 300 dst", "id / 10.0 distance")
    names = [C.fresh_name(x) for x in ("posts", "edges")]
    yield C.save(posts, names[0], "id", 4), C.save(edges, names[1], "src", 4), posts, edges
    C.drop(spark, *names)


def test_joins_and_groupings_need_no_shuffle(stored):
    posts, edges, _, _ = stored
    joined = C.attach(edges, posts, "src", ["label", "tags"])
    assert C.shuffles(joined) == 0
    assert C.shuffles(joined.groupBy("src").agg(F.count("*"))) == 0
    plain = edges.join(posts.select(F.col("id").alias("dst"), "label").hint("merge"), "dst")
    assert C.shuffles(plain) > 0


def test_results_equal_those_of_plain_tables(stored):
    posts, edges, plain_posts, plain_edges = stored
    found = C.attach(edges, posts, "src", ["label"], "_1").select("src", "dst", "label_1")
    expected = plain_edges.join(plain_posts.select(F.col("id").alias("src"), "label"), "src", "left").select(
        "src", "dst", "label")
    assert sorted(found.collect(), key=str) == sorted(expected.collect(), key=str)
    assert found.filter("label_1 IS NULL").count() == plain_edges.filter("src >= 300").count()


def test_stored_tables_serve_the_operators(stored):
    posts, edges, plain_posts, plain_edges = stored
    ours = learn.edge_labels(edges.select("src", "dst"), posts)
    theirs = learn.edge_labels(plain_edges.select("src", "dst"), plain_posts)
    assert sorted(ours.collect()) == sorted(theirs.collect())
    assert rows.label_counts(posts).count() == 7


def test_saving_again_replaces_the_table(spark):
    name = C.fresh_name("Odd name!")
    assert C.save(spark.range(10), name, "id", 2).count() == 10
    assert C.save(spark.range(3), name, "id", 2).count() == 3
    C.drop(spark, name)
    assert not spark.catalog.tableExists(name)
