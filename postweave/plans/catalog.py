"""Every registered query: a Spark plan over the given tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postweave import storage
from postweave.functions import dates as D
from postweave.functions import text as T
from postweave.functions import vectors as V
from postweave.operators import elements, graph, joins, learn, metrics, neighbors, rows, vector_index, word_space
from postweave.plans import offline
from postweave.sources import colocated, derive, tables
from postweave.storage import materialize, scratch_path
from postweave.streaming import event_time, ingest
from postweave.streaming.forest import ForestStream
from postweave.streaming.sample import StreamSample
from postweave.streaming.online import ComponentStream, NeighborStream, TopicStream, WindowComponents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Distance below which the queries' rule accepts an edge.
CLOSE = 0.72
# Neighbours per post.
N = 12
# Search distance of the thresholded neighbours.
REACH = 0.8
# Bucket that starts the new batch of the online queries.
NEW_BUCKET = 5


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return derive.vectors(spark, folder)


def _posts(spark: SparkSession, folder: str) -> DataFrame:
    return derive.posts(spark, folder)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return derive.table(spark, folder, "documents")


def _near(posts: DataFrame, n: int = N, mode: str = "reference") -> DataFrame:
    return neighbors.explode_neighbors(neighbors.nearest_neighbors(posts, n, mode))


def _stored(posts: DataFrame) -> DataFrame:
    """The neighbour edges as a table, for plans that read them more than once."""
    return materialize(_near(posts), "near")


def _rounded(edges: DataFrame, *distances: str) -> DataFrame:
    return edges.withColumns({d: F.round(d, 6) for d in distances or ("sentence_distance",)})


def _joined(items: Column) -> Column:
    return F.array_join(items, " ")


def _checksum(vectors: Column) -> Column:
    """Sum over all vectors of their components, weighted by position."""
    def weighted(v: Column) -> Column:
        terms = F.transform(v, lambda x, i: x.cast("double") * (i + 1))
        return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.round(F.aggregate(vectors, F.lit(0.0), lambda s, v: s + weighted(v)), 4)


def _rule(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("sentence_distance") < CLOSE)


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _posts(spark, folder).select("id", T.tokens(F.col("text")).alias("token"))


# Sources

@query
def load_posts(spark, folder):
    return tables.load_posts(spark, f"{folder}/documents.parquet",
                             ["doc_id", "text", "lang", "source", "n_chars"])


@query
def labelled_ids(spark, folder):
    path = scratch_path(spark, "label-files")
    _documents(spark, folder).select(
        F.concat("source", F.lit(".ids")).alias("label"), F.col("doc_id").cast("string").alias("id"),
    ).write.partitionBy("label").text(path)
    return tables.labelled_ids(spark, path, excluded="src0.ids")


def _listed(spark, folder):
    return derive.table(spark, folder, "labels").select(
        F.concat(F.lit("quality-"), F.col("quality").cast("string")).alias("label"),
        F.col("doc_id").cast("string").alias("id"))


@query
def saved_posts(spark, folder):
    path = scratch_path(spark, "saved")
    tables.save_posts(_posts(spark, folder), path, "label")
    return tables.load_posts(spark, path, ["id", "label", "year", "month", "day", "text"])


@query
def reloaded_stage(spark, folder):
    path = scratch_path(spark, "stage")
    storage.load_or_compute(spark, path, lambda: _posts(spark, folder).select("id", "label"))
    # The second call must find the stage that the first one wrote.
    return storage.load_or_compute(spark, path, lambda: _posts(spark, folder).filter("false"))


@query
def local_rows(spark, folder):
    counts = rows.label_counts(_posts(spark, folder)).collect()
    return tables.rows_to_frame(spark, [tuple(r) for r in counts], "label string, posts bigint")


@query
def hydrate_posts(spark, folder):
    return joins.hydrate(_listed(spark, folder), _posts(spark, folder)).select(
        "label", "id", "year", "month", "day", "text")


@query
def keyword_search(spark, folder):
    posts = _posts(spark, folder)
    at = F.make_date("year", "month", "day").cast("timestamp_ntz")
    return tables.keyword_search(posts, F.col("text"), at, "tion", "2014-06-30").select(
        "id", "year", "month", "day")


# Projections, filters, sampling

@query
def relabel_posts(spark, folder):
    posts = _posts(spark, folder)
    cleaned = posts.withColumns(T.clean_post(F.col("text")))
    return joins.relabel(cleaned, _listed(spark, folder)).drop("text")


@query
def has_hashtags(spark, folder):
    return rows.has_hashtags(_vectors(spark, folder)).select(
        "id", F.size("hashtags_embeddings").alias("n_hashtags"))


@query
def hash_sample(spark, folder):
    return rows.hash_sample(_posts(spark, folder), 0.05).select("id", "label")


@query
def sample_n(spark, folder):
    return rows.sample_n(_posts(spark, folder), 100).select("id", "label")


@query
def split_edges(spark, folder):
    return rows.split_edges(_near(_vectors(spark, folder))).select("src", "dst", "split")


@query
def slice_rows(spark, folder):
    return rows.slice_rows(_posts(spark, folder), 20, 70).select("id", "label")


@query
def vertices(spark, folder):
    return rows.vertices(_posts(spark, folder))


# Text and tokens

@query
def clean_urls(spark, folder):
    return _posts(spark, folder).select("id", T.collapse_urls(F.col("text")).alias("text"))


@query
def strip_repost(spark, folder):
    return _posts(spark, folder).select("id", T.strip_repost(F.col("text")).alias("text"))


@query
def extract_hashtags(spark, folder):
    return _posts(spark, folder).select("id", T.hashtags(F.col("text")).alias("hashtags"))


@query
def split_hashtag(spark, folder):
    names = F.regexp_extract_all("text", F.lit(T.HASHTAG), F.lit(1))
    return _posts(spark, folder).select(
        "id", F.array_join(F.transform(names, T.split_hashtag), "|").alias("words"))


@query
def mask_mentions(spark, folder):
    text = F.col("text")
    return _posts(spark, folder).select(
        "id", T.mask_mentions(text).alias("text"), T.mentions(text).alias("mentions"))


@query
def clean_post(spark, folder):
    posts = _posts(spark, folder).withColumns(T.clean_post(F.col("text")))
    return posts.select("id", "text", "hashtags", "mentions")


@query
def sentences(spark, folder):
    return _posts(spark, folder).select(
        "id", F.posexplode(T.sentences(F.col("text"))).alias("position", "sentence"))


@query
def tokens(spark, folder):
    return _tokens(spark, folder).select(
        "id", F.size("token").alias("n_tokens"), _joined(F.col("token")).alias("tokens"))


@query
def language_id(spark, folder):
    posts = learn.count_trigrams(_posts(spark, folder), ["id", "lang"])
    model = learn.fit_language_model(posts.filter(~_held_out()))
    found = materialize(learn.detect_language(model, posts).select(
        "id", "lang", "language"), "languages")
    storage.discard(posts)
    unseen = found.filter(_held_out())
    return _with_quality(found, _accuracy(unseen, "lang", "language"), "accurate", 0.9).select(
        "id", "lang", "accurate")


@query
def count_vectors(spark, folder):
    """Vectors of all words from their neighbours; those of frequent words lie with their language."""
    posts = _posts(spark, folder)
    tokens = materialize(posts.select("lang", T.tokens(F.col("text")).alias("token")), "tokens")
    vectors = materialize(word_space.count_vectors(tokens), "words")
    counts = materialize(tokens.select("lang", F.explode("token").alias("token")).groupBy("token", "lang").agg(
        F.count("*").alias("n")), "counts")
    words = counts.groupBy("token").agg(
        F.sum("n").alias("n"), F.max_by("lang", "n").alias("lang"), F.max("n").alias("most"))
    found = materialize(words.join(vectors.withColumnRenamed("word", "token"), "token", "left"), "embedded")
    # Words of one language only, that occur often.
    frequent = found.filter("n >= 20 AND most = n").filter(V.not_zero(F.col("vector"))).select(
        F.col("lang").alias("cluster"), F.col("vector").alias("sentence_embeddings"))
    placed = _with_quality(found, _in_closest_cluster(frequent), "apart", 0.7)
    return placed.select("token", "n", F.col("vector").isNotNull().alias("embedded"), "apart")


@query
def token_positions(spark, folder):
    token = F.col("token")

    def positions(pattern: str) -> Column:
        return _joined(T.token_positions(token, pattern).cast("array<string>"))

    return _tokens(spark, folder).select(
        "id", positions(T.HASHTAG_TOKEN).alias("hashtag_idxs"),
        positions(T.MENTION_TOKEN).alias("mentions_idxs"),
        positions(T.PUNCTUATION_TOKEN).alias("punctuation_idxs"))


@query
def replace_tokens(spark, folder):
    return _tokens(spark, folder).select("id", _joined(
        T.replace_tokens(F.col("token"), T.HASHTAG_TOKEN, "-")).alias("tokens"))


@query
def select_by_index(spark, folder):
    token = F.col("token")
    return _tokens(spark, folder).select("id", _joined(T.select_by_index(
        token, T.token_positions(token, T.PUNCTUATION_TOKEN))).alias("tokens"))


@query
def remove_by_index(spark, folder):
    token = F.col("token")
    return _tokens(spark, folder).select("id", _joined(T.remove_by_index(
        token, T.token_positions(token, T.PUNCTUATION_TOKEN))).alias("tokens"))


@query
def hashtag_tokens(spark, folder):
    return _tokens(spark, folder).select(
        "id", _joined(T.hashtag_tokens(F.col("token"))).alias("hashtags"))


@query
def text_with_info(spark, folder):
    text = F.col("text")
    return _posts(spark, folder).select("id", T.text_with_info(
        text, F.col("year"), F.col("month"), F.col("day"), T.hashtags(text), T.mentions(text),
    ).alias("text_with_info"))


# Vectors

@query
def word_vectors(spark, folder):
    # Only the vocabulary is embedded.
    words = _tokens(spark, folder).select(F.explode("token").alias("word"))
    vocabulary = words.groupBy("word").agg(F.count("*").alias("n"))
    # Few bytes but much work per word: adaptive execution would leave it to a few tasks.
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    embedded = V.embed_tokens(vocabulary.repartition(parts, "word").withColumn("token", F.array("word")))
    return embedded.select(
        F.col("word").alias("token"), "n", _checksum(F.col("word_embeddings")).alias("checksum"))


@query
def sentence_vectors(spark, folder):
    embedded = V.embed_tokens(_tokens(spark, folder))
    return embedded.select(
        "id", _checksum(F.array(V.mean_vector(F.col("word_embeddings")))).alias("checksum"))


@query
def hashtag_vectors(spark, folder):
    embedded = V.embed_tokens(_tokens(spark, folder))
    picked = T.select_by_index(
        F.col("word_embeddings"), T.token_positions(F.col("token"), T.HASHTAG_TOKEN))
    return embedded.select("id", F.size(picked).alias("n"), _checksum(picked).alias("checksum"))


@query
def drop_punctuation_vectors(spark, folder):
    embedded = V.embed_tokens(_tokens(spark, folder))
    left = T.remove_by_index(
        F.col("word_embeddings"), T.token_positions(F.col("token"), T.PUNCTUATION_TOKEN))
    return embedded.select("id", F.size(left).alias("n"), _checksum(left).alias("checksum"))


@query
def finished_vectors(spark, folder):
    posts = _vectors(spark, folder)
    finished = V.finish_vector(F.array("sentence_embeddings"))
    return posts.select("id", _checksum(F.array(learn.vector_to_array(finished))).alias("checksum"))


# Dates and buckets

@query
def day_ordinal(spark, folder):
    date = D.parts_to_date(F.col("year"), F.col("month"), F.col("day"))
    return _posts(spark, folder).select("id", D.date_ordinal(date).alias("day_ordinal"))


@query
def date_bucket(spark, folder):
    text_parts = _posts(spark, folder).withColumns(
        {c: F.col(c).cast("string") for c in ("year", "month", "day")})
    return D.with_time_bucket(text_parts).select("id", "day_ordinal", "time_bucket")


@query
def width_bucket(spark, folder):
    return _vectors(spark, folder).select(
        "id", D.width_bucket(F.col("day_ordinal"), 30).alias("bucket"))


@query
def date_parts(spark, folder):
    events = derive.table(spark, folder, "events")
    return D.with_date_parts(events, "ts").select("event_id", "year", "month", "day")


# Candidates, distances and neighbours

@query
def bucket_pairs(spark, folder):
    return neighbors.candidate_counts(_vectors(spark, folder), "reference")


@query
def same_bucket_pairs(spark, folder):
    return neighbors.candidate_counts(_vectors(spark, folder), "same_bucket")


@query
def symmetric_pairs(spark, folder):
    return neighbors.candidate_counts(_vectors(spark, folder), "symmetric")


@query
def threshold_pairs(spark, folder):
    found = neighbors.nearest_neighbors(_vectors(spark, folder), N, "all", max_distance=REACH)
    return _rounded(neighbors.explode_neighbors(found))


def _arrivals(spark, folder):
    posts = _vectors(spark, folder)
    fresh = F.col("time_bucket") >= NEW_BUCKET
    return posts.filter(fresh), posts.filter(~fresh)


@query
def online_pairs(spark, folder):
    batch, buffer = _arrivals(spark, folder)
    return neighbors.online_candidate_counts(batch, buffer)


@query
def close_pairs(spark, folder):
    """For every post the posts of its candidate buckets below a distance, counted by the join itself."""
    return neighbors.counts_within(_vectors(spark, folder), CLOSE)


@query
def close_pairs_same_bucket(spark, folder):
    return neighbors.counts_within(_vectors(spark, folder), CLOSE, "same_bucket")


@query
def online_close_pairs(spark, folder):
    batch, buffer = _arrivals(spark, folder)
    return neighbors.online_counts_within(batch, buffer, CLOSE)


@query
def online_neighbors(spark, folder):
    batch, buffer = _arrivals(spark, folder)
    return _rounded(neighbors.explode_neighbors(neighbors.nearest_in_buffer(batch, buffer, N)))


@query
def cosine_distance(spark, folder):
    posts = _vectors(spark, folder).select("id", F.col("sentence_embeddings").alias("a"))
    following = posts.select((F.col("id") - 1).alias("id"), F.col("a").alias("b"))
    return posts.join(following, "id").select(
        "id", F.round(V.cosine_distance(F.col("a"), F.col("b")), 6).alias("cosine_distance"))


@query
def nearest_neighbors(spark, folder):
    return _rounded(_near(_vectors(spark, folder)))


# Rows of a block in the query that cuts buckets into many.
SMALL_BLOCK = 64


@query
def nearest_neighbors_blocks(spark, folder):
    """Every post and a copy that is off by very little, with buckets of many blocks."""
    posts = _vectors(spark, folder).select("id", "sentence_embeddings", "time_bucket")
    vector = F.transform("sentence_embeddings", lambda x, i: (
        x + F.when(i == F.col("id") % 64, 1e-4).otherwise(0.0)).cast("float"))
    near = posts.select((F.col("id") + 1_000_000).alias("id"), vector.alias("sentence_embeddings"), "time_bucket")
    found = neighbors.nearest_neighbors(posts.unionByName(near), N, "same_bucket", block_rows=SMALL_BLOCK)
    return _rounded(neighbors.explode_neighbors(found))


@query
def nearest_neighbors_symmetric(spark, folder):
    return _rounded(_near(_vectors(spark, folder), mode="symmetric"))


@query
def nearest_neighbors_same_bucket(spark, folder):
    return _rounded(_near(_vectors(spark, folder), mode="same_bucket"))


@query
def knn_all(spark, folder):
    return _rounded(_near(_vectors(spark, folder), 3, "all"))


@query
def approx_neighbors(spark, folder):
    posts = _vectors(spark, folder)
    found = materialize(neighbors.explode_neighbors(neighbors.approximate_neighbors(posts, N, tables=16, band=2)), "approx")
    exact = _near(posts, N, "all")
    shared = exact.join(found.select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left")
    recall = shared.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")))
    sizes = found.groupBy(F.col("src").alias("id")).agg((F.count("*") <= N).alias("within"))
    return _with_quality(sizes, recall, "recalled", 0.9)


@query
def most_similar(spark, folder):
    return neighbors.most_similar(_vectors(spark, folder), 10)


@query
def similar_to_vector(spark, folder):
    posts = _vectors(spark, folder)
    mean = posts.agg(*(F.avg(F.get("sentence_embeddings", F.lit(i))) for i in range(64))).first()
    return neighbors.similar_to_vector(posts, list(mean)).select("id", "label", "text", "similarity")


def _closest(spark, folder, column, k):
    posts = _vectors(spark, folder)
    edges = elements.attach_endpoints(_stored(posts), posts, [column])
    best = elements.closest_elements(k)(column, column + "_2").alias("best")
    couples = F.transform("best.couples", lambda c: F.concat_ws(
        "-", c["first"].cast("string"), c["second"].cast("string")))
    return edges.select("src", "dst", best).select(
        "src", "dst", F.round("best.distance", 6).alias("distance"),
        _joined(couples).alias("couples"))


@query
def closest_words(spark, folder):
    return _closest(spark, folder, "word_embeddings", 3)


@query
def closest_hashtags(spark, folder):
    return _closest(spark, folder, "hashtags_embeddings", 9)


@query
def attach_arrays(spark, folder):
    posts = _vectors(spark, folder)
    attached = elements.attach_endpoints(_stored(posts), posts, ["word_embeddings"])
    return attached.select(
        "src", "dst", _checksum(F.col("word_embeddings")).alias("checksum"),
        _checksum(F.col("word_embeddings_2")).alias("checksum_2"))


# Aggregations

@query
def neighbor_lists(spark, folder):
    found = neighbors.nearest_neighbors(_vectors(spark, folder), N)
    ids = F.transform("neighbors", lambda x: x["id_2"].cast("string"))
    total = F.aggregate("neighbors", F.lit(0.0), lambda s, x: s + x["cosine_distance"])
    return found.select("id", _joined(ids).alias("ids"), F.round(total, 6).alias("total"))


@query
def label_counts(spark, folder):
    return rows.label_counts(_posts(spark, folder)).withColumnRenamed("count", "posts")


@query
def neighbor_histogram(spark, folder):
    found = neighbors.nearest_neighbors(_vectors(spark, folder), N)
    return neighbors.neighbor_histogram(found).withColumnRenamed("count", "posts")


@query
def describe_posts(spark, folder):
    stats = rows.describe(_vectors(spark, folder), ["id", "day_ordinal", "time_bucket", "label"])
    return stats.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@query
def in_degrees(spark, folder):
    return graph.in_degrees(_near(_vectors(spark, folder)))


def _ruled(spark, folder):
    posts = _vectors(spark, folder)
    labelled = learn.edge_labels(_stored(posts), rows.vertices(posts))
    return labelled.withColumn(
        "prediction", (F.col("sentence_distance") < CLOSE).cast("int"))


@query
def confusion(spark, folder):
    result = metrics.confusion(_ruled(spark, folder))
    return result.withColumns(
        {c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


@query
def auroc(spark, folder):
    scored = materialize(_ruled(spark, folder).select("label", "sentence_distance"), "scored")
    return metrics.auroc(scored, -F.col("sentence_distance")).select(F.round("auroc", 6).alias("auroc"))


@query
def precision_recall(spark, folder):
    """Precision and recall for every distance that edges could be cut at."""
    scored = _ruled(spark, folder).select("label", "sentence_distance")
    curve = metrics.precision_recall(scored, 1 - F.col("sentence_distance") / 2)
    return curve.withColumns({c: F.round(c, 6) for c in ("threshold", "precision", "recall")})


@query
def row_index(spark, folder):
    return rows.row_index(_posts(spark, folder).select("id", "label"))


@query
def union_posts(spark, folder):
    batch, buffer = _arrivals(spark, folder)
    columns = ["id", "label", "time_bucket"]
    return rows.union_posts(batch.select(*columns), buffer.select(*reversed(columns)))


# Graph

def _edges(spark, folder):
    posts = _vectors(spark, folder)
    return elements.proximity_edges(_stored(posts), posts)


@query
def proximity_edges(spark, folder):
    return _rounded(_edges(spark, folder).drop("relationship"), *learn.FEATURES)


@query
def edge_labels(spark, folder):
    posts = _vectors(spark, folder)
    return _rounded(learn.edge_labels(_stored(posts), rows.vertices(posts)))


def _indexed(spark, folder) -> tuple[vector_index.VectorIndex, DataFrame]:
    """An index of all vectors, and the queries: every fiftieth of them."""
    posts = _vectors(spark, folder).select("id", "sentence_embeddings")
    return vector_index.build(posts, scratch_path(spark, "index")), posts.filter(F.col("id") % 50 == 0)


@query
def indexed_exact(spark, folder):
    """The nearest of all posts by the index, with all its cells searched."""
    index, asked = _indexed(spark, folder)
    found = vector_index.search(index, asked, exact=True)
    return found.select(F.col("query").alias("src"), F.col("id").alias("dst"),
                        F.round("distance", 6).alias("sentence_distance"))


@query
def indexed_neighbors(spark, folder):
    """Queries by codes, with as many cells as a sample of other posts needs."""
    index, asked = _indexed(spark, folder)
    posts = _vectors(spark, folder).select("id", "sentence_embeddings")
    sample = rows.sample_n(posts, 100)
    probes = vector_index.probes_for_recall(index, sample, least=0.95)
    found = materialize(vector_index.search(index, asked, probes=probes), "found")
    quality = vector_index.recall(found, vector_index.search(index, asked, exact=True))
    return _with_quality(found.select(F.col("query").alias("src")).distinct(), quality, "recalled", 0.9)


@query
def colocated_edges(spark, folder):
    """Edges with the labels of their sources and how many go out from each, from tables that meet without a shuffle."""
    posts = _vectors(spark, folder).select("id", "label")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = colocated.save(posts, colocated.fresh_name("posts"), "id", buckets)
    edges = colocated.save(_near(_vectors(spark, folder)), colocated.fresh_name("edges"), "src", buckets)
    labelled = colocated.attach(edges, stored, "src", ["label"], "_1")
    degrees = edges.groupBy("src").agg(F.count("*").alias("out_degree"))
    found = labelled.join(degrees.hint("merge"), "src")
    return found.select("src", "dst", F.col("label_1").alias("label"), "out_degree").withColumn(
        "unmoved", F.lit(colocated.shuffles(found) == 0))


@query
def undirected_edges(spark, folder):
    return graph.undirected_edges(_stored(_vectors(spark, folder)))


@query
def dangling_edges(spark, folder):
    posts = _vectors(spark, folder)
    return graph.dangling_edges(_stored(posts), rows.has_hashtags(posts)).select("src", "dst")


@query
def connected_components(spark, folder):
    posts = _vectors(spark, folder)
    return graph.connected_components(rows.vertices(posts), _rule(_stored(posts)))


@query
def topic_summary(spark, folder):
    posts = _vectors(spark, folder)
    topics = graph.connected_components(rows.vertices(posts), _rule(_stored(posts)))
    return graph.topic_summary(topics, rows.vertices(posts)).withColumn("purity", F.round("purity", 6))


@query
def label_index(spark, folder):
    return rows.label_index(_posts(spark, folder))


@query
def vertex_labels(spark, folder):
    posts = _posts(spark, folder)
    return graph.vertex_labels(rows.vertices(posts), rows.label_index(posts))


# Learning

def _learning_edges(spark, folder):
    """Labelled edges among the posts with hashtags, which have all three distances."""
    posts = rows.has_hashtags(_vectors(spark, folder))
    edges = materialize(elements.proximity_edges(_stored(posts), posts), "edges")
    return materialize(learn.edge_labels(rows.split_edges(edges), rows.vertices(posts)), "labelled")


def _with_quality(df: DataFrame, quality: DataFrame, name: str, least: float) -> DataFrame:
    """Add whether the single number of ``quality`` reaches ``least``."""
    measured = quality.first()[0]
    return df.withColumn(name, F.lit(measured is not None and measured >= least))


def _accuracy(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(guess)).cast("double")))


def _held_out(key: str = "id") -> Column:
    """A fifth of the posts that models are not trained on."""
    return F.pmod(F.col(key) * 7, F.lit(5)) == 3


@query
def score_edges(spark, folder):
    labelled = _learning_edges(spark, folder)
    model = learn.fit_edge_classifier(labelled.filter("split = 'train'"))
    scored = materialize(learn.score_edges(model, labelled, keep_probability=True), "scored")
    sides = scored.agg(F.avg(((F.col("probability") > 0.5) == (F.col("prediction") == 1)).cast("double")))
    return _with_quality(_rounded(scored, *learn.FEATURES), sides, "consistent", 1.0).select(
        "src", "dst", *learn.FEATURES, "label", "split", "consistent")


@query
def searched_classifier(spark, folder):
    """Edges scored by the best classifier of a small grid, written and read again."""
    labelled = _learning_edges(spark, folder)
    model, scores = learn.search_edge_classifier(
        labelled.filter("split = 'train'"), trees=(5, 10), depths=(3, 5))
    path = scratch_path(spark, "classifier")
    learn.save_model(model, path)
    again = learn.load_edge_classifier(path)
    test = labelled.filter("split = 'test'")
    first = learn.score_edges(model, test).select("src", "dst", "label", "prediction")
    second = learn.score_edges(again, test).select("src", "dst", F.col("prediction").alias("reloaded"))
    both = materialize(first.join(second, ["src", "dst"]), "reloaded")
    tried = F.lit(len(scores) == 4 and all(0 <= x <= 1 for x in scores))
    return _with_quality(both, _accuracy(both, "prediction", "reloaded"), "same", 1.0).select(
        "src", "dst", "label", "same", tried.alias("tried"))


# Recall that the threshold of the balanced classifier must reach on its training edges.
RECALL = 0.95


@query
def balanced_edges(spark, folder):
    """Edges scored by a forest with weighted labels and cut where it reaches a recall."""
    labelled = _learning_edges(spark, folder)
    train = materialize(learn.balanced_weights(labelled.filter("split = 'train'")), "weighted")
    totals = [r[0] for r in train.groupBy("label").agg(F.round(F.sum("weight"), 6).alias("total")).select("total").collect()]
    model = learn.fit_edge_classifier(train.drop("weight"), balanced=True)
    scored = materialize(learn.score_edges(model, labelled, keep_probability=True), "scored")
    known = scored.filter("split = 'train'")
    cut = metrics.threshold_for_recall(metrics.precision_recall(known, F.col("probability")), RECALL)
    reached = known.filter("label = 1").agg(F.avg((F.col("probability") >= cut - 1e-9).cast("double")))
    return _with_quality(scored, reached, "reached", RECALL).select(
        "src", "dst", "label", "split", "reached", F.lit(len(set(totals)) == 1).alias("balanced"))


@query
def cut_edges(spark, folder):
    """The edges that stay if a rule scores them, and whether those that a forest keeps are purer than all."""
    labelled = _learning_edges(spark, folder)
    model = learn.fit_edge_classifier(labelled.filter("split = 'train'"))
    scored = materialize(learn.score_edges(model, labelled), "scored")
    # Of the edges that stay, more are within a label than of all edges.
    share, before = (x.agg(F.avg("label")).first()[0] or 0.0 for x in (graph.cut_edges(scored), labelled))
    none_lost = scored.count() == labelled.count()
    ruled = labelled.withColumn("prediction", (F.col("sentence_distance") < CLOSE).cast("double"))
    return graph.cut_edges(ruled).select("src", "dst", "label").withColumns(
        {"all_scored": F.lit(none_lost), "purer": F.lit(share > before)})


@query
def classify_topics(spark, folder):
    posts = _vectors(spark, folder)
    model = learn.fit_topic_classifier(posts.filter(~_held_out()), posts)
    found = materialize(learn.classify_topics(model, posts), "classified")
    # The labels of the stored vectors are not predictable, so only the form is checked.
    labels = rows.label_counts(posts).count()
    known = found.agg(F.avg(F.col("prediction").isin(list(range(labels))).cast("double")))
    return _with_quality(found, known, "known", 1.0).select(
        "id", "label", F.col("label_idx").cast("int").alias("label_idx"), "known")


@query
def kmeans_topics(spark, folder):
    posts = _vectors(spark, folder)
    labels = rows.label_counts(posts).count()
    found = materialize(learn.kmeans_topics(posts, labels).select(
        "id", "label", "cluster", "sentence_embeddings"), "clusters")
    used = F.lit(found.agg(F.max("cluster")).first()[0] < labels)
    return _with_quality(found, _in_closest_cluster(found), "settled", 0.9).select(
        "id", "label", "settled", used.alias("in_range"))


def _in_closest_cluster(found: DataFrame) -> DataFrame:
    """The share of posts whose cluster's mean direction is the closest of all; clusters are few."""
    unit = F.transform("sentence_embeddings", lambda x: x / V.norm(F.col("sentence_embeddings")))
    means = learn.with_vector(found.withColumn("sentence_embeddings", unit)).groupBy("cluster").agg(
        learn.vector_to_array(learn.Summarizer.mean(F.col("features"))).alias("mean")).collect()
    gaps = [F.struct(V.cosine_distance(F.col("sentence_embeddings"), F.array(*map(F.lit, m["mean"]))),
                     F.lit(m["cluster"]).alias("cluster")) for m in means]
    closest = F.array_min(F.array(*gaps))["cluster"]
    return found.agg(F.avg((closest == F.col("cluster")).cast("double")))


@query
def assign_centroid(spark, folder):
    posts = _vectors(spark, folder)
    return learn.assign_centroid(posts, learn.label_centroids(posts))


@query
def pca3(spark, folder):
    axes = materialize(learn.pca(_vectors(spark, folder)), "axes")
    spread = axes.agg(*(F.var_samp(F.col("pc")[i]) for i in range(3)),
                      *(F.corr(F.col("pc")[i], F.col("pc")[j]) for i, j in ((0, 1), (0, 2), (1, 2))),
                      *(F.avg(F.col("pc")[i]) for i in range(3))).first()
    return axes.select("id", "label", F.size("pc").alias("components"),
                       F.lit(spread[0] >= spread[1] >= spread[2]).alias("in_order"),
                       F.lit(all(abs(c) < 1e-6 for c in spread[3:6])).alias("uncorrelated"),
                       F.lit(all(abs(m) < 1e-6 for m in spread[6:])).alias("centred"))


def _named_topics(topics: DataFrame, posts: DataFrame) -> DataFrame:
    """Whether topics are named after their smallest post and hold posts of the table only."""
    stored = materialize(topics, "topics")
    least = stored.groupBy("component").agg(F.min("id").alias("least"))
    well_named = least.filter(F.col("least") != F.col("component")).isEmpty()
    known = stored.join(posts, "id", "left_anti").isEmpty()
    return stored.select("id", F.lit(well_named).alias("well_named"), F.lit(known).alias("known"))


@query
def pca3_with_vector(spark, folder):
    """The axes of all posts and one more, their mean, which lies at the origin."""
    posts = _vectors(spark, folder)
    mean = posts.agg(*(F.avg(F.get("sentence_embeddings", F.lit(i))) for i in range(64))).first()
    extra = spark.createDataFrame([(-1, "new", [float(x) for x in mean])],
                                  "id bigint, label string, sentence_embeddings array<float>")
    axes = learn.pca(posts, extra)
    near = F.forall("pc", lambda x: F.abs(x) < 1e-4)
    return axes.select("id", "label", F.when(F.col("id") == -1, near).alias("at_origin"))


@query
def topics_of_texts(spark, folder):
    posts = _posts(spark, folder)
    spelled = materialize(ingest.enrich_posts(posts).select("token"), "tokens")
    encoder = learn.table_encoder(materialize(learn.fit_word_vectors(spelled), "words"))
    storage.discard(spelled)
    with storage.noted_tables() as made:
        vectors = materialize(offline.post_vectors(posts, encoder, spelled=True).select(
            "id", "label", "text", "time_bucket", "sentence_embeddings", "word_embeddings",
            "hashtags_embeddings"), "text-vectors")
    storage.discard(*made[:-1])
    return _named_topics(offline.topics_of(vectors, encoder=encoder), vectors.select("id"))


# Streams

# Micro-batches a table is cut into.
MICRO_BATCHES = 3


def _as_stream(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write a frame as files and read them as a stream of a few micro-batches."""
    spark = df.sparkSession
    path, files = scratch_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(files, key).write.parquet(path)
    return ingest.read_stream(spark, path, df.schema, -(-files // MICRO_BATCHES))


@query
def stream_ingest(spark, folder):
    stream = ingest.ingest_posts(_as_stream(_posts(spark, folder), "arrivals", "id"))
    path, checkpoint = scratch_path(spark, "ingested"), scratch_path(spark, "checkpoint")
    ingest.append_stream(stream, path, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).select("id", "label", "text")


@query
def stream_enrich(spark, folder):
    stream = ingest.enrich_posts(_as_stream(_posts(spark, folder), "arrivals", "id"))
    path, checkpoint = scratch_path(spark, "enriched"), scratch_path(spark, "checkpoint")
    ingest.append_stream(stream, path, checkpoint, "time_bucket").awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).select(
        "id", "text", "hashtags", "mentions", "time_bucket", F.size("token").alias("n_tokens"))


# Time buckets that arrive together in the neighbour stream.
ARRIVAL = 4


def _arrive(posts: DataFrame, online) -> None:
    """Let posts arrive in order of time, a few buckets at once."""
    spark, arrivals = posts.sparkSession, scratch_path(posts.sparkSession, "arrivals")
    first, last = posts.agg(F.min("time_bucket"), F.max("time_bucket")).first()
    for group in range(first // ARRIVAL, last // ARRIVAL + 1):
        # The stream stops when its input is used up and resumes from its checkpoint.
        part = posts.filter(F.floor(F.col("time_bucket") / ARRIVAL) == group)
        part.write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(posts.schema).parquet(arrivals)
        online.start(stream).awaitTermination()


# Every so many buckets, one arrives late.
LATE_STEP = 7


@query
def stream_neighbors(spark, folder):
    posts = _vectors(spark, folder).select("id", "sentence_embeddings", "time_bucket")
    found = NeighborStream(spark, scratch_path(spark, "online"), N, window=1)
    _arrive(posts, found)
    return _rounded(neighbors.explode_neighbors(found.neighbors()))


@query
def late_posts(spark, folder):
    """Every seventh bucket arrives again at the end, when it is too late for all but the newest."""
    posts = _vectors(spark, folder).select("id", "sentence_embeddings", "time_bucket")
    found = NeighborStream(spark, scratch_path(spark, "online"), N, window=1)
    found.update(posts, 0)
    again = F.pmod("time_bucket", F.lit(LATE_STEP)) == 0
    found.update(posts.filter(again).withColumn("id", F.col("id") + 1_000_000), 1)
    return found.late().select("id", "time_bucket")


@query
def stream_topics(spark, folder):
    posts = _vectors(spark, folder).select(
        "id", "sentence_embeddings", "word_embeddings", "hashtags_embeddings", "time_bucket")
    topics = TopicStream(spark, scratch_path(spark, "online"), _rule, N, window=1)
    _arrive(posts, topics)
    topics.finish()
    return topics.components()


@query
def stream_scored_topics(spark, folder):
    # The classifier learns from the earlier posts and cuts the edges of the later ones.
    fresh, early = _arrivals(spark, folder)
    fresh, early = rows.has_hashtags(fresh), rows.has_hashtags(early)
    edges = materialize(elements.proximity_edges(_stored(early), early), "edges")
    model = learn.fit_edge_classifier(learn.edge_labels(edges, rows.vertices(early)))
    topics = TopicStream(spark, scratch_path(spark, "online"), lambda found: graph.cut_edges(
        learn.score_edges(model, found)), N, window=1)
    _arrive(fresh.drop("label", "text", "day_ordinal"), topics)
    topics.finish()
    return _named_topics(topics.components(), fresh.select("id"))


@query
def stream_components(spark, folder):
    edges = _rule(_near(_vectors(spark, folder))).select("src", "dst")
    topics = ComponentStream(spark, scratch_path(spark, "online"))
    topics.start(_as_stream(edges, "arrivals", "src")).awaitTermination()
    return topics.components()


@query
def stream_forest(spark, folder):
    """The same components, kept as one pointer per vertex in the state of the stream."""
    edges = _rule(_near(_vectors(spark, folder))).select("src", "dst")
    forest = ForestStream(spark, scratch_path(spark, "forest"))
    forest.start(_as_stream(edges, "arrivals", "src")).awaitTermination()
    return forest.components()


@query
def stream_sample(spark, folder):
    """A sample of posts that arrive in some batches."""
    posts = _posts(spark, folder).select("id", "label")
    found = StreamSample(spark, scratch_path(spark, "sample"), posts.schema, 100)
    found.start(_as_stream(posts, "arrivals", "id"), scratch_path(spark, "checkpoint")).awaitTermination()
    return found.sample().select("id", "label")


# Buckets that arrive together in the window of components, and buckets that it looks back.
WINDOW_ARRIVAL, LOOK_BACK = 3, 2


@query
def window_components(spark, folder):
    """Components among the posts of the last buckets, after each of some batches of edges."""
    posts = _vectors(spark, folder).select("id", "time_bucket")
    edges = _rule(_stored(_vectors(spark, folder))).select("src", "dst")
    edges = edges.join(posts.select(F.col("id").alias("src"), F.col("time_bucket").alias("src_bucket")), "src").join(
        posts.select(F.col("id").alias("dst"), F.col("time_bucket").alias("dst_bucket")), "dst")
    edges = materialize(edges.withColumn("arrival", F.floor(
        F.greatest("src_bucket", "dst_bucket") / WINDOW_ARRIVAL).cast("int")), "dated-edges")
    found, results = WindowComponents(spark, scratch_path(spark, "online"), LOOK_BACK), []
    last = edges.agg(F.max("arrival")).first()[0]
    for number in range((last if last is not None else -1) + 1):
        found.update(edges.filter(F.col("arrival") == number), number)
        results.append(found.components().withColumn("batch", F.lit(number)))
    every = spark.createDataFrame([], "id bigint, component bigint, batch int")
    for result in results:
        every = every.unionByName(result)
    return every


# Streams by event time

# Windows and lateness of the event queries, and what they rank.
WINDOW, WINDOW_SECONDS, LATENESS = "6 hours", 6 * 3600, "1 day"
TOP = 3
# Days that arrive together; every so many events, one arrives with the last of them.
ARRIVAL_DAYS, STRAGGLERS = 8, 13


def _event_stream(spark, folder) -> tuple[DataFrame, event_time.TimelyStream, list]:
    """Events with their time and the number of the batch they arrive in, and a stream that parts them."""
    events = event_time.with_event_time(derive.table(spark, folder, "events"), "ts").select(
        "event_id", "user_id", "event_type", "value", "at")
    first = events.agg(F.min("at")).first()[0]
    days = F.floor((F.unix_micros("at") - F.unix_micros(F.lit(first))) / 86_400_000_000)
    group = F.floor(days / ARRIVAL_DAYS).cast("int")
    last = events.agg(F.max(group)).first()[0] or 0
    arriving = events.withColumn("arrival", F.when(
        F.pmod("event_id", F.lit(STRAGGLERS)) == 0, last).otherwise(group))
    return arriving, event_time.TimelyStream(spark, scratch_path(spark, "events"), WINDOW, LATENESS), list(range(last + 1))


def _run_events(spark, folder, build) -> tuple[DataFrame, event_time.TimelyStream]:
    """Let events arrive batch by batch and run an append-mode query on the timely ones after each."""
    events, timely, groups = _event_stream(spark, folder)
    arrivals, out = scratch_path(spark, "arrivals"), scratch_path(spark, "closed")
    checkpoint = scratch_path(spark, "checkpoint")
    for group in groups:
        events.filter(F.col("arrival") == group).drop("arrival").write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(events.drop("arrival").schema).parquet(arrivals)
        timely.start(stream).awaitTermination()
        result = build(timely.timely())
        event_time.append_closed(result, out, checkpoint).awaitTermination()
    return spark.read.schema(result.schema).parquet(out), timely


def _naive(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz")


@query
def event_windows(spark, folder):
    """Events of closed windows; late ones do not count."""
    found, _ = _run_events(spark, folder, lambda rows: event_time.window_totals(rows, WINDOW, "value", "event_type"))
    return found.select(_naive("window_start").alias("window_start"), "event_type", "events",
                        F.round("total", 2).alias("total"))


@query
def late_events(spark, folder):
    """Events that came after their window was closed."""
    events, timely, groups = _event_stream(spark, folder)
    for group in groups:
        timely.update(events.filter(F.col("arrival") == group).drop("arrival"), group)
    timely.schema = events.drop("arrival").schema
    return timely.late().select("event_id", _naive("at").alias("ts"))


@query
def event_candidates(spark, folder):
    """For each purchase the views and clicks of its user in the same window and the one before."""
    found, _ = _run_events(spark, folder, lambda rows: event_time.candidates_before(
        rows.filter("event_type = 'purchase'"), rows.filter("event_type IN ('view', 'click')"),
        WINDOW, "user_id", "event_id"))
    return found.groupBy("event_id", "user_id").agg(F.sum("candidates").alias("candidates"))


@query
def event_tops(spark, folder):
    """The largest values of every closed window and type."""
    found, _ = _run_events(spark, folder, lambda rows: event_time.top_of_windows(
        rows, WINDOW, TOP, "value", "event_id", "event_type"))
    return event_time.merge_tops(found, TOP, "value", "event_id", "event_type").withColumn(
        "window_start", _naive("window_start"))
