"""Models on posts and edges, with MLlib."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression, RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import (
    PCA, IndexToString, Normalizer, StandardScaler, StringIndexer, VectorAssembler,
    Word2Vec)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from postweave.functions.vectors import (
    HASH_DIMENSIONS, RANK_DECIMALS, hash_encoder, hashed_vector, norm, not_zero)
from postweave.operators.joins import HOT_ROWS, hot_keys, salted_join
from postweave.operators.rows import row_index
from postweave.storage import materialize

FEATURES = ("sentence_distance", "word_distance", "hashtag_distance")

# Settings of the edge classifier and the other models.
SEED = 3
TREES = 30
DEPTH = 15
BINS = 32
TRAIN_RATIO = 0.8
TOPIC_TREES = 10
KMEANS_SEED = 1
WORD_DIMENSIONS = 32
COMPONENTS = 3

# Hashes of trigrams, and characters of texts that a task turns into trigrams at a time.
TRIGRAM_HASHES = 1 << 14
SLICE_CHARACTERS = 500_000

# Words that are trained at most: about 256 bytes of weights each on the driver, 77 MB in all.
MOST_WORDS = 300_000

# Centroids that are compared at a time: 1,000 x 768 doubles are 6 MiB.
BLOCK_CENTROIDS = 1000
# Centroids that are sent to every task, in bytes.
CENTROID_BYTES = 64_000_000


def edge_labels(edges: DataFrame, vertices: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``label``: 1 if both endpoints have the same label (or both none), else 0.

    Edges with an unknown endpoint are dropped. Popular endpoints on either side are spread over
    several tasks; they are counted in ``edges``, which should be a stored table.
    """
    ours = vertices.select(F.col("id").alias("src"), F.col("label").alias("src_label"))
    theirs = vertices.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    sources, targets = hot_keys(edges, "src", hot_rows), hot_keys(edges, "dst", hot_rows)
    joined = salted_join(edges, ours, "src", "dst", sources, hot_rows=hot_rows)
    joined = salted_join(joined, theirs, "dst", "src", targets, hot_rows=hot_rows)
    same = F.col("src_label").eqNullSafe(F.col("dst_label")).cast("int")
    return joined.withColumn("label", same).drop("src_label", "dst_label").select(
        *edges.columns, "label")


def edge_features(edges: DataFrame, count: int = len(FEATURES)) -> DataFrame:
    """Add the vector of the first ``count`` distances; edges that lack one are left out."""
    assembler = VectorAssembler(
        inputCols=list(FEATURES[:count]), outputCol="features", handleInvalid="skip")
    return assembler.transform(edges)


def balanced_weights(labelled: DataFrame) -> DataFrame:
    """Add ``weight``, so that edges within and between labels weigh the same in all."""
    counts = {r["label"]: r["edges"] for r in labelled.groupBy("label").agg(F.count("*").alias("edges")).collect()}
    total = sum(counts.values())
    weight = F.lit(None).cast("double")
    for label, edges in counts.items():
        weight = F.when(F.col("label") == label, total / (len(counts) * edges)).otherwise(weight)
    return labelled.withColumn("weight", weight)


def fit_edge_classifier(labelled: DataFrame, features: int = len(FEATURES), balanced: bool = False):
    """Fit a random forest that tells edges within a label from edges between labels.

    ``balanced`` weighs the edges of the rarer kind up; ``metrics.threshold_for_recall`` then finds where to cut.
    """
    forest = _forest().setNumTrees(TREES).setMaxDepth(DEPTH).setMaxBins(BINS)
    columns = ["features", "label"]
    if balanced:
        labelled, forest = balanced_weights(labelled), forest.setWeightCol("weight")
        columns.append("weight")
    data = edge_features(labelled, features).select(*columns).persist()
    try:
        return forest.fit(data)
    finally:
        data.unpersist()


def search_edge_classifier(labelled: DataFrame, features: int = len(FEATURES),
                           trees: tuple = (TREES,), depths: tuple = (DEPTH,),
                           bins: tuple = (BINS,), parallelism: int = 1):
    """``(model, scores)`` of a grid search by area under ROC on held-out edges.

    With a grid of one point the model is the same as from ``fit_edge_classifier``,
    which needs one fit instead of two.
    """
    forest = _forest()
    grid = (
        ParamGridBuilder().addGrid(forest.numTrees, trees)
        .addGrid(forest.maxDepth, depths).addGrid(forest.maxBins, bins).build()
    )
    search = TrainValidationSplit(
        estimator=forest, estimatorParamMaps=grid, trainRatio=TRAIN_RATIO, seed=SEED,
        evaluator=BinaryClassificationEvaluator(metricName="areaUnderROC"), parallelism=parallelism)
    data = edge_features(labelled, features).select("features", "label").persist()
    try:
        found = search.fit(data)
    finally:
        data.unpersist()
    return found.bestModel, found.validationMetrics


def _forest() -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="label", seed=SEED)


def score_edges(model: RandomForestClassificationModel, edges: DataFrame,
                features: int = len(FEATURES), keep_probability: bool = False) -> DataFrame:
    """Add ``prediction`` (and, if asked for, the ``probability`` of class 1) to any edges."""
    scored = model.transform(edge_features(edges, features))
    if keep_probability:
        scored = scored.withColumn("probability", vector_to_array("probability")[1])
    else:
        scored = scored.drop("probability")
    return scored.drop("rawPrediction", "features")


def least_count_within(tokens: DataFrame, column: str, least_count: int, most_words: int) -> int:
    """The smallest number from ``least_count`` that at most ``most_words`` words occur as often as.

    Words are counted by all tasks; what is collected are the different counts, of which ``n`` tokens
    have at most ``sqrt(2 n)``.
    """
    counts = tokens.select(F.explode(column).alias("word")).groupBy("word").agg(F.count("*").alias("rows"))
    sizes = counts.filter(F.col("rows") >= least_count).groupBy("rows").agg(F.count("*").alias("words")).collect()
    total = 0
    for rows, words in sorted(sizes, reverse=True):
        total += words
        if total > most_words:
            return rows + 1
    return least_count


def fit_word_vectors(tokens: DataFrame, column: str = "token", size: int = WORD_DIMENSIONS,
                     least_count: int = 5, partitions: int | None = None,
                     most_words: int = MOST_WORDS) -> DataFrame:
    """``(word, vector)`` of a skip-gram model trained on token arrays, as vectors of float arrays.

    Words with fewer than ``least_count`` occurrences have no vector. MLlib keeps the vocabulary on the
    driver: ``least_count`` is raised until it has no more than ``most_words`` words. All cores train
    side by side unless ``partitions`` says otherwise.
    """
    parts = partitions or tokens.sparkSession.sparkContext.defaultParallelism
    least = least_count_within(tokens, column, least_count, most_words)
    model = Word2Vec(inputCol=column, vectorSize=size, minCount=least, seed=SEED,
                     maxIter=1, numPartitions=parts).fit(tokens.select(column))
    return model.getVectors().select("word", vector_to_array("vector", "float32").alias("vector"))


def embed_by_table(posts: DataFrame, words: DataFrame, tokens: str = "token",
                   output: str = "word_embeddings", size: int = WORD_DIMENSIONS,
                   hash_unknown: bool = False) -> DataFrame:
    """Add the vector of every token from a stored ``words(word, vector)`` table, zeros for unknown words.

    With ``hash_unknown`` these get the vector of ``hash_encoder`` instead, at the mean length of the
    stored ones so that they do not outweigh them; every different word is hashed once. Frequent words are spread over
    several tasks. ``posts`` should be a stored table.
    """
    spelled = posts.select("id", F.posexplode(tokens).alias("position", "word"))
    hot = hot_keys(spelled, "word")
    other = F.array(*[F.lit(0.0).cast("float")] * size)
    if hash_unknown:
        length = words.agg(F.avg(norm(F.col("vector")))).first()[0] or 1.0
        unknown = spelled.filter(F.col("word").isNotNull()).select("word").distinct().join(words, "word", "left_anti")
        coded = materialize(unknown.select("word", hashed_vector(F.col("word")).alias("codes")), "unknown-words")
        words = words.select("word", "vector").unionByName(
            coded.select("word", _scaled(F.col("codes"), length).alias("vector")))
        # What is left are tokens that are null.
        other = _scaled(hashed_vector(F.lit("")), length)
    found = salted_join(spelled, words, "word", "id", hot, "left")
    vectors = found.groupBy("id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("position", F.coalesce("vector", other).alias("vector")))),
        lambda x: x["vector"]).alias(output))
    empty = F.array().cast("array<array<float>>")
    return posts.join(vectors, "id", "left").withColumn(output, F.coalesce(output, empty))


def table_encoder(words: DataFrame) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A token encoder from ``words(word, vector)`` of ``fit_word_vectors``, with the vectors of ``embed_by_table``.

    The table is sent to all tasks, so it should have no more than ``MOST_WORDS`` rows. Other words are hashed, at the mean length
    of its vectors.
    """
    length = words.agg(F.avg(norm(F.col("vector")))).first()[0] or 1.0
    table = words.select("word", "vector").toArrow().combine_chunks()
    known = table["word"].combine_chunks() if table.num_rows else pa.array([], pa.string())
    vectors = _rows_of(table["vector"]).astype(np.float32) if table.num_rows else np.zeros((0, HASH_DIMENSIONS), np.float32)
    shared = words.sparkSession.sparkContext.broadcast((known, vectors))

    def factory() -> Callable[[list[str]], np.ndarray]:
        known, vectors = shared.value
        hashed = hash_encoder()

        def encode(batch: list[str]) -> np.ndarray:
            place = pc.fill_null(pc.index_in(pa.array(batch, pa.string()), value_set=known), -1).to_numpy()
            found = np.zeros((len(batch), vectors.shape[1]), np.float32)
            found[place >= 0] = vectors[place[place >= 0]]
            other = np.flatnonzero(place < 0)
            if len(other):
                codes = hashed([batch[i] for i in other]).astype(np.float64)
                found[other] = codes * (length / np.linalg.norm(codes, axis=1, keepdims=True))
            return found

        return encode

    return factory


def _scaled(codes: Column, length: float) -> Column:
    """A vector at the given length."""
    return F.transform(codes, lambda x: (x * length / norm(codes)).cast("float"))


def save_model(model, path: str) -> None:
    """Write a fitted model, replacing an older one."""
    model.write().overwrite().save(path)


def load_edge_classifier(path: str) -> RandomForestClassificationModel:
    """Read a model written by ``save_model``."""
    return RandomForestClassificationModel.load(path)


def with_vector(posts: DataFrame, output: str = "features") -> DataFrame:
    """Add the sentence vector as an ML vector."""
    return posts.withColumn(output, array_to_vector("sentence_embeddings"))


def fit_topic_classifier(posts: DataFrame, labelled: DataFrame | None = None) -> PipelineModel:
    """A random forest from sentence vectors to labels; labels are indexed in sorted order.

    The labels are those of ``labelled``, if given: posts whose label is not among the training
    posts are then classified as well.
    """
    index = StringIndexer(inputCol="label", outputCol="label_idx",
                          stringOrderType="alphabetAsc", handleInvalid="skip")
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label_idx", numTrees=TOPIC_TREES, seed=SEED)
    indexed = index.fit(posts if labelled is None else labelled)
    return Pipeline(stages=[indexed, forest]).fit(with_vector(posts))


def classify_topics(model: PipelineModel, posts: DataFrame) -> DataFrame:
    """``(id, label, label_idx, prediction)`` for posts with a known label."""
    return model.transform(with_vector(posts)).select("id", "label", "label_idx", "prediction")


def kmeans_topics(posts: DataFrame, k: int) -> DataFrame:
    """Add the cluster of a cosine k-means with ``k`` centres; zero vectors are left out."""
    data = with_vector(posts.filter(not_zero(F.col("sentence_embeddings"))))
    model = KMeans(k=k, seed=KMEANS_SEED, featuresCol="features", predictionCol="cluster",
                   distanceMeasure="cosine").fit(data)
    return model.transform(data).drop("features")


def label_centroids(posts: DataFrame) -> DataFrame:
    """``(label, centroid, threshold)``: mean vector and mean distance to it, per label."""
    means = with_vector(posts).groupBy("label").agg(
        vector_to_array(Summarizer.mean(F.col("features"))).alias("centroid"))
    distance = euclidean(F.col("sentence_embeddings"), F.col("centroid"))
    narrow = posts.select("id", "label", "sentence_embeddings")
    return (
        salted_join(narrow, means, "label", "id").groupBy("label")
        .agg(F.avg(distance).alias("threshold"))
        .join(means, "label").select("label", "centroid", "threshold")
    )


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance of two vectors."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def assign_centroid(posts: DataFrame, centroids: DataFrame,
                    block_centroids: int = BLOCK_CENTROIDS, most_bytes: int = CENTROID_BYTES) -> DataFrame:
    """``(id, cluster)``: position of the first centroid, by label, within its threshold, else -1.

    There is one centroid per label, and any number of labels. Centroids of up to ``most_bytes`` are counted and sent to
    all tasks, and posts are compared where they lie; of more, posts are shuffled to blocks of centroids, and the smallest
    position of all blocks counts.
    """
    stored = materialize(centroids.filter(F.col("label").isNotNull()).select(
        "label", "centroid", "threshold"), "centroids")
    size = stored.agg(F.sum(F.size("centroid")).cast("long")).first()[0] or 0
    if size * 8 > most_bytes:
        return _assign_by_blocks(posts, stored, block_centroids)
    table = stored.orderBy("label").toArrow()
    reach = (_rows_of(table["centroid"]) if size else np.zeros((0, 1)),
             np.round(table["threshold"].to_numpy(), RANK_DECIMALS))
    shared = posts.sparkSession.sparkContext.broadcast(reach)

    def assign(batches):
        centres, limits = shared.value
        for batch in batches:
            found = _first_within(batch.column(1), centres, limits, np.arange(len(limits)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.where(found < _NOWHERE, found, -1).astype(np.int32))],
                names=["id", "cluster"])

    return posts.select("id", "sentence_embeddings").mapInArrow(assign, "id bigint, cluster int")


_NOWHERE = np.iinfo(np.int64).max


def _first_within(vectors, centres: np.ndarray, limits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each vector the smallest place of a centre whose limit it is within."""
    found = np.full(len(vectors), _NOWHERE)
    if len(vectors) and len(centres):
        points = _rows_of(vectors)
        for place, centre, within in zip(places, centres, limits):
            gap = points - centre
            distance = np.round(np.sqrt(np.einsum("ij,ij->i", gap, gap)), RANK_DECIMALS)
            found[distance < within] = np.minimum(found[distance < within], place)
    return found


def _assign_by_blocks(posts: DataFrame, centroids: DataFrame, block_centroids: int) -> DataFrame:
    placed = row_index(centroids, "label", "position").withColumn(
        "block", F.floor((F.col("position") - 1) / block_centroids).cast("int"))
    blocks = (placed.agg(F.max("block")).first()[0] or 0) + 1
    parts = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    rows = posts.select("id", "sentence_embeddings", part.alias("part"),
                        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    reach = placed.select(
        "position", "centroid", "threshold", "block",
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def nearest(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        limits = np.round(theirs["threshold"].to_numpy(), RANK_DECIMALS)
        centres = _rows_of(theirs["centroid"]) if len(theirs) else np.zeros((0, 1))
        found = _first_within(ours["sentence_embeddings"], centres, limits, theirs["position"].to_numpy() - 1)
        return pa.table({"id": ours["id"], "cluster": pa.array(found)})

    found = rows.groupBy("block", "part").cogroup(reach.groupBy("block", "part")).applyInArrow(
        nearest, "id bigint, cluster bigint")
    first = F.min("cluster")
    return found.groupBy("id").agg(
        F.when(first == F.lit(2**63 - 1), -1).otherwise(first).cast("int").alias("cluster"))


def _rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def pca(posts: DataFrame, extra: DataFrame | None = None, k: int = COMPONENTS) -> DataFrame:
    """``(id, label, pc)`` on the first ``k`` principal components of the centred vectors.

    ``extra`` posts, if given, take part in the fit and in the result.
    """
    both = posts.select("id", "label", "sentence_embeddings")
    if extra is not None:
        both = both.unionByName(extra.select("id", "label", "sentence_embeddings"))
    data = with_vector(both, "raw")
    centre = StandardScaler(inputCol="raw", outputCol="features", withStd=False, withMean=True)
    model = Pipeline(stages=[centre, PCA(k=k, inputCol="features", outputCol="pc")]).fit(data)
    return model.transform(data).select("id", "label", vector_to_array("pc").alias("pc"))


def fit_language_model(posts: DataFrame, features: int = TRIGRAM_HASHES) -> PipelineModel:
    """Logistic regression on hashed character trigrams of whole texts; needs ``lang``.

    ``posts`` may come from ``count_trigrams``, which is then not done again.
    """
    index = StringIndexer(inputCol="lang", outputCol="lang_idx",
                          stringOrderType="alphabetAsc", handleInvalid="skip")
    scaled = Normalizer(inputCol="counts", outputCol="features")
    model = LogisticRegression(
        featuresCol="features", labelCol="lang_idx", predictionCol="language_idx",
        probabilityCol="language_probability", rawPredictionCol="language_raw",
        maxIter=20, regParam=1e-3)
    fitted = Pipeline(stages=[index, scaled, model]).fit(_counted(posts, features))
    names = IndexToString(inputCol="language_idx", outputCol="language",
                          labels=fitted.stages[0].labels)
    return PipelineModel([*fitted.stages[1:], names])


def detect_language(model: PipelineModel, posts: DataFrame) -> DataFrame:
    """Add ``language`` to every post; ``posts`` may come from ``count_trigrams``."""
    return model.transform(_counted(posts, model.stages[1].numFeatures)).drop(
        "counts", "features", "language_raw", "language_probability", "language_idx")


def _counted(posts: DataFrame, features: int) -> DataFrame:
    return posts if "counts" in posts.columns else count_trigrams(posts, features=features)


def count_trigrams(posts: DataFrame, columns: list[str] | None = None, features: int = TRIGRAM_HASHES) -> DataFrame:
    """A stored table of ``columns`` (all) and ``counts``: how often each hash of three characters of the text occurs.

    The hashes are those of ``HashingTF`` over ``NGram``. Texts are read once, in slices of a bounded number of
    characters; a text that is null or shorter than three characters has no trigrams.
    """
    kept = posts.columns if columns is None else columns
    vector = VectorUDT()
    schema = StructType([*posts.select(*kept).schema.fields, StructField("counts", vector.sqlType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text_slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], _trigram_vectors(part.columns[-1], features)], names=[*kept, "counts"])

    texts = posts.select(*kept, F.lower("text").alias("lowered"))
    stored = materialize(texts.mapInArrow(run, schema), "trigrams")
    # Vectors are stored as structs, and read as what MLlib takes.
    counted = posts.sparkSession.read.schema(
        StructType([*schema.fields[:-1], StructField("counts", vector)])).parquet(stored.scratch)
    counted.scratch = stored.scratch
    return counted


def _text_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch by the characters of its last column, or single rows."""
    sizes = pc.fill_null(pc.utf8_length(batch.columns[-1]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    parts = np.cumsum(sizes) // SLICE_CHARACTERS
    starts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(parts) else []
    for start, end in zip(starts, [*starts[1:], len(parts)]):
        yield batch.slice(start, end - start)


def _trigram_vectors(texts: pa.Array, features: int) -> pa.Array:
    """One sparse vector per text, as MLlib stores it."""
    found = [x or "" for x in texts.to_pylist()]
    codes = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32).astype(np.int64)
    hashes = np.zeros(0, np.int32)
    if len(codes) > 2:
        # Also across texts; those are not read below.
        grams = pa.array(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]).dictionary_encode()
        hashes = _hash_trigrams(grams.dictionary.to_numpy(), features)[grams.indices.to_numpy()]
    indices, values, sizes = [], [], []
    start = 0
    for text in found:
        counts = np.bincount(hashes[start:start + max(0, len(text) - 2)], minlength=features)
        start += len(text)
        hit = np.flatnonzero(counts)
        indices.append(hit)
        values.append(counts[hit])
        sizes.append(len(hit))
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    joined = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (indices, values))
    return pa.StructArray.from_arrays([
        pa.array(np.zeros(len(found), np.int8)), pa.array(np.full(len(found), features, np.int32)),
        *(pa.ListArray.from_arrays(offsets, pa.array(x.astype(kind)))
          for x, kind in zip(joined, (np.int32, np.float64)))], names=["type", "size", "indices", "values"])


def _hash_trigrams(grams: np.ndarray, features: int) -> np.ndarray:
    """The index that ``HashingTF`` gives to three characters with spaces between them: MurmurHash3 of their UTF-8 bytes."""
    first, second, third = grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF
    space = np.full(len(grams), 32)
    spelled = np.column_stack([first, space, second, space, third]).astype(np.uint32)
    raw = np.char.encode(spelled.view("U5").ravel(), "utf-8").astype("S16").view(np.uint8).reshape(-1, 16)
    length = 2 + sum(1 + (x >= 0x80) + (x >= 0x800) + (x >= 0x10000) for x in (first, second, third))
    words = raw.view("<u4").astype(np.uint64)
    found, low = np.full(len(grams), 42, np.uint64), np.uint64(0xFFFFFFFF)

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by) | x >> np.uint64(32 - by)) & low

    def times(x: np.ndarray, by: int) -> np.ndarray:
        return x * np.uint64(by) & low

    for place in range(4):
        mixed = found ^ times(turned(times(words[:, place], 0xCC9E2D51), 15), 0x1B873593)
        whole, begun = length >= 4 * place + 4, length > 4 * place
        found = np.where(whole, times(turned(mixed, 13), 5) + np.uint64(0xE6546B64) & low,
                         np.where(begun, mixed, found))
    found = found ^ length.astype(np.uint64)
    found = times(found ^ found >> np.uint64(16), 0x85EBCA6B)
    found = times(found ^ found >> np.uint64(13), 0xC2B2AE35)
    # As a signed number, of which the modulo is not negative.
    return ((found ^ found >> np.uint64(16)).astype(np.uint32).view(np.int32) % features).astype(np.int32)
