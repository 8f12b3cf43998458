"""Vector columns are ``array<float>``; arithmetic is done in double precision."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

# Distances are rounded to this many decimals before they are ranked, so that equal
# vectors tie exactly whatever the order of summation.
RANK_DECIMALS = 9

# Tokens handed to an encoder at a time; bounds the memory of one output batch.
TOKENS_PER_BATCH = 100_000

HASH_DIMENSIONS = 32


def dot(a: Column, b: Column) -> Column:
    """Inner product of two vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length of a vector."""
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine; NULL if either vector is zero."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def not_zero(a: Column) -> Column:
    """True if a vector has a direction: finite components that are not all zero.

    NULL components make it false.
    """
    finite = F.forall(a, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(F.exists(a, lambda x: x != 0) & finite, F.lit(False))


def mean_vector(vectors: Column) -> Column:
    """Component-wise mean of an array of vectors; NULL for an empty array."""
    first = F.get(vectors, F.lit(0))
    zeros = F.transform(first, lambda _: F.lit(0.0))
    count = F.size(vectors)
    total = F.aggregate(vectors, zeros,
                        lambda acc, v: F.zip_with(acc, v, lambda s, x: s + x.cast("double")))
    return F.when(count > 0, F.transform(total, lambda s: s / count))


def finish_vector(vectors: Column) -> Column:
    """The first vector of an array as an ML vector."""
    return array_to_vector(F.get(vectors, F.lit(0)))


def hash_encoder() -> Callable[[list[str]], np.ndarray]:
    """A token encoder that needs no model: the bytes of the token's SHA-256, scaled to [-1, 1]."""

    def encode(batch: list[str]) -> np.ndarray:
        raw = b"".join(hashlib.sha256(t.encode("utf-8")).digest() for t in batch)
        codes = np.frombuffer(raw, dtype=np.uint8).reshape(len(batch), HASH_DIMENSIONS)
        return ((codes.astype(np.float64) - 127.5) / 127.5).astype(np.float32)

    return encode


def hashed_vector(token: Column) -> Column:
    """The vector of ``hash_encoder`` for one token, as doubles."""
    codes = F.sha2(token.cast("binary"), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(HASH_DIMENSIONS - 1)), lambda i: (
        F.conv(F.substring(codes, i * 2 + 1, F.lit(2)), 16, 10).cast("double") - 127.5) / 127.5)


def embed_tokens(df: DataFrame, encoder: Callable[[], Callable] = hash_encoder,
                 tokens: str = "token", output: str = "word_embeddings") -> DataFrame:
    """Add the vector of every token.

    ``encoder`` is a factory called once per Python worker; what it returns maps a list of distinct
    tokens to a float matrix. The step is narrow, has no vocabulary on the driver, and only
    the tokens are sent to Python. Vectors come back in batches of about ``TOKENS_PER_BATCH`` tokens, however
    many rows and words come in at once.
    """

    @F.arrow_udf("array<array<float>>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _vector_batches(batches, encoder())

    return df.withColumn(output, embed(tokens))


def mean_of_tokens(tokens: Column, encoder: Callable[[], Callable] = hash_encoder) -> Column:
    """The mean of the vectors of all tokens, without a column of these; NULL for an empty array."""

    @F.arrow_udf("array<double>")
    def mean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _mean_batches(batches, encoder())

    return mean(tokens)


def _mean_batches(batches: Iterator[pa.Array], encode, limit: int = TOKENS_PER_BATCH) -> Iterator[pa.Array]:
    for column in batches:
        for part in _cut_by_length(column, limit):
            vectors = _token_vectors(part, encode)
            sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            filled = np.flatnonzero(sizes)
            flat = vectors.flatten()
            width = len(flat.flatten()) // len(flat) if len(flat) else 0
            matrix = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), width)
            starts = (np.cumsum(sizes) - sizes)[filled]
            means = np.add.reduceat(matrix, starts) / sizes[filled, None] if len(filled) else matrix
            offsets = np.r_[0, np.cumsum(np.where(sizes > 0, width, 0))].astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(means.ravel()), mask=pa.array(sizes == 0))


def _vector_batches(batches: Iterator[pa.Array], encode, limit: int = TOKENS_PER_BATCH) -> Iterator[pa.Array]:
    """The vectors of all rows; only their number must agree, so each part goes back before the next is made."""
    for column in batches:
        for part in _cut_by_length(column, limit):
            yield _token_vectors(part, encode)


def _cut_by_length(column: pa.Array, limit: int) -> Iterator[pa.Array]:
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    groups = np.cumsum(lengths) // limit
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else []
    for start, end in zip(starts, [*starts[1:], len(groups)]):
        yield column.slice(start, end - start)


def _token_vectors(column: pa.Array, encode) -> pa.Array:
    flat = column.flatten().fill_null("").dictionary_encode()
    offsets = np.zeros(len(column) + 1, dtype=np.int32)
    np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), out=offsets[1:])
    words = flat.dictionary.to_pylist()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    table = np.asarray(encode(words), dtype=np.float32) if words else np.zeros((0, 1), np.float32)
    values = table[codes]
    inner_offsets = np.arange(len(codes) + 1, dtype=np.int32) * values.shape[1]
    inner = pa.ListArray.from_arrays(pa.array(inner_offsets), pa.array(values.ravel()))
    return pa.ListArray.from_arrays(pa.array(offsets), inner, mask=column.is_null())
