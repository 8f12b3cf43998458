"""What a worker holds at a time while it reads texts."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from postweave.llm import line_quality, ngram_join, queries
from postweave.llm.piece_encoding import PieceCodec


@pytest.fixture(scope="module")
def column():
    # Four million bytes in many texts, as a batch may bring.
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(2000)]
    return pa.array([" ".join(rng.choices(words, k=300)) for _ in range(2200)])


def peak_mb(work):
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def test_encoding_holds_arrays_of_a_small_slice(column):
    codec = PieceCodec(queries.vocabulary("piece_bpe_32k.model"))
    assert peak_mb(lambda: [len(ids) for _, _, ids, *_ in codec.encode_arrays(column)]) < 40


def test_line_metrics_hold_arrays_of_a_small_slice(column):
    assert peak_mb(lambda: line_quality.count_metrics(column)) < 40


def test_shingles_hold_arrays_of_a_small_slice(column):
    assert peak_mb(lambda: [len(s) for s in ngram_join.shingle_sets(column)]) < 40
