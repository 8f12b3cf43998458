"""Brute force versions of the neighbour join, and small data for them."""

import random

import numpy as np

SCHEMA = "id bigint, sentence_embeddings array<float>, time_bucket int"


def sees(mode, a, b, first):
    if mode == "reference":
        return b in (a, a + 1) or (b == first and a == first + 1)
    return {"symmetric": abs(a - b) <= 1, "same_bucket": a == b, "all": True}[mode]


def brute_force(rows, n, mode, max_distance=None, fresh=None):
    usable = [(i, np.asarray(v, np.float64), b) for i, v, b in rows if any(v)]
    first = min((b for _, _, b in usable), default=0)
    result = {}
    for i, v, b in usable:
        if fresh is not None and i not in fresh:
            continue
        found = []
        for j, w, c in usable:
            if i != j and (fresh is not None or sees(mode, b, c, first)):
                d = round(1 - float(v @ w) / float(np.linalg.norm(v) * np.linalg.norm(w)), 9)
                if max_distance is None or d < max_distance:
                    found.append((d + 0.0, j))
        if found:
            result[i] = sorted(found)[:n]
    return result


def as_dict(df):
    return {r["id"]: [(x["cosine_distance"], x["id_2"]) for x in r["neighbors"]] for r in df.collect()}


def same(ours, theirs):
    assert ours.keys() == theirs.keys()
    for key, found in theirs.items():
        assert [x[1] for x in ours[key]] == [x[1] for x in found], key
        assert np.allclose([x[0] for x in ours[key]], [x[0] for x in found], atol=2e-9)


def clustered(seed, size, buckets, copies=0.0, dims=6):
    """Posts around a few directions; a share of them are copies of one vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    rows = []
    for i in range(size):
        v = centres[rng.integers(5)] + rng.normal(scale=0.2, size=dims)
        if rng.random() < copies:
            v = centres[0]
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(buckets))))
    random.Random(seed).shuffle(rows)
    return rows


def near_copies(seed, size, jitter, buckets=1, dims=6):
    """Posts that differ from one of four directions by very little."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    return [(i, [float(np.float32(x)) for x in centres[i % 4] + rng.normal(scale=jitter, size=dims)],
             int(rng.integers(buckets))) for i in range(size)]
