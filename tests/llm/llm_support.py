"""Small documents with every awkward case, and helpers for comparing rows."""

import random
import re

EXTRA = "rows bigint, salt int, word string, position int, score double, ids binary, n_lines bigint, label string"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"
WORDS = re.compile(rb"[^\x20\x09-\x0d]+")


def documents(spark, texts, lang="en", first=0):
    """One row per text, with columns whose names clash with those the operators use."""
    rows = [(first + i, t, lang if isinstance(lang, str) or lang is None else lang[i],
             f"src{i % 3}" if i % 7 else None, None if t is None else len(t),
             1, 2, "w", 3, 0.5, b"x", 9, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sentence(rng, size, words=40):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(size))


AWKWARD = [
    None, "", " ", "\n", "\n\n", "a", "a b", "A\tB\x0bC\x0cD\rE", "é É ß", "▁x  y ", "x" * 5000,
    "漢字 かな 😀", "same line\nsame line\nother", "same line\nsame line\nother", "\x00 nul", "1 2 3", " nbsp ",
    "tail ", " lead", "line\r\nline\r\n",
]


def mixed_texts(seed=1, size=60):
    """Awkward texts, random ones, exact copies, near copies and one long text."""
    rng = random.Random(seed)
    base = sentence(rng, 120)
    texts = list(AWKWARD)
    for i in range(size):
        kind = i % 6
        if kind == 0:
            texts.append(sentence(rng, rng.randrange(1, 90)))
        elif kind == 1:
            texts.append(base)
        elif kind == 2:
            words = base.split()
            words[rng.randrange(len(words))] = f"new{i}"
            texts.append(" ".join(words))
        elif kind == 3:
            texts.append("Common Line.\n" + sentence(rng, 30) + "\n  common line.  ")
        elif kind == 4:
            texts.append(" ".join(base.split()[:rng.randrange(3, 120)]))
        else:
            texts.append("\n".join(sentence(rng, 6, 8) for _ in range(5)))
    texts.append("\n".join(sentence(rng, 8, 500) for _ in range(1500)))
    return texts


def rows_of(frame):
    return [r.asDict() for r in frame.collect()]


def by_id(frame):
    found = {}
    for row in rows_of(frame):
        assert row["doc_id"] not in found or found[row["doc_id"]] == row
        found[row["doc_id"]] = row
    return found
