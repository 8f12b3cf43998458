"""Column helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# A side of a join is sent to every executor up to this many rows.
BROADCAST_ROWS = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed value: the white space of all contracts, for trimming.
SPACES = " \t\n\x0b\x0c\r"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER))


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it is counted to have no more than ``most`` rows.

    Beyond that Spark joins it by shuffling. ``df`` should be a stored table.
    """
    return F.broadcast(df) if df.count() <= most else df
