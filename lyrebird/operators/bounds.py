"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side that is broadcast by hand, at most.
MOST_ROWS = 10_000


def small(df: DataFrame, what: str, most: int = MOST_ROWS) -> DataFrame:
    """The frame, to be broadcast, after a check that it has at most ``most`` rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"{what}: more than {most} rows, too many to broadcast")
    return F.broadcast(df)


def broadcast_if_small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has at most ``most`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
