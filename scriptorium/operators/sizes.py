"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 200_000


def is_small(df: DataFrame, rows: int = ROWS) -> bool:
    """Whether df holds at most ``rows`` rows; counting stops there."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """df marked for broadcast if it holds at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if is_small(df, rows) else df
