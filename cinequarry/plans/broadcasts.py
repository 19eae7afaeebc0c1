"""Broadcasts of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that may be broadcast where a row is a few short values, at 64 bytes each or so.
MOST_ROWS = 500_000


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` marked to meet others in a shuffle, unless these are marked for broadcast.

    Spark goes by the size of files and shuffles; rows that compress well take
    a hundred times that in the driver.
    """
    return df.hint("merge")


def checked(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` (written, or cheap to count) marked for broadcast if it has so few rows (MOST_ROWS by default); beyond, it is shuffled."""
    rows = MOST_ROWS if rows is None else min(rows, MOST_ROWS)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else shuffled(df)
