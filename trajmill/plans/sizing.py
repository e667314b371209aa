"""Size checks behind the choice of a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

BROADCAST_ROWS = 500_000
TARGET_ROWS = 2_000_000


def fits_one_task(df: DataFrame, rows: int = TARGET_ROWS) -> bool:
    """Whether the *counted* rows of the plan, after explodes and joins, are at most ``rows``.

    A size estimate in bytes proves nothing: files compress, and it does not see what an explode makes.
    """
    return df.count() <= rows
