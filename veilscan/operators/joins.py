"""Joins whose small side is checked before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def fits_broadcast(keys: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most so many rows and bytes of text; reads no more rows than that."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in keys.columns), F.lit(0))
    n, total = keys.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return n <= rows and total <= size


def semi_join(left: DataFrame, keys: DataFrame, on: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``left`` whose key is listed.  A short list is broadcast, so
    ``left`` with its texts is not shuffled; a long one joins by shuffle."""
    keys = keys.select(on).distinct()
    if fits_broadcast(keys, rows):
        return left.join(F.broadcast(keys), on, "left_semi")
    return left.join(keys.hint("merge"), on, "left_semi")
