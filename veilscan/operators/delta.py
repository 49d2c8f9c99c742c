"""What changed between two scans, and what needs scanning again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .joins import semi_join

PLACE = ["path", "line", "rule", "column"]


def rescan_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each finding's place with ``resolved``, ``new`` or ``remaining``.

    One aggregation over both scans, with a map-side part, instead of two anti
    joins.
    """
    sides = before.select(*PLACE, F.lit(True).alias("old")).unionByName(
        after.select(*PLACE, F.lit(False).alias("old"))
    )
    seen = sides.groupBy(*PLACE).agg(
        F.bool_or("old").alias("was"), F.bool_or(~F.col("old")).alias("now")
    )
    status = F.when(~F.col("now"), "resolved").when(~F.col("was"), "new").otherwise("remaining")
    return seen.select(*PLACE, status.alias("status"))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def file_index(files: DataFrame) -> DataFrame:
    """``path, digest``: what an incremental scan remembers."""
    return files.select("path", digest(F.col("text")).alias("digest"))


def changed_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files that are new or differ from the index.

    Only (path, digest) is shuffled.  The texts are read a second time, which
    costs less than moving all of them, and only for the changed paths.
    """
    changed = file_index(files).join(seen.select("path", "digest"), ["path", "digest"], "left_anti")
    return semi_join(files, checkpointed(changed.select("path")), "path")
