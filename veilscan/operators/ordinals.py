"""Places of rows within their key, and lists cut by them, whatever the size of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .joins import fits_broadcast


def ordinals(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Add ``ordinal``: the 0-based place of a row among those of its ``by``.

    One key may own a third of all rows, so its rows are not brought
    together.  A range sort by (key, order) cuts them over many partitions;
    the sorted rows are written once, which fixes the partitions; then a row's
    place is the count of the key's rows in earlier partitions plus its place
    in its own, both of which come from one small row per partition and key.
    """
    keys = [by, *order]
    # Range bounds come from a sample, so the input is read twice; writing the
    # rows first keeps the plan behind them from running twice.
    rows = checkpointed(rows).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = checkpointed(rows.withColumn("seat", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("seat", 33))
    blocks = rows.groupBy(by, "part").agg(F.min("seat").alias("first_seat"), F.count("*").alias("n"))
    before = checkpointed(blocks_before(blocks, by))
    if fits_broadcast(before):
        before = F.broadcast(before)
    return (
        rows.join(before, [by, "part"])
        .withColumn("ordinal", F.col("before") + F.col("seat") - F.col("first_seat"))
        .drop("seat", "part", "before", "first_seat")
    )


def blocks_before(blocks: DataFrame, by: str) -> DataFrame:
    """How many rows of the key lie in earlier partitions: one row per
    partition and key goes in, however many rows there are."""
    earlier = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    return blocks.select(by, "part", "first_seat", before.alias("before"))


def chunks(rows: DataFrame, by: str, order: list[str], entry: Column, most: int) -> DataFrame:
    """``by, chunk, entries``: the rows of each key in order, at most ``most`` to a list.

    Chunks are numbered from 0, and all but the last of a key are full.
    """
    if most < 1:
        raise ValueError("a chunk needs room for a row")
    placed = ordinals(rows, by, order)
    chunk = F.floor(F.col("ordinal") / most).alias("chunk")
    told = F.array_sort(F.collect_list(F.struct(F.col("ordinal"), entry.alias("entry"))))
    lists = placed.groupBy(by, chunk).agg(told.alias("told"))
    return lists.select(by, "chunk", F.transform("told", lambda t: t["entry"]).alias("entries"))
