"""Scans of arriving files, and a gate per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import scan_files
from ..operators.report import gate, staged, stored_form
from ..options import ScanOptions
from ..rules import RuleSet


def stream_findings(files: DataFrame, rules: RuleSet | None = None, opts: ScanOptions | None = None) -> DataFrame:
    """The main plan over a stream of files.  It is row-local, so it keeps no
    state and needs no watermark."""
    return scan_files(files, rules, opts)


def write_findings(
    files: DataFrame, out: str, checkpoint: str, rules: RuleSet | None = None, opts: ScanOptions | None = None
) -> StreamingQuery:
    """Append the findings of newly arrived files; stops when all are done."""
    return (
        stored_form(stream_findings(files, rules, opts))
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def gate_files(
    files: DataFrame,
    threshold: float | None = None,
    rules: RuleSet | None = None,
    opts: ScanOptions | None = None,
    clean: bool = False,
) -> DataFrame:
    """Verdict per change over ``files(change_id, path, text)``.

    With ``clean`` a change without findings has a row too, not blocked and
    with null confidence; else it has none.
    """
    found = gate(scan_files(staged(files), rules, opts, walk=False), threshold)
    if not clean:
        return found
    every = files.select("change_id").distinct().join(found, "change_id", "left")
    return every.select(
        "change_id",
        F.coalesce("findings", F.lit(0)).alias("findings"),
        "max_confidence",
        F.coalesce("blocked", F.lit(False)).alias("blocked"),
    )


def write_verdicts(
    files: DataFrame,
    out: str,
    checkpoint: str,
    threshold: float | None = None,
    rules: RuleSet | None = None,
    opts: ScanOptions | None = None,
    clean: bool = False,
) -> StreamingQuery:
    """Write each micro-batch's verdicts to a folder of its own; see ``gate_files``.

    A repeated batch overwrites its folder, so a restart counts nothing twice.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        gate_files(batch, threshold, rules, opts, clean).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        files.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def verdicts(spark: SparkSession, out: str) -> DataFrame:
    """The verdict per change over all batches so far."""
    return (
        spark.read.parquet(out)
        .groupBy("change_id")
        .agg(
            F.sum("findings").alias("findings"),
            F.max("max_confidence").alias("max_confidence"),
            F.bool_or("blocked").alias("blocked"),
        )
    )
