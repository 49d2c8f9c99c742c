"""Findings store and logs.  No token is ever written."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.report import stored_form

FINDING_SCHEMA = (
    "path string, line int, column int, snippet string, rule string, confidence double, "
    "remediation string, found_at timestamp"
)
MIGRATION_SCHEMA = (
    "path string, line int, old_value_redacted string, env_var_name string, migrated_at timestamp"
)
OVERRIDE_SCHEMA = "ts timestamp, reason string, findings_bypassed int, user string"
VERSION = "version="


def _folder(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.exists(p)


def _versions(spark: SparkSession, path: str, finished: bool) -> list[int]:
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    names = [n for n in names if n.startswith(VERSION)]
    if finished:
        names = [n for n in names if exists(spark, f"{path}/{n}/_SUCCESS")]
    return sorted(int(n.removeprefix(VERSION)) for n in names)


def save_findings(findings: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the store in one step.

    The new state is written beside the old one; readers take the newest
    version whose commit marker exists, so they see the old or the new store
    and never a part.
    """
    spark = findings.sparkSession
    version = max(_versions(spark, path, finished=False), default=0) + 1
    stored_form(findings).write.format(fmt).save(f"{path}/{VERSION}{version:09d}")


def load_findings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The newest finished version; an empty table where there is none."""
    versions = _versions(spark, path, finished=True)
    if not versions:
        return spark.createDataFrame([], FINDING_SCHEMA)
    return spark.read.schema(FINDING_SCHEMA).format(fmt).load(f"{path}/{VERSION}{versions[-1]:09d}")


def append_log(rows: DataFrame, path: str, schema: str) -> None:
    """Append rows of exactly this schema; anything else is an error."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([], schema).schema
    names = wanted.fieldNames()
    if sorted(rows.columns) != sorted(names):
        raise ValueError(f"expected the columns {names}, got {rows.columns}")
    if exists(spark, path):
        try:
            found = spark.read.parquet(path).schema.fieldNames()
        except AnalysisException as e:
            raise ValueError(f"{path} is not a log table") from e
        if found != names:
            raise ValueError(f"{path} holds the columns {found}, not {names}")
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields]
    rows.select(*typed).write.mode("append").parquet(path)


def load_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def log_migrations(plan: DataFrame, path: str, migrated_at: str | None = None) -> None:
    """Append the plan's rows, stamped with one time."""
    at = F.current_timestamp() if migrated_at is None else F.lit(migrated_at).cast("timestamp")
    append_log(
        plan.select(
            "path",
            "line",
            F.col("value_redacted").alias("old_value_redacted"),
            "env_var_name",
            at.alias("migrated_at"),
        ),
        path,
        MIGRATION_SCHEMA,
    )


def migration_log(spark: SparkSession, path: str) -> DataFrame:
    return load_log(spark, path, MIGRATION_SCHEMA)


def log_stamps(log: DataFrame) -> DataFrame:
    """One row: how many migrations, when the log began and was last written."""
    return log.agg(
        F.count("*").alias("migrations"),
        F.min("migrated_at").alias("created_at"),
        F.max("migrated_at").alias("last_updated"),
    )


def log_overrides(rows: DataFrame, path: str) -> None:
    """Append bypass records; a record without a user counts as unknown."""
    user = F.coalesce(F.nullif(F.col("user"), F.lit("")), F.lit("unknown"))
    append_log(rows.withColumn("user", user), path, OVERRIDE_SCHEMA)


def override_log(spark: SparkSession, path: str) -> DataFrame:
    return load_log(spark, path, OVERRIDE_SCHEMA)


def overrides_by_user(log: DataFrame) -> DataFrame:
    return log.groupBy("user").agg(
        F.count("*").alias("overrides"),
        F.sum("findings_bypassed").alias("findings_bypassed"),
        F.min("ts").alias("first_at"),
        F.max("ts").alias("last_at"),
    )
