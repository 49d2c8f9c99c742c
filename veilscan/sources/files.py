"""Files and text tables as ``files(path, text)``."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import exclude_exact
from ..functions.text import decode_utf8, is_binary, universal_newlines
from ..operators.detect import scan_files
from ..options import ScanOptions
from ..rules import RuleSet
from ..session import checkpointed

BATCH_BYTES = 32 << 20
LISTED = 10_000


def file_system(path: str):
    """The file system of a path or URI, and the path inside it."""
    from pyarrow import fs as pafs

    return pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)


def dealt(paths: DataFrame, most: int | None = None) -> DataFrame:
    """Paths spread by hash over a fixed number of tasks, ``most`` at most.

    Paths are short, and what is done with them is not: without a number Spark
    would join their partitions to few by size.
    """
    spark = paths.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return paths.repartition(tasks if most is None else max(1, min(tasks, most)), "path")


def list_entries(dirs: DataFrame, skip_unreadable: bool = False) -> DataFrame:
    """The entries of each directory: ``path, is_dir, error``.

    Spark's own file sources pass over names that begin with a dot or an
    underscore, among them ``.env`` and ``__init__.py``, so directories are
    listed here, one row each.  Links to directories are not followed.  A
    directory that cannot be listed fails the job after Spark's retries, or is
    a row with an error.
    """

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        def of(folder: str) -> Iterator[tuple[str, bool, str | None]]:
            if ":" not in folder:
                with os.scandir(folder) as found:
                    for e in found:
                        if e.is_file() or not e.is_symlink():
                            yield e.path, e.is_dir(follow_symlinks=False), None
                return
            system, inner = pafs.FileSystem.from_uri(folder)
            for i in system.get_file_info(pafs.FileSelector(inner)):
                yield f"{folder}/{i.base_name}", i.type == pafs.FileType.Directory, None

        def rows() -> Iterator[tuple[str, bool, str | None]]:
            for batch in batches:
                for folder in batch["path"]:
                    try:
                        yield from of(folder)
                    except OSError as e:
                        if not skip_unreadable:
                            raise
                        yield folder, False, str(e)

        listed = rows()
        while part := list(islice(listed, LISTED)):
            yield pd.DataFrame(part, columns=["path", "is_dir", "error"])

    return dirs.select("path").mapInPandas(entries, "path string, is_dir boolean, error string")


def walk(spark: SparkSession, directory: str, patterns: tuple[str, ...], skip_unreadable: bool = False) -> DataFrame:
    """``path, error`` of every file below a directory that no pattern excludes.

    One round per level of the tree; an excluded directory is not listed at
    all.  Only paths are held, and each level is written once.  With
    ``skip_unreadable`` a directory that cannot be listed is a row with an
    error; else it fails the job.
    """
    local = re.sub("^file:/+", "/", directory)
    root = directory.rstrip("/") if ":" in local else os.path.abspath(local)
    level = spark.createDataFrame([(root,)], "path string")
    files = spark.createDataFrame([], "path string, error string")
    kept = ~exclude_exact(F.col("path"), patterns) | F.col("error").isNotNull()
    while folders := level.count():
        # A directory with very many entries is listed by one task; its
        # subdirectories are spread again before the next round.
        found = checkpointed(list_entries(dealt(level, folders), skip_unreadable).where(kept))
        files = files.union(found.where(~F.col("is_dir")).select("path", "error"))
        level = found.where("is_dir").select("path")
    return files


def read_bytes(paths: DataFrame, skip: type[OSError] | None = None) -> DataFrame:
    """``path, content, error``; an error of the kind ``skip`` gives a row with null content, others fail the job."""

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def load(path: str) -> tuple[bytes | None, str | None]:
            try:
                if ":" not in path:
                    with open(path, "rb") as f:
                        return f.read(), None
                system, inner = file_system(path)
                with system.open_input_stream(inner) as f:
                    return f.read(), None
            except OSError as e:
                if skip is None or not isinstance(e, skip):
                    raise
                return None, str(e)

        for batch in batches:
            rows, size = [], 0
            for path in batch["path"]:
                content, error = load(path)
                rows.append((path, content, error))
                size += len(content or b"")
                if size >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "content", "error"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    return paths.select("path").mapInPandas(contents, "path string, content binary, error string")


def read_texts(paths: DataFrame, skip: type[OSError] | None = None) -> DataFrame:
    """``path, text, error`` of the listed files; binary ones, by their bytes, are dropped.

    Paths are spread by hash first, so the files of one large directory are
    read by many tasks.
    """
    read = read_bytes(dealt(paths), skip)
    text = universal_newlines(decode_utf8(F.col("content")))
    return read.where(F.col("error").isNotNull() | ~is_binary(F.col("content"))).select("path", text.alias("text"), "error")


def read_files(paths: DataFrame) -> DataFrame:
    """``path, text`` of the listed files; missing and binary ones are dropped."""
    return read_texts(paths, FileNotFoundError).where("error IS NULL").select("path", "text")


def scan_directory(
    spark: SparkSession,
    directory: str,
    rules: RuleSet | None = None,
    opts: ScanOptions | None = None,
    skip_unreadable: bool = False,
) -> DataFrame:
    """Findings of all files below a directory.

    What cannot be listed or read fails the job, after Spark's retries; with
    ``skip_unreadable`` it is passed over, and ``unreadable`` lists it.
    """
    opts = opts or ScanOptions()
    paths = walk(spark, directory, opts.exclude_patterns, skip_unreadable).where("error IS NULL")
    texts = read_texts(paths, OSError if skip_unreadable else None).where("error IS NULL").select("path", "text")
    return scan_files(texts, rules, opts, walk=False, test_binary=False)


def unreadable(spark: SparkSession, directory: str, opts: ScanOptions | None = None) -> DataFrame:
    """``path, error`` of the directories and files below a directory that cannot be read now."""
    opts = opts or ScanOptions()
    paths = walk(spark, directory, opts.exclude_patterns, skip_unreadable=True)
    files = read_bytes(dealt(paths.where("error IS NULL")), OSError).where("error IS NOT NULL")
    return paths.where("error IS NOT NULL").union(files.select("path", "error"))


def write_tree(contents: DataFrame, directory: str) -> int:
    """Write ``contents(path, content)`` as files below a directory, from the tasks; how many were written."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = file_system(directory)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                system.create_dir(f"{base}/{os.path.dirname(path)}", recursive=True)
                with system.open_output_stream(f"{base}/{path}") as out:
                    out.write(content)
            yield pd.DataFrame({"written": [len(batch)]})

    done = contents.select("path", "content").mapInPandas(write, "written long")
    return done.agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0]


def scan_paths(
    spark: SparkSession,
    paths: list[str],
    rules: RuleSet | None = None,
    opts: ScanOptions | None = None,
) -> DataFrame:
    """Findings of the files listed; a missing one yields nothing."""
    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return scan_files(read_files(listed), rules, opts, walk=False, test_binary=False)
