"""Work on many small files is spread over tasks."""

import pytest
from pyspark.sql import functions as F

from veilscan.sources import files


@pytest.fixture
def tree(tmp_path):
    for i in range(60):
        (tmp_path / "src" / f"d{i}").mkdir(parents=True)
        (tmp_path / "src" / f"d{i}" / "a.txt").write_text(f"k = {i}\n")
    return tmp_path


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_folders_are_listed_by_several_tasks(spark, tree):
    found = files.walk(spark, str(tree), ())
    assert found.count() == 60 and tasks(found) > 1


def test_files_are_read_by_several_tasks(spark, tree):
    paths = spark.createDataFrame([(f"{tree}/src/d{i}/a.txt",) for i in range(60)], "path string")
    read = files.read_texts(paths)
    assert {r["text"] for r in read.collect()} == {f"k = {i}\n" for i in range(60)}
    assert tasks(read) > 1
