"""Tables in several parts, and plans that must not gather at the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilscan.llm import boosting, private
from veilscan.operators import history
from veilscan.plans import queries
from veilscan.plans.queries import QUERIES


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """``documents`` as a folder of part files."""
    folder = str(tmp_path_factory.mktemp("parts"))
    docs = spark.range(60).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("line one\nline two "), F.col("id").cast("string")).alias("text"),
        F.lit("en").alias("lang"),
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"),
        F.lit(20).cast("long").alias("n_chars"),
    )
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    return folder


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_stream_gate_reads_a_folder_of_parts(spark, parts):
    found = rows(QUERIES["str2_stream_gate"](spark, parts))
    assert len(found) == 3 and found == rows(QUERIES["agg8_gate"](spark, parts))


def test_ancestors_broadcast_nothing(spark, monkeypatch):
    """A broadcast goes through the driver, once for every jump and round."""
    plans, write = [], history.checkpointed

    def watched(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(history, "checkpointed", watched)
    link = F.when(F.col("id") == 0, F.array().cast("array<string>")).when(
        F.col("id") % 10 == 7, F.array((F.col("id") - 1).cast("string"), (F.col("id") - 4).cast("string"))
    ).otherwise(F.array((F.col("id") - 1).cast("string")))
    commits = spark.range(60).select(F.col("id").cast("string").alias("sha"), link.alias("parents"))
    found = history.commit_range(commits, "30", "59")
    assert sorted(int(r.sha) for r in found.collect()) == list(range(31, 60))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 6 and not [p for p in plans if "Broadcast" in p]


def test_pii_trees_see_every_text(spark):
    """All distinct texts count, by the driver's sums and by Spark's alike."""
    def text(i):
        return f"note {i} write u{i}@mail{i % 7}.org or call +1 ({200 + i % 700}) 555-{1000 + i} host 10.2.{i % 200}.7, code {i * 7919}"

    docs = spark.createDataFrame([(text(i),) for i in range(300)] + [(text(0),)] * 50, "text string")
    made = private.training_table(docs)
    distinct = {text(i) for i in range(300)}
    assert made.count() == sum(len(private.examples(t)) for t in distinct)
    own = [([float(v) for v in e[0]], e[2]) for t in distinct for e in private.examples(t)]
    rows = spark.createDataFrame([(*r, 1) for r in own], "x array<double>, label long, n long").repartition(3)
    near, far = private.fitted(rows, 10**6), boosting.fit(np.array([r[0] for r in own]), np.array([float(r[1]) for r in own]))
    x = np.array([r[0] for r in own])
    assert np.allclose(near.margin(x), far.margin(x))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(private, "boosted", lambda cuts, start, sums: boosting.boosted(cuts, start, sums, rounds=3))
        here, there = private.fitted(rows, 10**6), private.fitted(rows, 0)
    assert np.allclose(here.margin(x), there.margin(x)) and len(there.trees) == 3


def test_default_training_has_no_sample(spark, monkeypatch):
    taken, table = [], private.training_table
    monkeypatch.setattr(private, "training_table", lambda docs, sample=None: taken.append(sample) or table(docs, sample))
    monkeypatch.setattr(private, "some_rows", lambda *a: pytest.fail("cut"))
    private.trained(spark.createDataFrame([("a plain text",)], "text string"))
    assert taken == [None]


@pytest.mark.parametrize("name", ["snk3_migration_log", "agg5_fix_summary"])
def test_findings_are_scanned_once(spark, monkeypatch, name):
    scanned = spark.sparkContext.accumulator(0)
    schema = "path string, line int, column int, kind int, rule_ord int, rule string, snippet string, masked_snippet string, token string, confidence double"

    def finding(i):
        scanned.add(1)
        return f"f{i}", 1, 0, 1, 7, "GITHUB_PAT", "x", "***", "t", 0.5 if i % 2 else 0.99

    def findings(spark, sf):
        return spark.createDataFrame(spark.sparkContext.parallelize(range(10), 2).map(finding), schema)

    monkeypatch.setattr(queries, "findings", findings)
    row = QUERIES[name](spark, "").first()
    assert row["migrations"] == 10 and scanned.value == 10
