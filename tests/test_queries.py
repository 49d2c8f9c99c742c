"""The registered queries against their SQL, at the smallest size.

All of them run with VEILSCAN_ALL_QUERIES=1, else a part that covers the plans.
"""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from veilscan.plans.oracle import build
from veilscan.plans.queries import QUERIES as own_queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
PART = [
    "src1_scan_directory",
    "src2_scan_files",
    "det4_user_rules",
    "src5_scan_history",
    "src8_added_lines",
    "snk1_save_findings",
    "flt1_exclude_paths",
    "flt2_is_binary",
    "prj1_to_dict",
    "det4_combined_scan",
    "det4_web_pages",
    "det6_rule_info",
    "jon4_env_check",
    "jon5_rescan_delta",
    "agg1_summary",
    "agg4_listed_by_file",
    "agg6_missing_names",
    "agg8_gate",
    "win1_env_ordinal",
    "ded2_commit_dedup",
    "set3_commit_range",
    "sca8_redact_snippet",
    "sca12_extract_literal",
    "det1_pattern_scan",
    "rem3_parse_instructions",
    "rem7_rewrite_file",
    "rem8_rewrite_many",
    "rem9_changed_lines",
    "rem9_joined_lines",
    "str1_incremental_scan",
    "str2_stream_gate",
]
QUERIES, SQL = contract.queries(), contract.oracle_sql()
CHOSEN = list(build()) if os.environ.get("VEILSCAN_ALL_QUERIES") else PART


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rounded(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr([rounded(r[c]) for c in columns]) for r in df.collect())
    result = duck.sql(SQL[name])
    assert sorted(result.columns) == columns
    places = [result.columns.index(c) for c in columns]
    want = sorted(repr([rounded(r[i]) for i in places]) for r in result.fetchall())
    assert got == want
    assert got


def test_every_query_has_sql():
    assert set(own_queries) == set(build())
    assert set(SQL) <= set(QUERIES) and set(own_queries) <= set(QUERIES)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["rule", "findings"] and df.count() > 30
