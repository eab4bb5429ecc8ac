"""The driver contract: names, and a part of the queries against their SQL on the smallest tables.

All of them: python tools/check.py /root/testdata/sf0.01
"""

import os

import pytest

import __spark_entry__ as entry
import contract
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "file_classification", "file_routing", "number_parsing", "project_numbers", "line_labels", "plan_space_labels", "equipment_reference_check",
    "plausibility_ranges", "project_sizes", "phase_timeline", "merged_survivors", "merge_conflicts", "spaces_from_sheets", "raw_table_rows",
    "spaces_from_model", "equipment_from_model", "category_units", "findings_from_answers", "first_passage_of_quote", "distinct_findings",
    "forward_fill", "document_islands", "next_snapshot_versions", "incremental_intake", "event_log_stream",
]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    without = set(contract.QUERIES) - set(contract.ORACLES)
    assert without == {"space_clusters", "system_clusters", "merged_spaces", "similar_names", "distinct_documents"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, cur.fetchall()) and sum(got.values()) > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
