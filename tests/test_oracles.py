"""Registered graph queries against their SQL, over the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from tracewarden.plans import catalog

SF = "/root/testdata/sf0.001"
QUICK = ("node_stats", "out_degrees", "stable_ids", "severity_map", "param_lists", "dataflow_edges", "call_edges_ordered", "classify_lines_py", "classify_lines_ts", "classify_lines_go", "file_context", "latest_change", "trace_flow", "blast_nodes", "find_all_paths", "posture_by_module", "extracted_py", "extracted_ts", "extracted_go", "line_imports", "line_functions", "incremental_calls", "page_script_calls", "graph_delta", "order_paths", "nested_callers", "rules_go", "checked_paths_sound", "graph_versions", "page_lines", "order_reaches")


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()
    assert set(catalog.queries()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(r) for r in found.fetchall()), key=str)
    df = catalog.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=str) == want
