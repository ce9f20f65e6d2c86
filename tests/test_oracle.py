"""Each query against its SQL at the smallest scale."""

import os

import duckdb
import pytest

from likegraph.queries import QUERIES
from likegraph.sql import SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        if name.endswith(".parquet"):
            con.sql(f"create view {name[:-8]} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in ("graph_edges", "neighbors", "roi_overlap_in", "projection_in", "conn_sorted", "conn_roi_restricted", "proc_sigmoid", "proc_scaled", "distance_pairs", "closest_to_body", "strongest_matches", "vi_table", "report_diffs", "partner_slots_in", "radar_table", "conn_replay", "distance_condensed", "ward_tree", "leaf_order", "ward_best_vi", "kmeans_assigned", "kmeans_lloyd", "pca_moments", "workflow_simple", "workflow") if n in SQL])
def test_query(spark, sql, name):
    a, b = QUERIES[name](spark, DATA).toPandas(), sql.sql(SQL[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and len(a) == len(b)
    a, b = (x[columns].sort_values(columns, ignore_index=True) for x in (a, b))
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c
