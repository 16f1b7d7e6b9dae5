import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from latticework import catalog
from latticework.operators import graphs as G

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Order tables with null sizes and labels, an order without items, items without an order, repeated items."""
    folder = str(tmp_path_factory.mktemp("odd"))
    put = lambda name, **columns: pq.write_table(pa.table(columns), f"{folder}/{name}.parquet")
    put("nation", n_nationkey=pa.array([0, 1], pa.int64()), n_regionkey=pa.array([2, None], pa.int64()))
    put("supplier", s_suppkey=pa.array([5, 6], pa.int64()), s_nationkey=pa.array([0, 1], pa.int64()))
    put("part", p_partkey=pa.array([7, 8, -9], pa.int64()), p_size=pa.array([None, 30, 25], pa.int64()))
    put("orders", o_orderkey=pa.array([1, 2, -3], pa.int64()), o_orderstatus=["F", "O", None])
    put("lineitem", l_orderkey=pa.array([1, 1, 1, -3, 4, None, -3], pa.int64()), l_partkey=pa.array([7, 8, 7, -9, 7, 7, 99], pa.int64()), l_suppkey=pa.array([6, 5, 6, 5, 5, 5, 5], pa.int64()), l_returnflag=["R", "A", "N", None, "A", "A", "A"])
    return folder


def answers(spark, folder, name):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    key = lambda r: [(x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r]
    return sorted(map(tuple, catalog.queries()[name](spark, folder).collect()), key=key), sorted(con.sql(catalog.oracle_sql()[name]).fetchall(), key=key)


@pytest.mark.parametrize("name", ["graph_vertices", "graph_edges_sym", "graph_rows", "edge_label_hist", "fix_graph"])
def test_odd_tables(spark, odd, name):
    got, expected = answers(spark, odd, name)
    assert got == expected and got


def test_batches_are_cut_between_graphs(spark):
    rows = G.order_graphs(spark, SMALL)
    columns = lambda step: pa.Table.from_batches(list(G.whole_graphs(iter(batches(step)), step))).to_pylist()
    sorted_rows = [(g, g % 3 > 0 or i > 0, i % 5, i % 2, 10, 20, i % 3) for g in range(40) for i in range(1 + g % 7)]
    names = ["gid", "item", "part", "supplier", "part_label", "supplier_label", "flag"]
    batches = lambda step: pa.table(dict(zip(names, map(list, zip(*sorted_rows))))).to_batches(step)
    assert columns(1) == columns(3) == columns(1000)
    assert rows.count() == rows.select("gid").distinct().count() > 0


@pytest.mark.parametrize("name", ["edge_label_hist", "label_warnings", "edge_ids", "graph_rows", "relabel_one_based", "dangling_edges"])
def test_filters_make_no_graph_again(spark, name):
    """Spark derives filters from an explode; pushed below array expressions they held the whole graph's making."""
    plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in "".join(x for x in plan.split("\n") if "Filter" in x)
