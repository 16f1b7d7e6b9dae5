"""Where queries and their SQL are registered, and the order graphs that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from latticework.operators import graphs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BASE = """WITH it AS (
  SELECT l_orderkey AS gid, l_partkey AS pk, l_suppkey AS sk,
    CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS ol,
    CASE WHEN p_size > 25 THEN 11 ELSE 10 END AS pl, 20 + n_regionkey AS sl,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS fl
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
nodes AS (
  SELECT DISTINCT gid, 0 AS kind, 0 AS k, ol AS vlabel FROM it UNION ALL
  SELECT DISTINCT gid, 1, pk, pl FROM it UNION ALL SELECT DISTINCT gid, 2, sk, sl FROM it),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY gid ORDER BY kind, k) - 1 AS INT) AS vid FROM nodes),
vertices AS (SELECT gid, vid, vlabel FROM numbered),
raw AS (
  SELECT it.gid, 0 AS src, p.vid AS dst, fl AS elabel FROM it JOIN numbered p ON p.gid = it.gid AND p.kind = 1 AND p.k = pk UNION ALL
  SELECT it.gid, p.vid, s.vid, 3 FROM it JOIN numbered p ON p.gid = it.gid AND p.kind = 1 AND p.k = pk
    JOIN numbered s ON s.gid = it.gid AND s.kind = 2 AND s.k = sk UNION ALL
  SELECT it.gid, 0, s.vid, 4 FROM it JOIN numbered s ON s.gid = it.gid AND s.kind = 2 AND s.k = sk),
edges AS (SELECT gid, src, dst, min(elabel) AS elabel FROM raw GROUP BY gid, src, dst),
adj AS (
  SELECT e.gid, e.src, e.dst, a.vlabel AS slabel, e.elabel, b.vlabel AS dlabel
  FROM (SELECT gid, src, dst, elabel FROM edges UNION ALL SELECT gid, dst, src, elabel FROM edges) e
    JOIN vertices a ON a.gid = e.gid AND a.vid = e.src JOIN vertices b ON b.gid = e.gid AND b.vid = e.dst),
seeds AS (SELECT slabel AS fl, elabel AS el, dlabel AS tl, count(DISTINCT gid) AS support FROM adj WHERE slabel <= dlabel GROUP BY ALL)
"""


def query(name: str, sql: str | None = None, base: str = BASE) -> Callable[[Query], Query]:
    """Registers a query, and its SQL after the base expressions."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = base + sql
        return fn

    return add


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.adjacency_of(graphs.order_graphs(spark, sf_dir))


def both_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = graphs.order_graphs(spark, sf_dir)
    return graphs.vertices_of(rows), graphs.edges_of(rows)
