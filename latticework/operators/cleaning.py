"""Checks and repairs of graph collections, label dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def faults(edges: DataFrame) -> DataFrame:
    """gid, src, dst, fault of self-loops and of edges given more than once, whatever their direction."""
    lo, hi = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    loops = edges.filter("src = dst").select("gid", "src", "dst", F.lit("loop").alias("fault")).distinct()
    several = edges.filter("src != dst").select("gid", lo, hi).groupBy("gid", "src", "dst").count().filter("count > 1")
    return loops.unionByName(several.select("gid", "src", "dst", F.lit("parallel").alias("fault")))


def check_edges(edges: DataFrame) -> None:
    """ValueError if any graph has a self-loop or a parallel edge."""
    bad = faults(edges).limit(1).collect()
    if bad:
        raise ValueError(f"graph {bad[0]['gid']}: {bad[0]['fault']} edge {bad[0]['src']}-{bad[0]['dst']}")


def fix_edges(edges: DataFrame) -> DataFrame:
    """Edges without self-loops and with parallel ones of equal label merged; the query fails where their labels differ."""
    simple = edges.filter("src != dst").select("gid", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "elabel")
    merged = simple.groupBy("gid", "src", "dst").agg(F.min("elabel").alias("elabel"), F.max("elabel").alias("most"))
    conflict = F.raise_error(F.concat(F.lit("parallel edges with different labels in graph "), F.col("gid").cast("string"))).cast("int")
    return merged.select("gid", "src", "dst", F.when(F.col("elabel") == F.col("most"), F.col("elabel")).otherwise(conflict).alias("elabel"))


def relabel_one_based(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphs whose edges never touch vertex 0 lose it, and their other numbers go down by one.

    A graph without edges loses its vertex 0 too, as nothing touches it.
    """
    touched = edges.groupBy("gid").agg(F.min(F.least("src", "dst")).alias("least"))
    shift = touched.select("gid", (F.col("least") > 0).cast("int").alias("shift"))
    v = vertices.join(shift, "gid", "left").withColumn("shift", F.coalesce("shift", F.lit(1)))
    v = v.filter("shift = 0 or vid > 0").select("gid", (F.col("vid") - F.col("shift")).alias("vid"), "vlabel")
    e = edges.join(shift, "gid").select("gid", (F.col("src") - F.col("shift")).alias("src"), (F.col("dst") - F.col("shift")).alias("dst"), "elabel")
    return v, e


def fix_database(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repairs edges, then numbers one-based graphs from 0."""
    return relabel_one_based(vertices, fix_edges(edges))


def dangling(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that isn't a vertex."""
    ends = edges.select("gid", "src", "dst", F.explode(F.array("src", "dst")).alias("vid"))
    return ends.join(vertices.select("gid", "vid"), ["gid", "vid"], "left_anti").select("gid", "src", "dst").distinct()


def asymmetric(adj: DataFrame) -> DataFrame:
    """Adjacency rows whose other direction is missing or has another label."""
    back = adj.select("gid", F.col("dst").alias("src"), F.col("src").alias("dst"), "elabel", F.col("dlabel").alias("slabel"), F.col("slabel").alias("dlabel"))
    return adj.join(back, ["gid", "src", "dst", "slabel", "elabel", "dlabel"], "left_anti")


def label_dictionary(rows: DataFrame, label: str, order: list[str]) -> DataFrame:
    """label, code: labels numbered from 0 by their first appearance in ``order``.

    One row for each label reaches the numbering, so it stays as small as the alphabet.
    """
    first = rows.groupBy(F.col(label).alias("label")).agg(F.min(F.struct(*order)).alias("first"))
    return first.select("label", (F.row_number().over(W.orderBy("first")) - 1).alias("code"))


def compact_labels(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """vertices and edges with labels numbered by first appearance, and the two dictionaries."""
    dv = label_dictionary(vertices, "vlabel", ["gid", "vid"])
    both = edges.unionByName(edges.select("gid", F.col("dst").alias("src"), F.col("src").alias("dst"), "elabel"))
    de = label_dictionary(both, "elabel", ["gid", "src", "dst"])
    v = vertices.join(dv, F.col("vlabel") == F.col("label")).select("gid", "vid", F.col("code").alias("vlabel"))
    e = edges.join(de, F.col("elabel") == F.col("label")).select("gid", "src", "dst", F.col("code").alias("elabel"))
    return v, e, dv, de


def label_warnings(vertices: DataFrame, edges: DataFrame, most: int = 30) -> DataFrame:
    """kind, label, n of labels below 0 or above ``most``."""
    rows = vertices.select(F.lit("vertex").alias("kind"), F.col("vlabel").alias("label")).unionAll(edges.select(F.lit("edge"), "elabel"))
    return rows.filter((F.col("label") < 0) | (F.col("label") > most)).groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))
