"""Statistics of graph collections, patterns and benchmark results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vertex_label_support(vertices: DataFrame) -> DataFrame:
    """vlabel, support: graphs with a vertex of that label."""
    return vertices.select("gid", "vlabel").distinct().groupBy("vlabel").agg(F.count(F.lit(1)).alias("support"))


def label_sets(adj: DataFrame) -> DataFrame:
    """n_vlabels, n_elabels, max_vlabel, max_elabel."""
    kinds = adj.select("slabel", "elabel").distinct()
    return kinds.agg(F.count_distinct("slabel").alias("n_vlabels"), F.count_distinct("elabel").alias("n_elabels"), F.max("slabel").alias("max_vlabel"), F.max("elabel").alias("max_elabel"))


def database_statistics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: graphs, vertices, edges, averages for each graph, label counts, average degree.

    Each table is read once and pre-added by graph and label; a graph is a gid with vertices,
    whatever their numbers.
    """
    by_gid = vertices.groupBy("gid", "vlabel").agg(F.count(F.lit(1)).alias("n"))
    v = by_gid.agg(F.count_distinct("gid").alias("n_graphs"), F.sum("n").alias("n_vertices"), F.count_distinct("vlabel").alias("n_vlabels"))
    e = edges.groupBy("elabel").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"), F.count(F.lit(1)).alias("n_elabels"))
    return averages(v.join(F.broadcast(e)))  # one row each


def averages(totals: DataFrame) -> DataFrame:
    per = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)
    return totals.select("n_graphs", "n_vertices", "n_edges", "n_vlabels", "n_elabels", per("n_edges", "n_graphs").alias("avg_edges"), per("n_vertices", "n_graphs").alias("avg_vertices"), F.round(2 * F.col("n_edges") / F.nullif(F.col("n_vertices"), F.lit(0)), 6).alias("avg_degree"))


def collection_statistics(graphs: DataFrame) -> DataFrame:
    """``database_statistics`` of a table of whole graphs, in one pass over its rows.

    A graph's row gives its sizes and its labels; sums and labels are pre-added in each task.
    """
    labels = lambda kind, found: F.transform(F.array_distinct(found), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("label")))
    both = F.concat(labels(0, F.col("vlabels")), labels(1, F.col("edges.elabel")))
    rows = graphs.select(F.size("vlabels").alias("nv"), F.size("edges").alias("ne"), F.posexplode_outer(both).alias("at", "x"))
    once = lambda c: F.sum(F.when(F.coalesce("at", F.lit(0)) == 0, c).otherwise(0))
    by_label = rows.groupBy("x").agg(once(F.lit(1)).alias("g"), once(F.col("nv")).alias("v"), once(F.col("ne")).alias("e"))
    kinds = lambda kind: F.count(F.when(F.col("x.kind") == kind, 1))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return averages(by_label.agg(total("g").alias("n_graphs"), total("v").alias("n_vertices"), total("e").alias("n_edges"), kinds(0).alias("n_vlabels"), kinds(1).alias("n_elabels")))


def pattern_statistics(patterns: DataFrame) -> DataFrame:
    """One row over patterns (code): count, largest and average size and number of backward edges."""
    ends = F.expr(r"transform(regexp_extract_all(code, '\\((-?\\d+) (-?\\d+)', 0), p -> split(substring(p, 2), ' '))")
    backward = F.size(F.filter(ends, lambda e: e[0].cast("int") > e[1].cast("int")))
    rows = patterns.filter(F.trim("code") != "").select(F.size(ends).alias("size"), backward.alias("backward"))
    return rows.agg(F.count(F.lit(1)).alias("n_patterns"), F.max("size").alias("max_size"), F.round(F.avg("size"), 6).alias("avg_size"), F.max("backward").alias("max_backward"), F.round(F.avg("backward"), 6).alias("avg_backward"))


def clustering(adj: DataFrame) -> DataFrame:
    """gid, avg_degree, avg_clustering of graphs with edges.

    A vertex's coefficient is the share of its neighbour pairs that are linked; vertices of one
    neighbour have 0. Pairs are formed within a vertex's own neighbours.
    """
    plain = adj.select("gid", "src", "dst").distinct()
    degree = plain.groupBy("gid", "src").agg(F.count(F.lit(1)).alias("d"))
    a, b = plain.alias("a"), plain.alias("b")
    pairs = a.join(b, (F.col("a.gid") == F.col("b.gid")) & (F.col("a.src") == F.col("b.src")) & (F.col("a.dst") < F.col("b.dst"))).select("a.gid", "a.src", F.col("a.dst").alias("x"), F.col("b.dst").alias("y"))
    linked = pairs.join(plain.select("gid", F.col("src").alias("x"), F.col("dst").alias("y")), ["gid", "x", "y"], "left_semi").groupBy("gid", "src").agg(F.count(F.lit(1)).alias("n"))
    share: Column = F.when(F.col("d") > 1, 2.0 * F.coalesce("n", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    each = degree.join(linked, ["gid", "src"], "left").withColumn("c", share)
    return each.groupBy("gid").agg(F.avg("d").alias("avg_degree"), F.avg("c").alias("avg_clustering"))


def collection_clustering(adj: DataFrame) -> DataFrame:
    """One row: n_graphs, and the averages over graphs of average degree and clustering coefficient."""
    return clustering(adj).agg(F.count(F.lit(1)).alias("n_graphs"), F.round(F.avg("avg_degree"), 6).alias("avg_degree"), F.round(F.avg("avg_clustering"), 6).alias("avg_clustering"))


def log_values(lines: DataFrame, line: str = "value") -> DataFrame:
    """name, value of every ``[name=value]`` in lines that are marked ``[VAL]``."""
    marked = lines.filter(F.col(line).contains("[VAL]"))
    found = marked.select(F.explode(F.regexp_extract_all(line, F.lit(r"\[([A-Za-z_]\w*=[^\]]*)\]"), F.lit(1))).alias("pair"))
    return found.select(F.substring_index("pair", "=", 1).alias("name"), F.regexp_extract("pair", "^[^=]*=(.*)$", 1).alias("value"))


def speedup(results: DataFrame, first: int, second: int) -> DataFrame:
    """iddb, support, t1, t2, speedup (t2 / t1) of two experiments' times on equal databases and supports.

    results: iddb, idexp, support, execution_time.
    """
    of = lambda idexp, t: results.filter(F.col("idexp") == idexp).select("iddb", "support", F.col("execution_time").alias(t))
    both = of(first, "t1").join(of(second, "t2"), ["iddb", "support"])
    return both.select("iddb", "support", F.lit(first).alias("idexp1"), "t1", F.lit(second).alias("idexp2"), "t2", (F.col("t2") / F.col("t1")).alias("speedup"))


def comparison(results: DataFrame, counts: str = "n_patterns") -> DataFrame:
    """support, and for the variants ``seq`` and ``par`` time and count, whether counts agree, and the speedup."""
    wide = results.groupBy("support").pivot("variant", ["seq", "par"]).agg(F.first("execution_time").alias("time"), F.first(counts).alias("n"))
    return wide.select("support", "seq_time", "par_time", "seq_n", "par_n", (F.col("seq_n") == F.col("par_n")).alias("equal"), (F.col("seq_time") / F.col("par_time")).alias("speedup"))
