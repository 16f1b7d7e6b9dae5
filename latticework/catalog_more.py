"""Registered queries of file formats, embedding columns, codes and repairs, over the order graphs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import dfscode as D
from latticework.functions.tables import dfs_edges, same_edge
from latticework.operators import cleaning, embeddings, graphs
from latticework.plans import mining
from latticework.registry import BASE, adjacency, both_tables, query
from latticework.sources import graph_files

MINSUP = 300


def work_path(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares; in a single process, in a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="graphs-")
    path = f"{folder.rstrip('/')}/graphs-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(target)
    return path


RANKED = "SELECT gid, dense_rank() OVER (ORDER BY gid) - 1 AS place FROM (SELECT DISTINCT gid FROM vertices)"
READ_BACK = f", ranked AS ({RANKED}) SELECT place AS gid, 'v' AS kind, vid AS a, vlabel AS b, -1 AS c FROM vertices JOIN ranked USING (gid) UNION ALL SELECT place, 'e', src, dst, elabel FROM edges JOIN ranked USING (gid)"


def rows_of(found: DataFrame) -> DataFrame:
    """Every vertex and edge of a table of graphs as a row; an edge from its smaller end."""
    v = graphs.vertices_of(found).select("gid", F.lit("v").alias("kind"), F.col("vid").alias("a"), F.col("vlabel").alias("b"), F.lit(-1).alias("c"))
    return v.unionByName(graphs.edges_of(found).select("gid", F.lit("e").alias("kind"), F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("elabel").alias("c")))


def there_and_back(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    path = work_path(spark)
    graph_files.write_graphs(graphs.order_graphs(spark, sf_dir), fmt, path)
    return rows_of(graph_files.read_graphs(spark, fmt, path))


@query("round_trip_txt", READ_BACK)
def round_trip_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order graphs written as text and read again."""
    return there_and_back(spark, sf_dir, "txt")


@query("round_trip_bin", READ_BACK)
def round_trip_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order graphs written as one binary file and read again."""
    return there_and_back(spark, sf_dir, "bin")


@query("round_trip_cudabin", READ_BACK)
def round_trip_cudabin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order graphs written as one column file and read again."""
    return there_and_back(spark, sf_dir, "cudabin")


@query(
    "read_fsg",
    f""", ranked AS ({RANKED}),
lines AS (SELECT place AS gid, vid + 1 AS line, vlabel AS label FROM vertices JOIN ranked USING (gid)),
codes AS (SELECT label, row_number() OVER (ORDER BY gid, line) - 1 AS code FROM (SELECT label, min(gid) AS gid, arg_min(line, (gid, line)) AS line FROM lines GROUP BY label))
SELECT gid, CAST(line - 1 AS INT) AS vid, CAST(code AS INT) AS vlabel FROM lines JOIN codes USING (label)""",
)
def read_fsg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of the order graphs in the string form, their labels numbered by first appearance."""
    v = F.transform("vlabels", lambda label, i: F.concat(F.lit("v "), i.cast("string"), F.lit(" L"), label.cast("string")))
    e = F.transform("edges", lambda x: F.concat_ws(" ", F.lit("u"), x["src"].cast("string"), x["dst"].cast("string"), F.concat(F.lit("E"), x["elabel"].cast("string"))))
    path = work_path(spark)
    text = graphs.order_graphs(spark, sf_dir).select(F.concat_ws("\n", F.concat(F.array(F.concat(F.lit("t # "), F.col("gid").cast("string"))), v, e)).alias("value"), "gid")
    text.orderBy("gid").select("value").write.text(path)
    return graphs.vertices_of(graph_files.read_fsg(spark, path)).select("gid", "vid", "vlabel")


@query(
    "read_bin_parts",
    f", ranked AS ({RANKED}), sizes AS (SELECT place, count(*) OVER () AS n FROM ranked) SELECT least(place // (n // 5), 4) AS part, count(*) AS n_graphs, min(place) AS first_gid, max(place) AS last_gid FROM sizes GROUP BY ALL",
)
def read_bin_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary file read in five parts; the last one has the remainder."""
    path = work_path(spark)
    graph_files.write_graphs(graphs.order_graphs(spark, sf_dir), "bin", path)
    out = None
    for part in range(5):
        own = graph_files.read_bin(spark, path, 5, part).agg(F.lit(part).cast("long").alias("part"), F.count(F.lit(1)).alias("n_graphs"), F.min("gid").alias("first_gid"), F.max("gid").alias("last_gid"))
        out = own if out is None else out.unionByName(own)
    return out


@query("concatenated", f", ranked AS ({RANKED}) SELECT count(*) * 2 AS n_graphs, CAST(sum(2 * place + (SELECT max(place) + 1 FROM ranked)) AS BIGINT) AS total FROM ranked")
def concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two collections one after the other, numbered on."""
    path = work_path(spark)
    graph_files.write_graphs(graphs.order_graphs(spark, sf_dir), "txt", path)
    found = graph_files.read_txt(spark, path)
    return graph_files.concatenate([found, found]).agg(F.count(F.lit(1)).alias("n_graphs"), F.sum("gid").alias("total"))


def extension_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension rows of the order vertex: a forward edge to each part and supplier, by global numbers of 64 a graph."""
    adj = adjacency(spark, sf_dir).filter("src = 0")
    place = lambda c: (F.col("gid") * 64 + F.col(c)).alias
    return adj.select(F.lit(0).alias("f"), F.lit(1).alias("t"), F.lit(0).alias("fl"), F.col("elabel").alias("el"), F.col("dlabel").alias("tl"), place("src")("from_grph"), place("dst")("to_grph"), F.col("gid").alias("row"))


@query("extension_gids", "SELECT DISTINCT 0 AS f, 1 AS t, 0 AS fl, elabel AS el, dlabel AS tl, gid FROM adj WHERE src = 0")
def extension_gids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graphs of each extension: the list behind its support."""
    return embeddings.extension_graphs(extension_rows(spark, sf_dir), 64)


@query("extension_supports", "SELECT 0 AS f, 1 AS t, 0 AS fl, elabel AS el, dlabel AS tl, count(DISTINCT gid) AS support FROM adj WHERE src = 0 GROUP BY ALL")
def extension_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.distinct_support(extension_rows(spark, sf_dir), 64)


@query("forward_column", "SELECT gid * 64 + dst AS vertex_id, gid AS back_link FROM adj WHERE src = 0 AND elabel = 4 AND dlabel = 22")
def forward_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new column of one forward extension: suppliers of region 2."""
    return embeddings.forward_column(extension_rows(spark, sf_dir), (0, 1, 0, 4, 22))


PARTS = "parts AS (SELECT gid, dst, (gid * 64 + dst) AS place FROM adj WHERE src = 0 AND elabel < 3)"


def part_column(adj: DataFrame) -> DataFrame:
    """An embedding column: the parts of an order, by global number, linked to the order."""
    return adj.filter("src = 0 and elabel < 3").select((F.col("gid") * 64 + F.col("dst")).alias("place"), F.col("dst").alias("vertex_id"), F.col("gid").alias("back_link"))


def supplier_column(adj: DataFrame) -> DataFrame:
    """A forward column from the parts: their suppliers, linked to the part's place."""
    return adj.filter("elabel = 3 and src < dst").select(F.col("dst").alias("vertex_id"), (F.col("gid") * 64 + F.col("src")).alias("back_link"))


@query(
    "bwd_fwd_intersect",
    f", {PARTS}, kept AS (SELECT place, row_number() OVER (ORDER BY place) - 1 AS link FROM (SELECT DISTINCT place FROM parts JOIN adj ON adj.gid = parts.gid AND adj.src = parts.dst AND adj.dlabel = 21)) SELECT adj.dst AS vertex_id, link AS back_link FROM adj JOIN kept ON gid * 64 + src = place WHERE elabel = 3 AND src < dst",
)
def bwd_fwd_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of parts that a supplier of region 1 delivers; the kept parts numbered anew."""
    adj = adjacency(spark, sf_dir)
    closing = adj.filter("dlabel = 21 and elabel = 3").select((F.col("gid") * 64 + F.col("src")).alias("row"))
    return embeddings.backward_forward_intersection(part_column(adj), closing, supplier_column(adj))


@query(
    "derived_forward",
    f", {PARTS} SELECT CAST(a.elabel AS VARCHAR) AS ext, a.dst AS vertex_id, p.place AS back_link FROM parts p JOIN adj a ON a.gid = p.gid AND a.src = 0 AND a.dst <> p.dst AND a.elabel >= 1",
)
def derived_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extensions of a child from its parent's other forward extensions."""
    adj = adjacency(spark, sf_dir)
    others = adj.filter("src = 0 and elabel >= 1").select(F.col("elabel").cast("string").alias("ext"), F.col("gid").alias("back_link"), F.col("dst").alias("vertex_id"))
    return embeddings.derived_extensions(part_column(adj), others)


@query(
    "derived_after_backward",
    f", {PARTS}, closed AS (SELECT place, row_number() OVER (ORDER BY place) - 1 AS link FROM (SELECT DISTINCT p.place FROM parts p JOIN adj a ON a.gid = p.gid AND a.src = p.dst AND a.elabel = 3 AND a.dlabel >= 22)) SELECT CAST(dlabel AS VARCHAR) AS ext, dst AS vertex_id, link AS back_link FROM adj JOIN closed ON gid * 64 + src = place WHERE elabel = 3 AND src < dst",
)
def derived_after_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extensions of a child that a backward edge has made, from its parent's forward extensions."""
    adj = adjacency(spark, sf_dir)
    closing = adj.filter("elabel = 3 and dlabel >= 22").select((F.col("gid") * 64 + F.col("src")).alias("row"))
    others = adj.filter("elabel = 3 and src < dst").select(F.col("dlabel").cast("string").alias("ext"), (F.col("gid") * 64 + F.col("src")).alias("back_link"), F.col("dst").alias("vertex_id"))
    return embeddings.derived_after_backward(part_column(adj), closing, others)


@query("edge_label_lookup", "SELECT a.gid, a.src, a.dst, a.elabel FROM adj a JOIN (SELECT gid, max(vid) AS last FROM vertices GROUP BY gid) m ON m.gid = a.gid AND a.dst = m.last")
def edge_label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the edges between every vertex and its graph's last one; pairs without an edge drop out."""
    v, _ = both_tables(spark, sf_dir)
    last = v.groupBy("gid").agg(F.max("vid").alias("dst"))
    pairs = v.join(last, "gid").filter("vid != dst").select("gid", F.col("vid").alias("src"), "dst")
    return graphs.edge_labels_of(adjacency(spark, sf_dir), pairs)


@query(
    "wildcard_equality",
    ", kinds AS (SELECT DISTINCT slabel AS fl, elabel AS el, dlabel AS tl FROM adj), marked AS (SELECT CASE WHEN fl % 2 = 1 THEN -1 ELSE fl END AS fl, el, CASE WHEN tl >= 22 THEN -1 ELSE tl END AS tl, fl AS own_fl, tl AS own_tl FROM kinds) "
    "SELECT a.fl, a.el, a.tl, b.own_fl, b.own_tl FROM kinds a JOIN marked b ON a.el = b.el AND (a.fl = b.fl OR b.fl = -1) AND (a.tl = b.tl OR b.tl = -1)",
)
def wildcard_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label triples that equal others of which some vertex labels are -1, any; as many rows as label combinations."""
    kinds = adjacency(spark, sf_dir).select(F.col("slabel").alias("fl"), F.col("elabel").alias("el"), F.col("dlabel").alias("tl")).distinct()
    edge = lambda fl, tl: F.struct(F.lit(0).alias("f"), F.lit(1).alias("t"), fl.alias("fl"), F.col("el").alias("el"), tl.alias("tl"))
    a = kinds.select("fl", "tl", "el", edge(F.col("fl"), F.col("tl")).alias("a"))
    marked = edge(F.when(F.col("fl") % 2 == 1, -1).otherwise(F.col("fl")), F.when(F.col("tl") >= 22, -1).otherwise(F.col("tl")))
    b = kinds.select(F.col("fl").alias("own_fl"), F.col("tl").alias("own_tl"), "el", marked.alias("b"))
    return a.join(b, "el").filter(same_edge(F.col("a"), F.col("b"))).select("fl", "el", "tl", "own_fl", "own_tl")


@query(
    "result_order",
    f""", emb AS (SELECT gid, src AS v0, dst AS v1, slabel AS fl0, elabel AS el0, dlabel AS tl0 FROM adj JOIN seeds ON slabel = fl AND elabel = el AND dlabel = tl WHERE support >= {MINSUP}),
grown AS (SELECT fl0, el0, tl0, 1 AS f, elabel AS el, dlabel AS tl, tl0 AS fl, emb.gid FROM emb JOIN adj ON adj.gid = emb.gid AND src = v1 WHERE dst <> v0 AND dlabel >= fl0
  UNION ALL SELECT fl0, el0, tl0, 0, elabel, dlabel, fl0, emb.gid FROM emb JOIN adj ON adj.gid = emb.gid AND src = v0 WHERE dst <> v1 AND dlabel >= fl0 AND (el0 < elabel OR (el0 = elabel AND tl0 <= dlabel))),
two AS (SELECT fl0, el0, tl0, f, fl, el, tl FROM grown GROUP BY ALL HAVING count(DISTINCT gid) >= {MINSUP}),
listed AS (SELECT printf('(0 1 %d %d %d)', fl, el, tl) AS code, fl AS a, el AS b, tl AS c, 0 AS more, 0 AS d, 0 AS e, 0 AS g FROM seeds WHERE support >= {MINSUP} UNION ALL
  SELECT printf('(0 1 %d %d %d);(%d 2 %d %d %d)', fl0, el0, tl0, f, fl, el, tl), fl0, el0, tl0, 1, -f, el, tl FROM two)
SELECT code, row_number() OVER (ORDER BY a, b, c, more, d, e, g) - 1 AS place FROM listed""",
)
def result_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent patterns of up to two edges in depth-first order, with their places."""
    found = mining.mine_codes(adjacency(spark, sf_dir), MINSUP, 2)
    return spark.createDataFrame([(D.format_code(c), i) for i, (c, _) in enumerate(found)], "code string, place long")


@query("dfs_edges", f"SELECT 0 AS f, 1 AS t, fl, el, tl, support FROM seeds WHERE support >= {MINSUP}")
def dfs_edges_of_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the frequent one-edge patterns' codes, by the table function."""
    found = mining.mine(adjacency(spark, sf_dir), MINSUP, 1)
    return found.lateralJoin(dfs_edges(F.col("code").outer())).select("f", "t", "fl", "el", "tl", "support")


@query("implied_labels", f"SELECT printf('(0 1 %d %d %d);(1 2 -1 %d %d)', fl0, el0, tl0, el, tl) AS implied FROM (SELECT fl0, el0, tl0, elabel AS el, dlabel AS tl FROM (SELECT gid, src AS v0, dst AS v1, slabel AS fl0, elabel AS el0, dlabel AS tl0 FROM adj JOIN seeds ON slabel = fl AND elabel = el AND dlabel = tl WHERE support >= {MINSUP}) emb JOIN adj ON adj.gid = emb.gid AND src = v1 WHERE dst <> v0 AND dlabel >= fl0 GROUP BY ALL HAVING count(DISTINCT emb.gid) >= {MINSUP})")
def implied_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-edge chains with implied labels, after from-vertices of -1 have been repaired."""
    chains = [c for c, _ in mining.mine_codes(adjacency(spark, sf_dir), MINSUP, 2) if len(c) == 2 and c[1][0] == 1]
    broken = [(c[0], (-1, *c[1][1:])) for c in chains]
    return spark.createDataFrame([(D.format_code(D.imply_labels(D.repair_from(c))),) for c in broken], "implied string")


@query("fix_database", "SELECT gid, src, dst, elabel FROM edges")
def fix_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-based graphs with loops and repeated edges come back simple and numbered from 0."""
    v, e = both_tables(spark, sf_dir)
    moved = e.select("gid", (F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"), "elabel")
    loops = v.filter("vid % 2 = 1").select("gid", (F.col("vid") + 1).alias("src"), (F.col("vid") + 1).alias("dst"), F.lit(7).alias("elabel"))
    back = moved.filter("elabel = 3").select("gid", F.col("dst").alias("src"), F.col("src").alias("dst"), "elabel")
    unused = v.filter("vid = 0").select("gid", F.lit(0).alias("vid"), F.lit(99).alias("vlabel"))
    shifted = v.select("gid", (F.col("vid") + 1).alias("vid"), "vlabel").unionByName(unused)
    return cleaning.fix_database(shifted, moved.unionByName(loops).unionByName(back))[1]


FIRST_SEEN = "codes AS (SELECT label, row_number() OVER (ORDER BY g, v) - 1 AS code FROM (SELECT vlabel AS label, min(gid) AS g, arg_min(vid, (gid, vid)) AS v FROM vertices GROUP BY vlabel))"


@query("compact_tables", f", {FIRST_SEEN} SELECT gid, vid, CAST(code AS INT) AS vlabel FROM vertices JOIN codes ON vlabel = label")
def compact_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices with labels numbered by first appearance."""
    v = cleaning.compact_labels(*both_tables(spark, sf_dir))[0]
    return v.select("gid", "vid", F.col("vlabel").cast("int").alias("vlabel"))


@query("global_scan", "SELECT gid, CAST(sum(n) OVER (ORDER BY gid) AS BIGINT) AS inclusive, CAST(sum(n) OVER (ORDER BY gid) - n AS BIGINT) AS exclusive FROM (SELECT gid, count(*) AS n FROM edges GROUP BY gid)")
def global_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running numbers of edges over the whole collection: where each graph's edges begin and end."""
    from latticework.operators.segments import global_scan as scan

    sizes = graphs.order_graphs(spark, sf_dir).select("gid", F.size("edges").cast("long").alias("n")).filter("n > 0")
    return scan(sizes, "n", "gid").select("gid", F.col("scan").alias("inclusive"), (F.col("scan") - F.col("n")).alias("exclusive"))
