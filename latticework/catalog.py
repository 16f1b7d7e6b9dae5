"""The registered queries of the graph engine and their SQL.

All run over the order graphs: one graph for each order, of the order, its parts and its
suppliers. The SQL derives the same graphs in common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.functions import dfscode as D
from latticework.functions.signatures import signature
from latticework.operators import cleaning, containment, embeddings, graphs, segments, statistics
from latticework.plans import classes, mining
from latticework.registry import BASE, QUERIES, SQL, Query, adjacency, both_tables, query

MINSUP = 300
#: Share of the graphs that mine_full's patterns occur in; patterns of more than three edges do.
FULL_SHARE = 0.05
SHAPES = """,
arms AS (SELECT gid, src, dst, slabel, printf('%02d-%02d', elabel, dlabel) AS arm FROM adj),
occurrences AS (
  SELECT DISTINCT gid, 1 AS n_edges, 'edge' AS shape, printf('%02d-%02d-%02d', slabel, elabel, dlabel) AS signature FROM adj WHERE slabel <= dlabel UNION ALL
  SELECT DISTINCT a.gid, 2, 'wedge', printf('%02d|', a.slabel) || array_to_string(list_sort([a.arm, b.arm]), '|')
    FROM arms a JOIN arms b ON a.gid = b.gid AND a.src = b.src AND a.dst < b.dst UNION ALL
  SELECT DISTINCT a.gid, 3, 'star', printf('%02d|', a.slabel) || array_to_string(list_sort([a.arm, b.arm, c.arm]), '|')
    FROM arms a JOIN arms b ON a.gid = b.gid AND a.src = b.src AND a.dst < b.dst JOIN arms c ON c.gid = b.gid AND c.src = b.src AND b.dst < c.dst UNION ALL
  SELECT DISTINCT m.gid, 3, 'path', least(
      printf('%02d-%02d-%02d-%02d-%02d-%02d-%02d', a.dlabel, a.elabel, m.slabel, m.elabel, m.dlabel, b.elabel, b.dlabel),
      printf('%02d-%02d-%02d-%02d-%02d-%02d-%02d', b.dlabel, b.elabel, m.dlabel, m.elabel, m.slabel, a.elabel, a.dlabel))
    FROM adj m JOIN adj a ON a.gid = m.gid AND a.src = m.src AND a.dst <> m.dst JOIN adj b ON b.gid = m.gid AND b.src = m.dst AND b.dst <> m.src AND b.dst <> a.dst
    WHERE m.src < m.dst UNION ALL
  SELECT DISTINCT a.gid, 3, 'triangle', list_min([
      printf('%02d-%02d-%02d-%02d-%02d-%02d', a.slabel, a.elabel, b.slabel, b.elabel, c.slabel, c.elabel),
      printf('%02d-%02d-%02d-%02d-%02d-%02d', b.slabel, b.elabel, c.slabel, c.elabel, a.slabel, a.elabel),
      printf('%02d-%02d-%02d-%02d-%02d-%02d', c.slabel, c.elabel, a.slabel, a.elabel, b.slabel, b.elabel),
      printf('%02d-%02d-%02d-%02d-%02d-%02d', a.slabel, c.elabel, c.slabel, b.elabel, b.slabel, a.elabel),
      printf('%02d-%02d-%02d-%02d-%02d-%02d', c.slabel, b.elabel, b.slabel, a.elabel, a.slabel, c.elabel),
      printf('%02d-%02d-%02d-%02d-%02d-%02d', b.slabel, a.elabel, a.slabel, c.elabel, c.slabel, b.elabel)])
    FROM adj a JOIN adj b ON b.gid = a.gid AND b.src = a.dst JOIN adj c ON c.gid = b.gid AND c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.dst < b.dst),
patterns AS (SELECT n_edges, shape, signature, count(*) AS support FROM occurrences GROUP BY ALL HAVING count(*) >= {minsup})
""".replace("{minsup}", str(MINSUP))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.frequent(mining.seed_support(adjacency(spark, sf_dir)), 10)


@query("graph_vertices", "SELECT gid, vid, vlabel FROM vertices")
def graph_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both_tables(spark, sf_dir)[0]


@query("graph_edges_sym", "SELECT gid, src, dst, slabel, elabel, dlabel FROM adj")
def graph_edges_sym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacency(spark, sf_dir)


@query(
    "graph_rows",
    "SELECT v.gid, v.n_vertices, coalesce(e.n_edges, 0) AS n_edges FROM (SELECT gid, count(*) AS n_vertices FROM vertices GROUP BY gid) v LEFT JOIN (SELECT gid, count(*) AS n_edges FROM edges GROUP BY gid) e ON e.gid = v.gid",
)
def graph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host to columnar form and its sizes."""
    return graphs.to_rows(*both_tables(spark, sf_dir)).select("gid", F.size("vlabels").cast("long").alias("n_vertices"), F.size("edges").cast("long").alias("n_edges"))


@query("vertex_label_support", "SELECT vlabel, count(DISTINCT gid) AS support FROM vertices GROUP BY vlabel")
def vertex_label_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.vertex_label_support(both_tables(spark, sf_dir)[0])


@query("edge_label_hist", "SELECT elabel, count(*) AS n FROM edges GROUP BY elabel")
def edge_label_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both_tables(spark, sf_dir)[1].groupBy("elabel").agg(F.count(F.lit(1)).alias("n"))


@query("label_sets", "SELECT count(DISTINCT slabel) AS n_vlabels, count(DISTINCT elabel) AS n_elabels, max(slabel) AS max_vlabel, max(elabel) AS max_elabel FROM adj")
def label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.label_sets(adjacency(spark, sf_dir))


@query("label_warnings", "SELECT kind, label, count(*) AS n FROM (SELECT 'vertex' AS kind, vlabel AS label FROM vertices UNION ALL SELECT 'edge', elabel FROM edges) WHERE label < 0 OR label > 3 GROUP BY ALL")
def label_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.label_warnings(*both_tables(spark, sf_dir), most=3)


@query("seed_edges", "SELECT fl, el, tl, support FROM seeds")
def seed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.seed_support(adjacency(spark, sf_dir))


@query("frequent_edges", f"SELECT fl, el, tl, support FROM seeds WHERE support >= {MINSUP}")
def frequent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.frequent(mining.seed_support(adjacency(spark, sf_dir)), MINSUP)


def numbered(seeds: DataFrame) -> DataFrame:
    """Seeds with a pattern number by their labels; as many rows as label triples."""
    return seeds.withColumn("pid", (F.row_number().over(W.orderBy("fl", "el", "tl")) - 1).cast("int"))


@query("seed_embeddings", f"SELECT fl, el, tl, count(*) AS n, count(DISTINCT gid) AS n_graphs FROM adj JOIN seeds ON slabel = fl AND elabel = el AND dlabel = tl WHERE support >= {MINSUP} GROUP BY fl, el, tl")
def seed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    with mining.held(adjacency(spark, sf_dir)) as adj:
        seeds = frequent_seeds(adj)
        each = embeddings.occurrence_counts(mining.first_embeddings(adj, seed_table(spark, seeds)))
        total = each.groupBy("pid").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_graphs")).collect()
    return spark.createDataFrame([(*seeds[r["pid"]], r["n"], r["n_graphs"]) for r in total], "fl int, el int, tl int, n long, n_graphs long")


def frequent_seeds(adj: DataFrame) -> list[tuple[int, int, int]]:
    return sorted(tuple(r) for r in mining.frequent(mining.seed_support(adj), MINSUP).select("fl", "el", "tl").collect())


def seed_table(spark: SparkSession, seeds: list[tuple[int, int, int]]) -> DataFrame:
    """Seeds with a pattern number by their labels."""
    return mining.small(spark.createDataFrame([(i, *s) for i, s in enumerate(seeds)], "pid int, fl int, el int, tl int"), len(seeds))


def slot_table(spark: SparkSession, codes: list, only: str | None) -> DataFrame:
    rows = [x for i, c in enumerate(codes) for x in mining.slots(i, c, only)]
    return mining.small(spark.createDataFrame(rows, mining.SLOTS), len(rows))


def one_edge_growth(spark: SparkSession, sf_dir: str, only: str | None) -> DataFrame:
    """Growths of every frequent one-edge pattern, with its labels; as many rows as label combinations."""
    with mining.held(adjacency(spark, sf_dir)) as adj:
        seeds = frequent_seeds(adj)
        places = slot_table(spark, [((0, 1, *s),) for s in seeds], only)
        grown = mining.extensions(mining.first_embeddings(adj, seed_table(spark, seeds)), adj, places)
        rows = mining.extension_support(grown).collect()
    return spark.createDataFrame([(*r[1:], *seeds[r["pid"]]) for r in rows], "f int, t int, fl int, el int, tl int, support long, fl0 int, el0 int, tl0 int")


ONE_EDGE = f", emb AS (SELECT gid, src AS v0, dst AS v1, slabel AS fl0, elabel AS el0, dlabel AS tl0 FROM adj JOIN seeds ON slabel = fl AND elabel = el AND dlabel = tl WHERE support >= {MINSUP})"
PURE = "SELECT emb.gid, fl0, el0, tl0, 1 AS f, 2 AS t, tl0 AS fl, elabel AS el, dlabel AS tl FROM emb JOIN adj ON adj.gid = emb.gid AND src = v1 WHERE dst <> v0 AND dlabel >= fl0"
PATH = "SELECT emb.gid, fl0, el0, tl0, 0 AS f, 2 AS t, fl0 AS fl, elabel AS el, dlabel AS tl FROM emb JOIN adj ON adj.gid = emb.gid AND src = v0 WHERE dst <> v1 AND dlabel >= fl0 AND (el0 < elabel OR (el0 = elabel AND tl0 <= dlabel))"
GROWTH = "SELECT f, t, fl, el, tl, count(DISTINCT gid) AS support, fl0, el0, tl0 FROM ({rows}) GROUP BY ALL"


@query("ext_forward_pure", ONE_EDGE + " " + GROWTH.format(rows=PURE))
def ext_forward_pure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_edge_growth(spark, sf_dir, "pure")


@query("ext_forward_path", ONE_EDGE + " " + GROWTH.format(rows=PATH))
def ext_forward_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_edge_growth(spark, sf_dir, "path")


@query("ext_support", ONE_EDGE + " " + GROWTH.format(rows=f"{PURE} UNION ALL {PATH}") + f" HAVING count(DISTINCT gid) >= {MINSUP}")
def ext_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.frequent(one_edge_growth(spark, sf_dir, None), MINSUP)


CHAINS = ONE_EDGE + ", chain AS (SELECT emb.*, dst AS v2, elabel AS el1, dlabel AS tl1 FROM emb JOIN adj ON adj.gid = emb.gid AND src = v1 WHERE dst <> v0 AND dlabel >= fl0)"


def chains(spark: SparkSession, adj: DataFrame) -> tuple[DataFrame, list]:
    """Chains of two edges grown purely forward (pid, gid, vmap), and their codes by pid. adj is held."""
    seeds = frequent_seeds(adj)
    grown = mining.extensions(mining.first_embeddings(adj, seed_table(spark, seeds)), adj, slot_table(spark, [((0, 1, *s),) for s in seeds], "pure"))
    kinds = sorted(r[:6] for r in grown.select("pid", "f", "t", "fl", "el", "tl").distinct().collect())
    children = spark.createDataFrame([(*k, i) for i, k in enumerate(kinds)], "pid int, f int, t int, fl int, el int, tl int, child int")
    return mining.grow(grown, mining.small(children, len(kinds))), [((0, 1, *seeds[k[0]]), tuple(k[1:])) for k in kinds]


CHAIN = "fl0 int, el0 int, tl0 int, el1 int, tl1 int"


@query(
    "ext_backward",
    CHAINS + " SELECT fl0, el0, tl0, el1, tl1, elabel AS el, count(DISTINCT chain.gid) AS support FROM chain JOIN adj ON adj.gid = chain.gid AND src = v2 AND dst = v0 WHERE el0 < elabel OR (el0 = elabel AND tl0 <= tl1) GROUP BY ALL",
)
def ext_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    with mining.held(adjacency(spark, sf_dir)) as adj:
        grown, codes = chains(spark, adj)
        rows = mining.extension_support(mining.extensions(grown, adj, slot_table(spark, codes, "backward"))).collect()
    return spark.createDataFrame([(*codes[r["pid"]][0][2:], *codes[r["pid"]][1][3:], r["el"], r["support"]) for r in rows], f"{CHAIN}, el int, support long")


@query(
    "backward_filter_semi",
    CHAINS + " SELECT fl0, el0, tl0, el1, tl1, count(*) AS n FROM chain WHERE EXISTS (SELECT 1 FROM adj WHERE adj.gid = chain.gid AND src = v2 AND dst = v0 AND elabel = 4) GROUP BY ALL",
)
def backward_filter_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains that an edge of label 4 closes: a filter of the last column by a backward extension's rows."""
    with mining.held(adjacency(spark, sf_dir)) as adj:
        grown, codes = chains(spark, adj)
        place = F.struct("pid", "gid", "vmap")
        column = grown.select(place.alias("place"), F.get("vmap", F.lit(2)).alias("vertex_id"), F.get("vmap", F.lit(1)).alias("back_link"))
        ends = grown.select("gid", place.alias("row"), F.get("vmap", F.lit(2)).alias("src"), F.get("vmap", F.lit(0)).alias("dst"))
        closing = ends.join(adj, ["gid", "src", "dst"]).select(F.lit(2).alias("f"), F.lit(0).alias("t"), "slabel", F.col("elabel").alias("el"), "dlabel", "row")
        closing = closing.select("f", "t", F.lit(0).alias("fl"), "el", F.lit(0).alias("tl"), "row")  # the end labels are the chain's
        rows = embeddings.backward_filter(column, closing, (2, 0, 0, 4, 0)).groupBy("place.pid").agg(F.count(F.lit(1)).alias("n")).collect()
    return spark.createDataFrame([(*codes[r["pid"]][0][2:], *codes[r["pid"]][1][3:], r["n"]) for r in rows], f"{CHAIN}, n long")


def mined(spark: SparkSession, sf_dir: str, max_edges: int) -> DataFrame:
    found = mining.mine_codes(adjacency(spark, sf_dir), MINSUP, max_edges)
    return spark.createDataFrame([(len(c), *signature(c), s) for c, s in found], "n_edges int, shape string, signature string, support long")


@query("frequent_wedges", " SELECT signature, support FROM patterns WHERE shape = 'wedge'", BASE + SHAPES)
def frequent_wedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(spark, sf_dir, 2).filter("shape = 'wedge'").select("signature", "support")


@query("frequent_triangles", " SELECT signature, support FROM patterns WHERE shape = 'triangle'", BASE + SHAPES)
def frequent_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(spark, sf_dir, 3).filter("shape = 'triangle'").select("signature", "support")


@query("mine_le3", " SELECT n_edges, shape, signature, support FROM patterns", BASE + SHAPES)
def mine_le3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(spark, sf_dir, 3)


@query("mine_full")
def mine_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All patterns, whatever their size, in ``FULL_SHARE`` of the graphs."""
    with classes.gathered(graphs.order_graphs(spark, sf_dir, classes.classes_of_rows, classes.CLASS)) as held:
        return mining.mine(held, max(1, int(classes.n_graphs(held) * FULL_SHARE)))


@query(
    "pattern_stats",
    " SELECT count(*) AS n_patterns, max(n_edges) AS max_size, round(avg(n_edges), 6) AS avg_size, max(CASE WHEN shape = 'triangle' THEN 1 ELSE 0 END) AS max_backward, round(avg(CASE WHEN shape = 'triangle' THEN 1 ELSE 0 END), 6) AS avg_backward FROM patterns",
    BASE + SHAPES,
)
def pattern_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.pattern_statistics(mining.mine(adjacency(spark, sf_dir), MINSUP, 3))


@query(
    "fwd_fwd_intersect",
    "SELECT a.gid, b.dst AS vertex_id, count(*) AS n FROM adj a JOIN adj b ON a.gid = b.gid AND a.src = 0 AND b.src = 0 AND a.elabel = 1 AND b.elabel < 4 AND a.dst <> b.dst GROUP BY ALL",
)
def fwd_fwd_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two forward columns from the order vertex: parts returned as N, and all parts."""
    column = adjacency(spark, sf_dir).filter("src = 0")
    of = lambda rows: rows.select(F.struct("gid", "dst").alias("place"), F.col("dst").alias("vertex_id"), F.col("gid").alias("back_link"))
    both = embeddings.forward_intersection(of(column.filter("elabel = 1")), of(column.filter("elabel < 4")))
    return both.groupBy(F.col("back_link.gid").alias("gid"), "vertex_id").agg(F.count(F.lit(1)).alias("n"))


@query("bwd_bwd_intersect", "SELECT gid, count(*) AS n FROM adj a WHERE elabel = 3 AND EXISTS (SELECT 1 FROM adj b WHERE b.gid = a.gid AND b.dst = a.dst AND b.elabel = 4) GROUP BY gid")
def bwd_bwd_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns closed on the same (graph, vertex): suppliers reached from parts and from the order."""
    adj = adjacency(spark, sf_dir)
    of = lambda label: adj.filter(F.col("elabel") == label).select(F.struct("gid", "src", "dst").alias("place"), F.col("gid").alias("back_link"), F.col("dst").alias("vertex_id"))
    found = embeddings.backward_intersection(of(3), of(4))
    return found.groupBy(F.col("place.gid").alias("gid")).agg(F.count(F.lit(1)).alias("n"))


@query("gid_intersection", "SELECT count(*) AS n FROM (SELECT gid FROM adj WHERE elabel = 0 INTERSECT SELECT gid FROM adj WHERE dlabel = 22)")
def gid_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj = adjacency(spark, sf_dir)
    return embeddings.graph_intersection(adj.filter("elabel = 0"), adj.filter("dlabel = 22"))


@query(
    "ext_merge_anti",
    ", fresh AS (SELECT DISTINCT elabel AS el, dlabel AS tl FROM adj WHERE slabel >= 20), inherited AS (SELECT DISTINCT elabel AS el, dlabel AS tl FROM adj WHERE slabel <= 2) SELECT el, tl, 'inherited' AS origin FROM inherited UNION ALL SELECT el, tl, 'fresh' FROM fresh WHERE NOT EXISTS (SELECT 1 FROM inherited i WHERE i.el = fresh.el AND i.tl = fresh.tl)",
)
def ext_merge_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extensions from suppliers merged into those inherited from orders."""
    adj = adjacency(spark, sf_dir)
    of = lambda rows, origin: rows.select(F.col("elabel").alias("el"), F.col("dlabel").alias("tl")).distinct().withColumn("origin", F.lit(origin))
    return embeddings.merge_extensions(of(adj.filter("slabel >= 20"), "fresh"), of(adj.filter("slabel <= 2"), "inherited"), ["el", "tl"])


@query(
    "contains_pattern",
    "SELECT DISTINCT a.gid FROM adj a JOIN adj b ON b.gid = a.gid AND b.src = a.dst JOIN adj c ON c.gid = a.gid AND c.src = b.dst AND c.dst = a.src WHERE a.slabel = 1 AND a.elabel = 1 AND a.dlabel = 11 AND b.elabel = 3 AND b.dlabel = 22 AND c.elabel = 4",
)
def contains_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs with a triangle of open order, large part and supplier of region 2."""
    return containment.containing(adjacency(spark, sf_dir), ((0, 1, 1, 1, 11), (1, 2, 11, 3, 22), (2, 0, 22, 4, 1)))


@query(
    "compact_labels",
    "SELECT 'vertex' AS kind, label, CAST(row_number() OVER (ORDER BY g, v) - 1 AS INT) AS code FROM (SELECT vlabel AS label, min(gid) AS g, arg_min(vid, (gid, vid)) AS v FROM vertices GROUP BY vlabel) UNION ALL "
    "SELECT 'edge', label, CAST(row_number() OVER (ORDER BY g, s, d) - 1 AS INT) FROM (SELECT elabel AS label, min(gid) AS g, arg_min(src, (gid, src, dst)) AS s, arg_min(dst, (gid, src, dst)) AS d FROM adj GROUP BY elabel)",
)
def compact_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, dv, de = cleaning.compact_labels(*both_tables(spark, sf_dir))
    return dv.select(F.lit("vertex").alias("kind"), "label", "code").unionByName(de.select(F.lit("edge").alias("kind"), "label", "code"))


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge for each item and pair, repeated where items repeat it; keys as vertices, one label for a pair of kinds."""
    items = graphs.order_items(spark, sf_dir)
    pair = lambda a, b, label: F.struct(a.alias("src"), b.alias("dst"), F.lit(label).alias("elabel"))
    order, part, supplier = F.lit(0).cast("long"), F.col("part") + 1, -1 - F.col("supplier")
    three = F.explode(F.array(pair(order, part, 0), pair(part, supplier, 3), pair(order, supplier, 4)))
    return items.select("gid", three.alias("e")).select("gid", "e.*")


RAW_KEYS = ", plain AS (SELECT gid, CAST(0 AS BIGINT) AS src, pk + 1 AS dst, 0 AS elabel FROM it UNION ALL SELECT gid, pk + 1, -1 - sk, 3 FROM it UNION ALL SELECT gid, 0, -1 - sk, 4 FROM it)"


@query("check_graph", RAW_KEYS + " SELECT gid, least(src, dst) AS src, greatest(src, dst) AS dst, 'parallel' AS fault FROM plain GROUP BY ALL HAVING count(*) > 1")
def check_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.faults(raw_edges(spark, sf_dir))


@query("fix_graph", RAW_KEYS + " SELECT DISTINCT gid, least(src, dst) AS src, greatest(src, dst) AS dst, elabel FROM plain")
def fix_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.fix_edges(raw_edges(spark, sf_dir))


@query("relabel_one_based", "SELECT gid, vid, vlabel FROM vertices")
def relabel_one_based(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs numbered from 1, with an unused vertex 0, come back as they were."""
    v, e = both_tables(spark, sf_dir)
    unused = v.filter("vid = 0").select("gid", F.lit(0).alias("vid"), F.lit(99).alias("vlabel"))
    shifted = v.select("gid", (F.col("vid") + 1).alias("vid"), "vlabel").unionByName(unused)
    return cleaning.relabel_one_based(shifted, e.select("gid", (F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"), "elabel"))[0]


@query("dangling_edges", "SELECT gid, src, dst FROM edges e WHERE EXISTS (SELECT 1 FROM vertices v WHERE v.gid = e.gid AND v.vid IN (e.src, e.dst) AND v.vlabel = 23)")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges left without an end once suppliers of region 3 are gone."""
    v, e = both_tables(spark, sf_dir)
    return cleaning.dangling(v.filter("vlabel != 23"), e)


@query("symmetry_check", "SELECT gid, src, dst, slabel, elabel, dlabel FROM adj WHERE elabel = 4 AND slabel < dlabel")
def symmetry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose other direction is missing, once order-supplier edges have lost one."""
    return cleaning.asymmetric(adjacency(spark, sf_dir).filter("NOT (elabel = 4 AND slabel > dlabel)"))


@query("shrink_db", "SELECT elabel, count(*) AS n FROM adj JOIN seeds ON least(slabel, dlabel) = fl AND elabel = el AND greatest(slabel, dlabel) = tl WHERE support >= 3000 GROUP BY elabel")
def shrink_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.shrink(adjacency(spark, sf_dir), 3000).groupBy("elabel").agg(F.count(F.lit(1)).alias("n"))


@query(
    "db_stats",
    "SELECT n_graphs, n_vertices, n_edges, n_vlabels, n_elabels, round(n_edges / n_graphs, 6) AS avg_edges, round(n_vertices / n_graphs, 6) AS avg_vertices, round(2 * n_edges / n_vertices, 6) AS avg_degree FROM (SELECT count(DISTINCT gid) AS n_graphs, count(*) AS n_vertices, count(DISTINCT vlabel) AS n_vlabels FROM vertices), (SELECT count(*) AS n_edges, count(DISTINCT elabel) AS n_elabels FROM edges)",
)
def db_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.collection_statistics(graphs.order_graphs(spark, sf_dir))


@query(
    "clustering_coeff",
    """, deg AS (SELECT gid, src, count(*) AS d FROM adj GROUP BY ALL),
linked AS (SELECT a.gid, a.src, count(*) AS n FROM adj a JOIN adj b ON a.gid = b.gid AND a.src = b.src AND a.dst < b.dst JOIN adj c ON c.gid = a.gid AND c.src = a.dst AND c.dst = b.dst GROUP BY ALL),
each AS (SELECT deg.gid, d, CASE WHEN d > 1 THEN 2.0 * coalesce(n, 0) / (d * (d - 1)) ELSE 0 END AS c FROM deg LEFT JOIN linked ON linked.gid = deg.gid AND linked.src = deg.src),
per AS (SELECT gid, avg(d) AS d, avg(c) AS c FROM each GROUP BY gid)
SELECT count(*) AS n_graphs, round(avg(d), 6) AS avg_degree, round(avg(c), 6) AS avg_clustering FROM per""",
)
def clustering_coeff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.collection_clustering(adjacency(spark, sf_dir))


@query("edge_ids", "SELECT gid, src, dst, elabel, CAST(row_number() OVER (PARTITION BY gid ORDER BY src, dst) - 1 AS INT) AS edge_id FROM edges")
def edge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.edge_ids(both_tables(spark, sf_dir)[1])


@query("vertex_degrees", "SELECT gid, vid, (SELECT count(*) FROM adj WHERE adj.gid = v.gid AND src = vid) AS degree FROM vertices v")
def vertex_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graphs.order_graphs(spark, sf_dir)
    return graphs.vertex_degrees(graphs.vertices_of(rows), graphs.adjacency_of(rows))


@query("gid_dense_remap", "SELECT gid, dense_rank() OVER (ORDER BY gid) - 1 AS dense FROM (SELECT DISTINCT gid FROM edges)")
def gid_dense_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.dense_ids(graphs.order_gids(spark, sf_dir), "gid", "dense")


@query(
    "block_boundaries",
    ", placed AS (SELECT gid, src, CAST(row_number() OVER (PARTITION BY gid ORDER BY src, dst) - 1 AS INT) AS off, count(*) OVER (PARTITION BY gid) AS total, lag(src) OVER (PARTITION BY gid ORDER BY src, dst) AS was FROM adj) SELECT gid, src, off, coalesce(lead(off) OVER (PARTITION BY gid ORDER BY off), total) - off AS length FROM placed WHERE was IS NULL OR was <> src",
)
def block_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each vertex's block of the sorted adjacency starts, and its length."""
    w = W.partitionBy("gid")
    rows = adjacency(spark, sf_dir).select("gid", "src", "dst").withColumn("off", F.row_number().over(w.orderBy("src", "dst")) - 1).withColumn("total", F.count(F.lit(1)).over(w))
    heads = embeddings.block_heads(rows, ["src"], ["src", "dst"], ["gid"]).filter("head")
    return embeddings.block_lengths(heads, "off", "total", ["gid"]).select("gid", "src", "off", "length")


@query(
    "segmented_scan",
    "SELECT gid, vid, vlabel, CAST(sum(vlabel) OVER (PARTITION BY gid ORDER BY vid) AS BIGINT) AS inclusive, CAST(sum(vlabel) OVER (PARTITION BY gid ORDER BY vid) - vlabel AS BIGINT) AS exclusive FROM vertices",
)
def segmented_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = both_tables(spark, sf_dir)[0]
    both = segments.segmented_scan(segments.segmented_scan(v, "vlabel", ["vid"], ["gid"]).withColumnRenamed("scan", "inclusive"), "vlabel", ["vid"], ["gid"], False)
    return both.withColumnRenamed("scan", "exclusive")


@query("segmented_reduce", "SELECT gid, CAST(sum(vlabel) AS BIGINT) AS total FROM vertices GROUP BY gid")
def segmented_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segmented_reduce(both_tables(spark, sf_dir)[0], "vlabel", ["gid"])


@query("flag_segments", "SELECT gid, segment, count(*) AS n FROM (SELECT gid, CAST(sum(CASE WHEN vlabel >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY gid ORDER BY vid) AS BIGINT) AS segment FROM vertices) GROUP BY ALL")
def flag_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that start at each supplier."""
    marked = both_tables(spark, sf_dir)[0].withColumn("flag", F.col("vlabel") >= 20)
    return segments.mark_segments(marked, "flag", ["vid"], ["gid"]).groupBy("gid", "segment").agg(F.count(F.lit(1)).alias("n"))


@query("copy_if", "SELECT gid, vid, vlabel FROM vertices WHERE vlabel % 2 = 1")
def copy_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.copy_if(both_tables(spark, sf_dir)[0], F.col("vlabel") % 2 == 1)


@query(
    "partition_read",
    "SELECT least(i // (n // 7), 6) AS part, count(*) AS n_graphs, min(gid) AS first_gid, max(gid) AS last_gid FROM (SELECT gid, row_number() OVER (ORDER BY gid) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT gid FROM edges)) GROUP BY ALL",
)
def partition_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven contiguous parts of the collection, the last one with the remainder."""
    from latticework.sources.graph_files import part_of

    places = embeddings.dense_ids(graphs.order_gids(spark, sf_dir), "gid", "i")
    parts = places.withColumn("part", part_of(F.col("i"), places.count(), 7))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n_graphs"), F.min("gid").alias("first_gid"), F.max("gid").alias("last_gid"))


@query(
    "dfs_order",
    ONE_EDGE + f", ext AS (SELECT f, t, fl, el, tl FROM ({PURE} UNION ALL {PATH}) GROUP BY ALL) SELECT f, t, fl, el, tl, row_number() OVER (ORDER BY f DESC, el, tl, fl) - 1 AS place FROM ext",
)
def dfs_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct one-edge growths in depth-first order; as many rows as label combinations."""
    found = {tuple(r) for r in one_edge_growth(spark, sf_dir, None).select("f", "t", "fl", "el", "tl").distinct().collect()}
    ranked = sorted(found, key=lambda e: (*D.order_key(e), e[2]))
    return spark.createDataFrame([(*e, i) for i, e in enumerate(ranked)], "f int, t int, fl int, el int, tl int, place long")


RESULTS = """SELECT CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS INT) AS iddb, CAST(CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS INT) AS idexp,
  CAST(year(o_orderdate) AS INT) AS support, min(o_totalprice) AS execution_time, count(*) AS n_patterns FROM orders GROUP BY 1, 2, 3"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark results made from orders: databases by priority, experiments by status, supports by year."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    priority = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(3)
    keys = [priority.alias("iddb"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("idexp"), F.year("o_orderdate").alias("support")]
    return orders.groupBy(*keys).agg(F.min("o_totalprice").alias("execution_time"), F.count(F.lit(1)).alias("n_patterns"))


@query(
    "speedup_report",
    f"WITH r AS ({RESULTS}) SELECT iddb, support, 1 AS idexp1, a.execution_time AS t1, 2 AS idexp2, b.execution_time AS t2, b.execution_time / a.execution_time AS speedup FROM (SELECT * FROM r WHERE idexp = 1) a JOIN (SELECT * FROM r WHERE idexp = 2) b USING (iddb, support)",
    "",
)
def speedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.speedup(results(spark, sf_dir), 1, 2)


@query(
    "comparison_table",
    f"WITH r AS ({RESULTS}), s AS (SELECT * FROM r WHERE iddb = 1) SELECT support, max(CASE WHEN idexp = 1 THEN execution_time END) AS seq_time, max(CASE WHEN idexp = 2 THEN execution_time END) AS par_time, max(CASE WHEN idexp = 1 THEN n_patterns END) AS seq_n, max(CASE WHEN idexp = 2 THEN n_patterns END) AS par_n, seq_n = par_n AS equal, seq_time / par_time AS speedup FROM s GROUP BY support",
    "",
)
def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = results(spark, sf_dir).filter("iddb = 1").withColumn("variant", F.when(F.col("idexp") == 1, "seq").otherwise("par"))
    return statistics.comparison(named)


@query("log_values", "SELECT 'event' AS name, event_type AS value FROM events UNION ALL SELECT 'user', CAST(user_id AS VARCHAR) FROM events", "")
def log_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values out of log lines made from events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = events.select(F.concat(F.lit("INFO [VAL] at 1 [event="), "event_type", F.lit("] [user="), F.col("user_id").cast("string"), F.lit("] done")).alias("value"))
    other = events.select(F.concat(F.lit("INFO [event="), "event_type", F.lit("]")).alias("value"))
    return statistics.log_values(lines.unionAll(other))


from latticework import catalog_more  # noqa: E402, F401  registers its queries


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
