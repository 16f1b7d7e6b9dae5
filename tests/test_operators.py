import random

import pytest
from pyspark.sql import functions as F

from latticework.operators import cleaning, embeddings, graphs, segments, statistics

# Extension rows (tuple, from and to graph vertex, row), ten vertex places a graph.
EXTENSIONS = [
    (0, 3, 0, 1, 0, 1, 2, 0), (0, 3, 0, 2, 2, 2, 3, 0), (0, 3, 0, 3, 1, 10, 11, 0), (1, 3, 0, 1, 2, 1, 3, 0),
    (1, 3, 0, 0, 2, 10, 12, 0), (1, 3, 0, 1, 2, 20, 21, 0), (1, 3, 0, 2, 1, 30, 31, 0), (2, 3, 0, 1, 1, 1, 2, 0),
    (2, 3, 0, 1, 1, 0, 2, 0), (2, 3, 0, 1, 1, 1, 3, 0), (2, 0, 0, 1, 0, 0, 3, 0),
]
EXT = "f int, t int, fl int, el int, tl int, from_grph int, to_grph int, row int"


# Two blocks of extension rows, ten vertex places a graph, and the supports of their tuples.
FIRST_BLOCK = [
    (0, 3, 1, 1, 0, 4, 5, 0), (0, 3, 1, 2, 0, 6, 5, 0), (0, 3, 1, 1, 2, 6, 8, 0), (0, 3, 1, 1, 0, 18, 15, 0), (0, 3, 1, 1, 2, 18, 16, 0), (0, 3, 1, 2, 0, 51, 55, 0),
]
SECOND_BLOCK = [
    (2, 3, 0, 1, 0, 1, 2, 0), (2, 3, 0, 2, 2, 2, 3, 0), (2, 3, 0, 1, 2, 1, 3, 0), (2, 0, 0, 1, 0, 0, 3, 0), (2, 3, 0, 1, 0, 10, 11, 0), (2, 3, 0, 1, 2, 10, 12, 0), (2, 0, 0, 1, 0, 10, 13, 0),
    (2, 3, 0, 1, 2, 20, 21, 0), (2, 3, 0, 2, 2, 50, 51, 0), (2, 3, 0, 1, 0, 50, 52, 0), (2, 3, 0, 2, 1, 52, 51, 0), (2, 0, 0, 1, 0, 52, 53, 0), (2, 3, 0, 2, 1, 61, 63, 0), (2, 0, 0, 1, 0, 60, 62, 0),
]
SUPPORTS = {(0, 3, 1, 1, 0): 2, (0, 3, 1, 2, 0): 2, (0, 3, 1, 1, 2): 2, (2, 3, 0, 1, 0): 3, (2, 3, 0, 2, 2): 2, (2, 3, 0, 1, 2): 3, (2, 3, 0, 2, 1): 2, (2, 0, 0, 1, 0): 4}
# The last of three embedding columns, extension rows, and what the backward ones keep.
LAST_COLUMN = [(1, 0), (4, 1), (8, 1), (11, 3), (12, 3), (27, 5), (28, 5)]
CLOSING = [
    (2, 0, 5, 0, 2, 1, 2, 0), (2, 3, 5, 0, 1, 1, 9, 0), (2, 3, 5, 0, 5, 4, 8, 1), (2, 3, 5, 0, 5, 8, 4, 2), (2, 3, 5, 0, 3, 11, 13, 3), (2, 0, 5, 0, 2, 12, 17, 4), (2, 3, 5, 0, 3, 12, 13, 4),
    (2, 0, 5, 0, 2, 28, 22, 6),
]
KEPT = [(1, 0), (12, 3), (28, 5)]


def test_supports_of_blocks(spark):
    for rows in (SECOND_BLOCK, FIRST_BLOCK + SECOND_BLOCK):
        ext = spark.createDataFrame(rows, EXT)
        got = {tuple(r)[:5]: r["support"] for r in embeddings.distinct_support(ext, 10).collect()}
        assert got == {k: v for k, v in SUPPORTS.items() if k in {x[:5] for x in rows}}
        gids = {}
        for x in embeddings.extension_graphs(ext, 10).collect():
            gids.setdefault(tuple(x)[:5], []).append(x["gid"])
        assert {k: len(set(v)) for k, v in gids.items()} == got and all(len(v) == len(set(v)) for v in gids.values())


def test_backward_extensions_filter_the_last_column(spark):
    got = embeddings.backward_filter(column(spark, LAST_COLUMN), spark.createDataFrame(CLOSING, EXT), (2, 0, 5, 0, 2))
    assert [tuple(r) for r in got.orderBy("place").select("vertex_id", "back_link").collect()] == KEPT


def test_intersections_equal_a_plain_join(spark):
    r = random.Random(6)
    for _ in range(5):
        a, b = ([(r.randrange(12), r.randrange(5)) for _ in range(r.randrange(1, 15))] for _ in range(2))
        forward = sorted((v2, i) for i, (v1, l1) in enumerate(a) for v2, l2 in b if l1 == l2 and v1 != v2)
        assert sorted(tuple(x) for x in embeddings.forward_intersection(column(spark, a), column(spark, b)).collect()) == forward
        assert sorted(x["place"] for x in embeddings.backward_intersection(column(spark, a), column(spark, b)).collect()) == [i for i, x in enumerate(a) if x in b]


def column(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, vertex_id int, back_link int")


def test_distinct_support(spark):
    got = {tuple(r)[:5]: r["support"] for r in embeddings.distinct_support(spark.createDataFrame(EXTENSIONS, EXT), 10).collect()}
    assert got.pop((1, 3, 0, 1, 2)) == 2
    assert set(got.values()) == {1} and len(got) == 7


def test_forward_intersection_with_itself(spark):
    own = column(spark, [(10, 0), (11, 0), (12, 1), (13, 1), (14, 1), (17, 3), (19, 3)])
    got = {tuple(r) for r in embeddings.forward_intersection(own, own).collect()}
    assert got == {(11, 0), (10, 1), (13, 2), (14, 2), (12, 3), (14, 3), (12, 4), (13, 4), (19, 5), (17, 6)}


def test_backward_intersection(spark):
    a = column(spark, [(10, 0), (11, 0), (14, 1), (17, 1), (19, 1), (22, 3), (23, 3)])
    b = column(spark, [(14, 1), (18, 1), (22, 3), (23, 3), (25, 3), (28, 4)])
    assert sorted(r["place"] for r in embeddings.backward_intersection(a, b).collect()) == [2, 5, 6]


def test_backward_filter_forward_column_and_merge(spark):
    ext = spark.createDataFrame([(2, 0, 5, 0, 2, 1, 7, 1), (2, 0, 5, 0, 2, 1, 7, 2), (2, 0, 5, 1, 2, 1, 7, 0), (2, 3, 5, 0, 2, 1, 9, 1)], EXT)
    last = column(spark, [(1, 0), (12, 3), (28, 5)])
    assert sorted(tuple(r) for r in embeddings.backward_filter(last, ext, (2, 0, 5, 0, 2)).select("vertex_id", "back_link").collect()) == [(12, 3), (28, 5)]
    assert [tuple(r) for r in embeddings.forward_column(ext, (2, 3, 5, 0, 2)).collect()] == [(9, 1)]
    keys = ["f", "t", "fl", "el", "tl"]
    assert embeddings.merge_extensions(ext.select(*keys), ext.filter("t = 0").select(*keys), keys).count() == 4
    rows = spark.createDataFrame([(1,), (2,)], "row int")
    assert sorted(tuple(r) for r in embeddings.backward_forward_intersection(last, rows, column(spark, [(40, 0), (41, 1), (42, 2)])).collect()) == [(41, 0), (42, 1)]
    others = spark.createDataFrame([("x", 3, 12), ("x", 3, 13), ("y", 9, 1)], "ext string, back_link int, vertex_id int")
    assert [tuple(r) for r in embeddings.derived_extensions(last, others).collect()] == [("x", 13, 1)]


def test_dense_ids_blocks_and_segments(spark):
    rows = spark.createDataFrame([(g, i, (g + i) % 3) for g in (7, 90, 4) for i in range(5)], "gid int, i int, v int")
    assert sorted(tuple(r) for r in embeddings.dense_ids(rows, "gid", "d").collect()) == [(4, 0), (7, 1), (90, 2)]
    heads = embeddings.block_heads(rows.withColumn("total", F.lit(5)), ["v"], ["i"], ["gid"]).filter("head")
    lengths = embeddings.block_lengths(heads, "i", "total", ["gid"])
    assert {r["length"] for r in lengths.collect()} == {1}
    scans = segments.segmented_scan(rows, "v", ["i"], ["gid"], inclusive=False).collect()
    for g in (4, 7, 90):
        own = sorted((r["i"], r["v"], r["scan"]) for r in scans if r["gid"] == g)
        assert [s for *_, s in own] == [sum(v for _, v, _ in own[:k]) for k in range(5)]
    assert {r["total"] for r in segments.segmented_reduce(rows.withColumn("one", F.lit(1)), "one", ["gid"]).collect()} == {5}
    assert sorted(r["i"] for r in segments.copy_if(spark.range(1000).toDF("i"), F.col("i") % 2 == 1).collect()) == list(range(1, 1000, 2))


def test_cleaning(spark):
    v = spark.createDataFrame([(g, i, 0) for g in (0, 1, 2) for i in range(3)], "gid long, vid int, vlabel int")
    make = lambda rows: spark.createDataFrame(rows, "gid long, src int, dst int, elabel int")
    good = make([(0, 0, 1, 5), (0, 1, 1, 5), (1, 0, 1, 2), (1, 1, 0, 2), (2, 1, 2, 3)])
    with pytest.raises(ValueError):
        cleaning.check_edges(good)
    fixed = cleaning.fix_edges(good)
    cleaning.check_edges(fixed)
    assert sorted(tuple(r) for r in fixed.collect()) == [(0, 0, 1, 5), (1, 0, 1, 2), (2, 1, 2, 3)]
    with pytest.raises(Exception, match="different labels"):
        cleaning.fix_edges(make([(0, 0, 1, 5), (0, 1, 0, 6)])).collect()
    vertices, edges = cleaning.fix_database(v, good)
    assert sorted(r["vid"] for r in vertices.filter("gid = 2").collect()) == [0, 1]
    assert [tuple(r) for r in edges.filter("gid = 2").collect()] == [(2, 0, 1, 3)]
    assert [tuple(r) for r in cleaning.dangling(v, make([(0, 0, 9, 1), (0, 0, 1, 1)])).collect()] == [(0, 0, 9)]


def test_graphs_without_edges_lose_vertex_0(spark):
    v = spark.createDataFrame([(0, 0, 5), (0, 1, 6), (1, 0, 7), (2, 0, 1), (2, 1, 2)], "gid long, vid int, vlabel int")
    e = spark.createDataFrame([(2, 0, 1, 3)], "gid long, src int, dst int, elabel int")
    got, _ = cleaning.fix_database(v, e)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0, 6), (2, 0, 1), (2, 1, 2)]


def test_collections_numbered_from_one_are_counted(spark):
    v = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (1, 0, 5)], "gid long, vid int, vlabel int")
    e = spark.createDataFrame([(0, 1, 2, 3)], "gid long, src int, dst int, elabel int")
    assert tuple(statistics.database_statistics(v, e).first()) == (2, 3, 1, 2, 1, 0.5, 1.5, round(2 / 3, 6))
    rows = spark.createDataFrame([(4, [5, 6], [(0, 1, 3)]), (9, [5], []), (11, [], [])], "gid long, vlabels array<int>, edges array<struct<src:int,dst:int,elabel:int>>")
    assert tuple(statistics.collection_statistics(rows).first()) == (3, 3, 1, 2, 1, round(1 / 3, 6), 1.0, round(2 / 3, 6))
    assert tuple(statistics.collection_statistics(rows.limit(0)).first())[:5] == (0, 0, 0, 0, 0)


def test_vertex_numbers_must_be_dense(spark):
    e = spark.createDataFrame([(0, 0, 2, 3)], "gid long, src int, dst int, elabel int")
    for vids in ((0, 2, 3), (1, 2), (0, 0, 1)):
        v = spark.createDataFrame([(0, i, 5) for i in vids], "gid long, vid int, vlabel int")
        with pytest.raises(Exception, match="dense from 0"):
            graphs.to_rows(v, e).collect()


def test_dense_ids_and_global_scan_over_ranges(spark):
    r = random.Random(1)
    ids = r.sample(range(-(10**12), 10**12), 700)
    rows = spark.createDataFrame([(i, k % 7) for k, i in enumerate(ids * 2)], "gid long, v long")
    got = dict(embeddings.dense_ids(rows, "gid", "d", parts=9).collect())
    assert got == {i: k for k, i in enumerate(sorted(ids))}
    assert embeddings.dense_ids(rows.limit(0), "gid", "d").collect() == []
    plain = spark.createDataFrame([(i, k % 7) for k, i in enumerate(ids)], "gid long, v long")
    want, total = {}, 0
    for i, k in sorted((i, k % 7) for k, i in enumerate(ids)):
        total += k
        want[i] = total
    assert {x["gid"]: x["scan"] for x in segments.global_scan(plain, "v", "gid", parts=8).collect()} == want
    assert {x["gid"]: x["scan"] + x["v"] for x in segments.global_scan(plain, "v", "gid", inclusive=False).collect()} == want


def test_extensions_after_a_backward_edge(spark):
    last = column(spark, [(1, 0), (12, 3), (28, 5)])
    rows = spark.createDataFrame([(2,), (0,), (2,)], "row int")
    others = spark.createDataFrame([("x", 0, 7), ("x", 1, 8), ("y", 2, 28)], "ext string, back_link int, vertex_id int")
    assert sorted(tuple(x) for x in embeddings.derived_after_backward(last, rows, others).collect()) == [("x", 7, 0), ("y", 28, 1)]


def test_compaction_is_a_bijection_in_first_seen_order(spark):
    v = spark.createDataFrame([(0, 0, 100), (0, 1, 7), (1, 0, 7), (1, 1, 50)], "gid long, vid int, vlabel int")
    e = spark.createDataFrame([(0, 0, 1, 200), (1, 0, 1, 3)], "gid long, src int, dst int, elabel int")
    cv, ce, dv, de = cleaning.compact_labels(v, e)
    assert sorted(tuple(r) for r in dv.collect()) == [(7, 1), (50, 2), (100, 0)]
    assert sorted(tuple(r) for r in de.collect()) == [(3, 1), (200, 0)]
    assert sorted(tuple(r) for r in cv.collect()) == [(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 2)]
    assert sorted(tuple(r) for r in ce.collect()) == [(0, 0, 1, 0), (1, 0, 1, 1)]


def test_statistics(spark):
    codes = spark.createDataFrame([("(0 1 0 0 0);(1 2 0 0 0);(2 0 0 0 0)",), ("(0 1 0 0 0)",), ("",)], "code string")
    assert tuple(statistics.pattern_statistics(codes).first()) == (2, 3, 2.0, 1, 0.5)
    triangle = spark.createDataFrame([(0, a, b) for a in range(3) for b in range(3) if a != b] + [(1, 0, 1), (1, 1, 0)], "gid long, src int, dst int")
    assert sorted(tuple(r) for r in statistics.clustering(triangle).collect()) == [(0, 2.0, 1.0), (1, 1.0, 0.0)]
    lines = spark.createDataFrame([("INFO [VAL] x [total_time=3.5] [n=4]",), ("INFO [n=9]",)], "value string")
    assert sorted(tuple(r) for r in statistics.log_values(lines).collect()) == [("n", "4"), ("total_time", "3.5")]
    results = spark.createDataFrame([(1, 1, 10, 8.0), (1, 2, 10, 2.0), (1, 1, 20, 1.0)], "iddb int, idexp int, support int, execution_time double")
    assert [tuple(r) for r in statistics.speedup(results, 2, 1).collect()] == [(1, 10, 2, 2.0, 1, 8.0, 4.0)]
