import random

import pytest
from pyspark.sql import functions as F

from latticework.sources import graph_files as G

COLLECTION = [([3, 1, 4], [(0, 1, 5), (1, 2, 6)]), ([2, 2], [(0, 1, 0)]), ([9], []), ([1, 1, 1, 1], [(0, 1, 0), (0, 3, 1), (1, 2, 1), (2, 3, 0)])]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, v, e) for i, (v, e) in enumerate(COLLECTION)], "gid long, vlabels array<int>, edges array<struct<src:int,dst:int,elabel:int>>")


def rows(df):
    return [(r["gid"], r["vlabels"], sorted(tuple(e) for e in r["edges"])) for r in df.orderBy("gid").collect()]


@pytest.mark.parametrize("fmt", ["txt", "-bin", "cudabin"])
def test_round_trip(spark, table, tmp_path, fmt):
    path = str(tmp_path / "graphs")
    G.write_graphs(table, fmt, path)
    assert rows(G.read_graphs(spark, fmt, path)) == rows(table)


def test_text_quirks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("t # 7\nv 0 1\nv 1 2\ne 0 1 3\n\nt # 8\nt # 9\nv 0 4\n# note\n")
    assert rows(G.read_txt(spark, str(tmp_path))) == [(0, [1, 2], [(0, 1, 3)]), (1, [4], [])]
    (tmp_path / "a.txt").write_text("t # 0\nv 0 1\ne 0 5 3\n")
    with pytest.raises(Exception, match="define vertices before edges"):
        G.read_txt(spark, str(tmp_path)).collect()


def test_string_labels(spark, tmp_path):
    (tmp_path / "a.fsg").write_text("t # 0\nv 0 C\nv 1 O\nu 0 1 single\nt # 1\nv 0 O\nv 1 C\nu 0 1 double\n")
    assert rows(G.read_fsg(spark, str(tmp_path))) == [(0, [0, 1], [(0, 1, 0)]), (1, [1, 0], [(0, 1, 1)])]
    assert rows(G.read_fsg(spark, str(tmp_path), per_graph_labels=True)) == [(0, [0, 1], [(0, 1, 0)]), (1, [0, 1], [(0, 1, 0)])]


def test_parts_make_the_whole(spark, table, tmp_path):
    path = str(tmp_path / "graphs")
    G.write_graphs(table, "bin", path)
    for total in (1, 2, 3):
        found = [r for part in range(total) for r in rows(G.read_bin(spark, path, total, part))]
        assert found == rows(table)
    assert [r["p"] for r in spark.range(7).select(G.part_of(F.col("id"), 7, 3).alias("p")).collect()] == [0, 0, 1, 1, 2, 2, 2]


def test_faults():
    with pytest.raises(ValueError):
        G.pack_bin([])
    raw = G.pack_bin(COLLECTION)
    with pytest.raises(ValueError):
        list(G.unpack_bin(raw + b"\0"))
    with pytest.raises(ValueError):
        G.graph_of_bytes(b"\x05\0\0\0")
    with pytest.raises(ValueError):
        G.file_format("xml")


def test_collections_of_one_graph_stay_apart(spark):
    one = spark.createDataFrame([(0, [1, 2], [(0, 1, 3)])], "gid long, vlabels array<int>, edges array<struct<src:int,dst:int,elabel:int>>")
    assert [r[0] for r in rows(G.concatenate([one, one.limit(0), one, one]))] == [0, 1, 2]


def test_gaps_in_vertex_numbers_fail(spark, tmp_path):
    (tmp_path / "a.txt").write_text("t # 0\nv 0 1\nv 2 1\nv 3 1\ne 0 2 3\n")
    with pytest.raises(Exception, match="dense from 0"):
        G.read_txt(spark, str(tmp_path)).collect()


def test_graphs_are_numbered_by_file_and_place(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.txt").write_text("".join(f"t # {i}\nv 0 {ord(name) * 10 + i}\n" for i in range(7)))
    assert [(r[0], r[1][0]) for r in rows(G.read_txt(spark, str(tmp_path)))] == [(k, v) for k, v in enumerate(ord(n) * 10 + i for n in "abc" for i in range(7))]


def test_large_collections_are_not_written_as_one_file(spark, table, tmp_path):
    before = G.MOST_BYTES
    G.MOST_BYTES = 10
    try:
        with pytest.raises(ValueError):
            G.write_graphs(table, "bin", str(tmp_path / "graphs"))
    finally:
        G.MOST_BYTES = before


def test_concatenation(table):
    assert [r[0] for r in rows(G.concatenate([table, table]))] == list(range(8))


@pytest.mark.parametrize("fmt", ["bin", "cudabin"])
def test_binary_files_are_written_and_read_in_pieces(spark, table, tmp_path, monkeypatch, fmt):
    """The driver holds a piece at a time, and the file is what one packing of all graphs gives."""
    monkeypatch.setattr(G, "PIECE_BYTES", 1)
    monkeypatch.setattr(G, "SLICE", 1)
    moved = table.unionByName(table.selectExpr("gid + 4 as gid", "vlabels", "edges")).withColumn("gid", 1000 - 7 * F.col("gid"))
    path = str(tmp_path / "graphs")
    G.write_graphs(moved, fmt, path)
    whole = [(v, e) for v, e in (COLLECTION * 2)[::-1]]
    with open(path, "rb") as f:
        assert f.read() == (G.pack_bin(whole) if fmt == "bin" else G.pack_columns(whole))
    assert G.read_graphs(spark, fmt, path).rdd.getNumPartitions() == 8
    assert rows(G.read_graphs(spark, fmt, path)) == [(i, v, e) for i, (v, e) in enumerate(whole)]


def test_fsg_records_are_parsed_whole(spark, tmp_path, monkeypatch):
    """Several files, odd spaces, empty records and lines of other kinds; equal to the joined way, without a shuffle."""
    r = random.Random(4)
    for name in "bac":
        lines = ["# a comment", "v 0 stray", "v 1 Ünder"] if name == "a" else []
        for g in range(40):
            n = r.choice([0, 1, 2, 5])
            lines += [f"t # {g}", "", "x 1 2"] + [f" v\t{i}  L{r.randrange(30)} more" for i in r.sample(range(n), n)]
            lines += [f"u {i - 1} {i} E{r.randrange(9)}\r" for i in range(1, n)] + (["u 0 9 lost"] if not n else [])
        (tmp_path / f"{name}.fsg").write_text("\n".join(lines) + "\n", newline="")
    found = G.read_fsg(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan
    one = rows(found)
    monkeypatch.setattr(G, "MOST_LABELS", 5)
    assert one == rows(G.read_fsg(spark, str(tmp_path))) and len(one) > 60


@pytest.mark.parametrize("text", ["t\nv 1 A\n", "t\nv 0 A\nv 0 B\n", "t\nv 0 A\nu 0 1 x\n", "t\nv 0 A\nu -1 0 x\n"])
def test_fsg_faults_fail(spark, tmp_path, text):
    (tmp_path / "a.fsg").write_text("t\nv 0 A\n" + text)
    with pytest.raises(Exception, match="dense from 0|vertices before edges"):
        G.read_fsg(spark, str(tmp_path)).collect()
