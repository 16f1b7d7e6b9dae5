import datetime

import pytest

from latticework import cli, sinks
from latticework.metrics import Metrics
from latticework.operators import graphs, statistics
from latticework.plans import mining
from latticework.sources import generator, graph_files, molecules, results_store
from latticework.streaming import seed_stream

MOL = """name
  made by hand

  3  2  0  0  0  0  0  0  0  0999 V2000
    0.0000    0.0000    0.0000 C   0  0  0  0  0  0
    1.0000    0.0000    0.0000 O   0  0  0  0  0  0
    2.0000    0.0000    0.0000 Cl  0  0  0  0  0  0
  1  2  1  0
  2  3  2  0
M  END
>  <NSC>
4711

$$$$
"""


def test_molecules(spark, tmp_path):
    (tmp_path / "a.sdf").write_text(MOL + MOL)
    rows = molecules.read_sdf(spark, str(tmp_path)).orderBy("gid").collect()
    assert [(r["gid"], r["vlabels"], [tuple(e) for e in r["edges"]]) for r in rows] == [(i, [6, 8, 17], [(0, 1, 0), (1, 2, 0)]) for i in range(2)]
    assert [r["number"] for r in molecules.compound_numbers(spark, str(tmp_path)).collect()] == ["4711", "4711"]


def test_protein_graphs_share_a_dictionary(spark, tmp_path):
    (tmp_path / "a").write_text("t # 0\nv 0 ALA\nv 1 GLY\nu 0 1 x\n")
    (tmp_path / "b").write_text("t # 0\nv 0 GLY\nv 1 ALA\nu 0 1 y\n")
    rows = molecules.join_protein_graphs(spark, str(tmp_path)).orderBy("gid").collect()
    assert [r["vlabels"] for r in rows] == [[0, 1], [1, 0]] and all(e["elabel"] == 0 for r in rows for e in r["edges"])


def test_generated_patterns_have_their_support(spark):
    table, patterns = generator.generate(spark, 60, n_patterns=3, pattern_edges=3, min_support=10, noise_edges=2, seed=5)
    again, _ = generator.generate(spark, 60, n_patterns=3, pattern_edges=3, min_support=10, noise_edges=2, seed=5)
    assert table.count() == 60 and table.exceptAll(again).count() == 0
    from latticework.functions import dfscode as D

    found = dict(mining.mine_codes(graphs.adjacency_of(table), 10, 3))
    for labels, edges in patterns:
        adjacent = {}
        for a, b, el in edges:
            adjacent.setdefault(a, {})[b] = el
            adjacent.setdefault(b, {})[a] = el
        assert found[D.minimum_code(dict(enumerate(labels)), adjacent)] >= 10
    with pytest.raises(ValueError):
        generator.generate(spark, 5, min_support=6)


def test_results_store(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 10, 2.5), (1, 1, 10, 9.9), (1, 2, 10, 1.0)], results_store.SCHEMAS["experiment_result"][0])
    folder = str(tmp_path / "store")
    assert results_store.append(rows, folder, "experiment_result") == 2
    assert results_store.append(rows, folder, "experiment_result") == 0
    assert results_store.read(spark, folder, "experiment_result").count() == 2
    about = spark.createDataFrame([(1, "first", "levels", datetime.datetime(2020, 1, 1))], results_store.SCHEMAS["experiment_description"][0])
    assert results_store.append(about, folder, "experiment_description") == 1
    assert results_store.read(spark, folder, "databases").collect() == []


def test_command_line(spark, tmp_path, capsys):
    table, _ = generator.generate(spark, 12, n_patterns=2, pattern_edges=2, min_support=6, noise_edges=1, seed=2)
    path = str(tmp_path / "graphs")
    graph_files.write_graphs(table, "txt", path)
    assert cli.main([], spark) == 1 and cli.main(["mine", "txt"], spark) == 1
    assert cli.main(["mine", "txt", path, "12"], spark) == 2 and cli.main(["mine", "txt", path, "0"], spark) == 3
    out = str(tmp_path / "patterns")
    assert cli.main(["mine", "-txt", path, "6", out], spark) == 0
    n = spark.read.text(out).count()
    assert f"[total_frequent_graphs={n}]" in capsys.readouterr().out and n > 0
    assert cli.main(["pattern-stats", out], spark) == 0 and cli.main(["stats", "txt", path], spark) == 0
    assert cli.main(["convert", "txt", path, "bin", str(tmp_path / "b")], spark) == 0
    assert graph_files.read_bin(spark, str(tmp_path / "b")).count() == 12


def test_sinks(spark, tmp_path):
    table, _ = generator.generate(spark, 12, n_patterns=2, pattern_edges=2, min_support=6, noise_edges=1, seed=2)
    patterns = sinks.in_memory(mining.mine(graphs.adjacency_of(table), 6))
    sinks.to_parquet(patterns, str(tmp_path / "p"))
    sinks.to_text(patterns, str(tmp_path / "t"), with_support=False)
    assert spark.read.parquet(str(tmp_path / "p")).count() == sinks.count(patterns) == spark.read.text(str(tmp_path / "t")).count()


def test_stream_totals_equal_the_batch(spark, tmp_path):
    table, _ = generator.generate(spark, 20, n_patterns=2, pattern_edges=2, min_support=6, noise_edges=2, seed=3)
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    table.repartition(3).write.parquet(source)
    assert seed_stream.totals(spark, folder).collect() == []
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(source)
    seed_stream.follow(stream, folder, str(tmp_path / "state")).awaitTermination()
    assert set(seed_stream.totals(spark, folder).collect()) == set(mining.seed_support(graphs.adjacency_of(table)).collect())


def test_metrics_are_read_back(spark):
    m = Metrics()
    with m.timed("seconds"):
        m.add("n", 2)
        m.add("n")
    m.put("name", "x")
    m.levels([(((0, 1, 0, 0, 0),), 5), (((0, 1, 0, 0, 1),), 3)])
    lines = spark.createDataFrame([(m.report(),), ("[n=9]",)], "value string")
    got = {r["name"]: r["value"] for r in statistics.log_values(lines).collect()}
    assert got["n"] == "3" and got["name"] == "x" and float(got["seconds"]) >= 0 and got["patterns_1"] == "2" and got["levels"] == "1"
