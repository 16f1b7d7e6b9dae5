"""Command line: ``mine``, ``stats``, ``convert`` and ``pattern-stats``.

    python -m latticework.cli mine <format> <file> <minsup> [<out>]
    python -m latticework.cli stats <format> <file>
    python -m latticework.cli convert <format-in> <in> <format-out> <out>
    python -m latticework.cli pattern-stats <file>

Exit codes of ``mine``: 1 for wrong arguments, 2 if the support isn't below the number of graphs,
3 if it is below 1.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from latticework import sinks
from latticework.metrics import Metrics
from latticework.operators import cleaning, graphs, statistics
from latticework.plans import mining
from latticework.sources import graph_files


def main(args: list[str], spark: SparkSession | None = None) -> int:
    usage = {"mine": (4, 5), "stats": (3,), "convert": (5,), "pattern-stats": (2,)}
    if not args or len(args) not in usage.get(args[0], ()):
        print(__doc__)
        return 1
    spark = spark or SparkSession.builder.getOrCreate()
    if args[0] == "pattern-stats":
        patterns = spark.read.text(args[1]).selectExpr("split(value, '\t')[0] AS code")
        print(statistics.pattern_statistics(patterns).first().asDict())
        return 0
    table = graph_files.read_graphs(spark, args[1], args[2])
    if args[0] == "stats":
        print(statistics.collection_statistics(table).first().asDict())
        return 0
    if args[0] == "convert":
        vertices, edges = cleaning.fix_database(graphs.vertices_of(table), graphs.edges_of(table))
        graph_files.write_graphs(graphs.to_rows(vertices, edges), args[3], args[4])
        return 0
    minsup, n = int(args[3]), table.count()
    if minsup >= n:
        return 2
    if minsup < 1:
        return 3
    metrics = Metrics()
    with metrics.timed("total_time"):
        patterns = mining.mine(graphs.adjacency_of(table), minsup, strategy=mining.Strategy(on_level=[metrics.levels]))
        metrics.put("total_frequent_graphs", sinks.count(patterns))
        if len(args) == 5 and args[4] != "-":
            sinks.to_text(patterns, args[4])
    print(metrics.report())
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
