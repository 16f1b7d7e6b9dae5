"""Synthetic graph collections with planted patterns."""

from __future__ import annotations

import random
from collections.abc import Iterator
from math import gcd

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.sources.graph_files import ROWS, arrow_rows

Graph = tuple[list[int], list[tuple[int, int, int]]]


def random_pattern(r: random.Random, edges: int, vertex_labels: int, edge_labels: int) -> Graph:
    """A random connected simple graph: a tree, then chords where there is room."""
    labels, links = [r.randrange(vertex_labels)], {}
    while len(links) < edges:
        a = r.randrange(len(labels))
        if r.random() < 0.3 and len(labels) > 2:
            b = r.randrange(len(labels))
            if a != b and (min(a, b), max(a, b)) not in links:
                links[min(a, b), max(a, b)] = r.randrange(edge_labels)
                continue
        labels.append(r.randrange(vertex_labels))
        links[a, len(labels) - 1] = r.randrange(edge_labels)
    return labels, [(a, b, el) for (a, b), el in sorted(links.items())]


def generate(
    spark: SparkSession, n_graphs: int, n_patterns: int = 50, pattern_edges: int = 4, min_support: int = 10, noise_edges: int = 5, vertex_labels: int = 5, edge_labels: int = 5, seed: int = 1
) -> tuple[DataFrame, list[Graph]]:
    """A table of graphs, and the patterns of which each is in min_support to min_support + 10 of them.

    A pattern's graphs follow from its number, so graphs are built side by side, each from its own
    seed: its patterns, one edge from each to the one before, then noise edges to new vertices.
    """
    if not 0 < min_support <= n_graphs:
        raise ValueError("the minimum support must be between 1 and the number of graphs")
    r = random.Random(seed)
    patterns = [random_pattern(r, pattern_edges, vertex_labels, edge_labels) for _ in range(n_patterns)]
    plans = []
    for p in range(n_patterns):
        stride = next(s for s in iter(lambda: r.randrange(1, n_graphs + 1), None) if gcd(s, n_graphs) == 1)
        plans.append((p, r.randrange(n_graphs), stride, min(n_graphs, min_support + r.randrange(11))))
    planted = spark.createDataFrame(plans, "p int, start long, stride long, k long").select(
        F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda i: (F.col("start") + i * F.col("stride")) % n_graphs)).alias("gid"), "p"
    )
    own = planted.groupBy("gid").agg(F.array_sort(F.collect_list("p")).alias("own"))
    rows = spark.range(n_graphs).toDF("gid").join(own, "gid", "left")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for gid, chosen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                dice = random.Random(seed * 1_000_003 + gid)
                labels: list[int] = []
                edges: list[tuple[int, int, int]] = []
                for p in chosen or []:
                    base = len(labels)
                    labels += patterns[p][0]
                    edges += [(base + a, base + b, el) for a, b, el in patterns[p][1]]
                    if base:
                        edges.append((dice.randrange(base), base, dice.randrange(edge_labels)))
                labels = labels or [dice.randrange(vertex_labels)]
                for _ in range(noise_edges):
                    edges.append((dice.randrange(len(labels)), len(labels), dice.randrange(edge_labels)))
                    labels.append(dice.randrange(vertex_labels))
                out.append((gid, labels, edges))
            yield arrow_rows(out)

    return rows.mapInArrow(build, ROWS), patterns
