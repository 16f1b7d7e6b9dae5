"""Codes in DataFrames: equality of edges as a column, and the edges of a code as a table function."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions import dfscode as D


def same_edge(a: Column, b: Column) -> Column:
    """Equal edges (structs f, t, fl, el, tl), a vertex label of -1 matching any; edge labels always count."""
    wild = lambda name: (a[name] == b[name]) | (a[name] == -1) | (b[name] == -1)
    return (a["f"] == b["f"]) & (a["t"] == b["t"]) & (a["el"] == b["el"]) & wild("fl") & wild("tl")


def minimum_codes(graphs: DataFrame) -> DataFrame:
    """gid, code: the smallest code of each connected graph with edges, as text; null for any other graph.

    A graph's row is worked on alone, in Arrow batches. Occurrences of a code's beginning are all
    kept, so graphs with many equal branches take long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [smallest(v, e) for v, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["gid", "code"])

    return graphs.select("gid", "vlabels", "edges").mapInArrow(run, "gid long, code string")


def smallest(vlabels: list[int], edges: list[dict]) -> str | None:
    adjacent: dict[int, dict[int, int]] = {}
    for e in edges:
        adjacent.setdefault(e["src"], {})[e["dst"]] = e["elabel"]
        adjacent.setdefault(e["dst"], {})[e["src"]] = e["elabel"]
    seen, todo = set(), [0]
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += adjacent.get(v, ())
    if not edges or len(seen) < len(vlabels):
        return None
    return D.format_code(D.minimum_code(dict(enumerate(vlabels)), adjacent))


@F.udtf(returnType="f int, t int, fl int, el int, tl int")
class dfs_edges:  # noqa: N801  called like a function
    """A row for each edge of a code's text; none for an empty or null one."""

    def eval(self, code: str):
        yield from D.parse(code or "")
