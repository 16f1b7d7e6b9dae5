"""Operators on embeddings and extension rows, outside the mining loop.

Embedding columns follow the column layout: a column is a table (place, vertex_id, back_link),
back_link being the place of the row in the column before. Extension rows are
(from, to, fl, el, tl, from_grph, to_grph, row) with global vertex numbers, as ``f`` and ``t`` here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def graph_of(global_vertex: str, max_vertices: int) -> Column:
    """Graph number of a global vertex number."""
    return F.floor(F.col(global_vertex) / max_vertices).cast("long")


def distinct_support(extensions: DataFrame, max_vertices: int) -> DataFrame:
    """f, t, fl, el, tl, support: distinct graphs of each extension."""
    keys = ["f", "t", "fl", "el", "tl"]
    return extensions.select(*keys, graph_of("from_grph", max_vertices).alias("gid")).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("support"))


def extension_graphs(extensions: DataFrame, max_vertices: int) -> DataFrame:
    """f, t, fl, el, tl, gid: the graphs of each extension, whose number is its support."""
    return extensions.select("f", "t", "fl", "el", "tl", graph_of("from_grph", max_vertices).alias("gid")).distinct()


def backward_filter(column: DataFrame, extensions: DataFrame, edge: tuple[int, int, int, int, int]) -> DataFrame:
    """Rows of the last embedding column that a backward extension closes: a left semi join on the row."""
    match = [F.col(c) == v for c, v in zip(("f", "t", "fl", "el", "tl"), edge)]
    closing = extensions
    for m in match:
        closing = closing.filter(m)
    return column.join(closing.select(F.col("row").alias("place")), "place", "left_semi")


def forward_column(extensions: DataFrame, edge: tuple[int, int, int, int, int]) -> DataFrame:
    """The new embedding column of a forward extension: (vertex_id, back_link) by row and vertex, place from 0."""
    chosen = extensions
    for c, v in zip(("f", "t", "fl", "el", "tl"), edge):
        chosen = chosen.filter(F.col(c) == v)
    return chosen.select(F.col("to_grph").alias("vertex_id"), F.col("row").alias("back_link"))


def forward_intersection(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two forward columns of one parent: pairs of one back_link with different vertices.

    The result's vertex is the second column's and its link the place of the first column's row.
    """
    a = first.select("back_link", F.col("vertex_id").alias("v1"), F.col("place").alias("link"))
    b = second.select("back_link", F.col("vertex_id").alias("v2"))
    return a.join(b, "back_link").filter("v1 != v2").select(F.col("v2").alias("vertex_id"), F.col("link").alias("back_link"))


def backward_forward_intersection(last: DataFrame, backward_rows: DataFrame, forward: DataFrame) -> DataFrame:
    """A forward column over the last column's rows that a backward extension keeps.

    Kept rows are numbered anew, and the forward column's links follow.
    """
    kept = last.join(backward_rows.select(F.col("row").alias("place")).distinct(), "place", "left_semi")
    numbered = dense_ids(kept, "place", "link").withColumnRenamed("place", "back_link")
    return forward.join(numbered, "back_link").select("vertex_id", F.col("link").alias("back_link"))


def backward_intersection(first: DataFrame, second: DataFrame) -> DataFrame:
    """Places of the first column whose (back_link, vertex_id) the second has too."""
    return first.join(second.select("back_link", "vertex_id").distinct(), ["back_link", "vertex_id"], "left_semi").select("place")


def graph_intersection(first: DataFrame, second: DataFrame) -> DataFrame:
    """n: number of graphs that both tables (gid) have."""
    return first.select("gid").intersect(second.select("gid")).agg(F.count(F.lit(1)).alias("n"))


def merge_extensions(fresh: DataFrame, inherited: DataFrame, keys: list[str]) -> DataFrame:
    """Inherited extensions and those fresh ones that weren't inherited."""
    return inherited.unionByName(fresh.join(inherited.select(*keys), keys, "left_anti"))


def derived_extensions(last: DataFrame, others: DataFrame) -> DataFrame:
    """Extensions of a child, from its own last column and the other extensions of its parent.

    others: (ext, back_link, vertex_id) of the parent's further extensions. Returns ext, vertex_id
    and the child row (back_link), an inner join on the parent's row with differing vertices.
    """
    a = last.select("back_link", F.col("vertex_id").alias("own"), F.col("place").alias("link"))
    return others.join(a, "back_link").filter("own != vertex_id").select("ext", "vertex_id", F.col("link").alias("back_link"))


def derived_after_backward(last: DataFrame, backward_rows: DataFrame, others: DataFrame) -> DataFrame:
    """Extensions of a child that a backward edge has made: its parent's forward ones, on the rows that stay.

    others: (ext, back_link, vertex_id) of the parent's forward extensions. The rows that the
    backward extension keeps are numbered anew; an extension's rows follow them. The backward
    edge adds no vertex, so none has to differ.
    """
    kept = last.join(backward_rows.select(F.col("row").alias("place")).distinct(), "place", "left_semi")
    numbered = dense_ids(kept, "place", "link").withColumnRenamed("place", "back_link")
    return others.join(numbered, "back_link").select("ext", "vertex_id", F.col("link").alias("back_link"))


def occurrence_counts(embeddings: DataFrame) -> DataFrame:
    """pid, gid, n: embeddings of each pattern in each graph."""
    return embeddings.groupBy("pid", "gid").agg(F.count(F.lit(1)).alias("n"))


def dense_ids(rows: DataFrame, id_col: str, out: str, by: str | None = None, parts: int = 200) -> DataFrame:
    """id_col and its dense number from 0, in order, without sorting all ids in one task.

    Ids are cut into ranges at quantiles of ``by``, a number that never falls as the id rises (by
    default the id itself); a range's numbers start after the ids of those before it. What comes
    to the driver is the bounds and sizes of ``parts`` ranges at most.
    """
    by = by or id_col
    ids = rows.select(*dict.fromkeys([id_col, by])).distinct()
    shares = [i / parts for i in range(1, parts)]
    cuts = sorted(set(ids.agg(F.percentile_approx(by, shares)).first()[0] or []))
    part = F.lit(0)
    if cuts:
        part = F.size(F.filter(F.lit(cuts), lambda c: c < F.col(by)))
    placed = ids.select(id_col, part.alias("part"))
    sizes, starts, total = dict(placed.groupBy("part").count().collect()), [], 0
    for i in range(len(cuts) + 1):
        starts.append(total)
        total += sizes.get(i, 0)
    start = F.element_at(F.lit(starts).cast("array<bigint>"), F.col("part") + 1)
    return placed.withColumn("r", F.row_number().over(W.partitionBy("part").orderBy(id_col))).select(id_col, (start + F.col("r") - 1).alias(out))


def block_heads(rows: DataFrame, keys: list[str], order: list[str], group: list[str]) -> DataFrame:
    """rows with ``head``: whether ``keys`` differ from the row before, within ``group``."""
    w = W.partitionBy(*group).orderBy(*order)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(w))
    return rows.withColumn("head", F.when(F.row_number().over(w) == 1, F.lit(True)).otherwise(~same))


def block_lengths(heads: DataFrame, offset: str, total: str, group: list[str]) -> DataFrame:
    """heads with ``length``: the next head's offset, or the total, less its own."""
    following = F.lead(offset).over(W.partitionBy(*group).orderBy(offset))
    return heads.withColumn("length", F.coalesce(following, F.col(total)) - F.col(offset))
