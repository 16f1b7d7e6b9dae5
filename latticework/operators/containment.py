"""Which graphs contain a pattern, by joining the adjacency once for each edge of its code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.dfscode import Code, fill_labels


def embeddings_of(adj: DataFrame, code: Code) -> DataFrame:
    """gid, vmap of every occurrence of the pattern, distinct vertices for distinct pattern vertices."""
    full = fill_labels(code)
    if not full:
        raise ValueError("an empty code has no occurrences")
    _, _, fl, el, tl = full[0]
    found = adj.filter((F.col("slabel") == fl) & (F.col("elabel") == el) & (F.col("dlabel") == tl)).select("gid", F.array("src", "dst").alias("vmap"))
    for f, t, fl, el, tl in full[1:]:
        step = adj.filter((F.col("slabel") == fl) & (F.col("elabel") == el) & (F.col("dlabel") == tl)).select("gid", "src", "dst")
        at = found.withColumn("src", F.get("vmap", F.lit(f)))
        if f < t:
            found = at.join(step, ["gid", "src"]).filter(~F.array_contains("vmap", F.col("dst"))).select("gid", F.concat("vmap", F.array("dst")).alias("vmap"))
        else:
            found = at.withColumn("dst", F.get("vmap", F.lit(t))).join(step, ["gid", "src", "dst"], "left_semi").select("gid", "vmap")
    return found


def containing(adj: DataFrame, code: Code) -> DataFrame:
    """gid of the graphs that contain the pattern."""
    return embeddings_of(adj, code).select("gid").distinct()
