"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.scratch import Scratch


def connected(links: DataFrame, most_rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """node, comp for every node of ``links`` (a, b): comp is the component's smallest node.

    Each round a node takes the least label around it, hands it to the label it had before, and
    labels then follow one pointer; so the rounds grow with the logarithm of a chain. Neighbours'
    labels are pre-added by min, a hub's many links included. Rows with a null, and links of a
    node to itself, don't count beyond naming the node. Each round's labels are written to
    ``scratch``, the caller's or one of its own, and those of the round before dropped.
    """
    scratch = scratch or Scratch(links.sparkSession, "components")
    known = links.filter("a is not null and b is not null")
    ways = scratch.keep(known.select("a", "b").union(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.keep(ways.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("comp"), F.lit(True).alias("moved")))
    for _ in range(most_rounds):
        around = ways.join(labels.select(F.col("node").alias("b"), "comp"), "b").select(F.col("a").alias("node"), "comp")
        least = around.groupBy("node").agg(F.min("comp").alias("seen"))
        seen = labels.join(least, "node").select("node", "comp", F.least("comp", "seen").alias("next"))
        handed = seen.filter("next < comp").select(F.col("comp").alias("node"), F.col("next"))
        merged = seen.select("node", "next").union(handed).groupBy("node").agg(F.min("next").alias("next"))
        jump = merged.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = merged.join(jump, "next").select("node", F.least("next", "far").alias("comp"))
        after = scratch.keep(after.join(labels.select("node", F.col("comp").alias("was")), "node").select("node", "comp", (F.col("comp") != F.col("was")).alias("moved")))
        scratch.drop(labels)
        labels = after
        if labels.filter("moved").isEmpty():
            scratch.drop(ways)
            return labels.select("node", "comp")
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
