"""One-edge supports of a growing collection, kept up to date by a stream of graphs.

Each micro-batch's supports are added to a table of running totals. Graphs don't change once
they have arrived, so the support of a pattern over all batches is the sum of its supports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from latticework.operators.graphs import adjacency_of
from latticework.plans.mining import seed_support
from latticework.sources.results_store import exists

SCHEMA = "batch long, fl int, el int, tl int, support long"


def totals(spark, folder: str) -> DataFrame:
    """fl, el, tl, support over all batches so far."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "fl int, el int, tl int, support long")
    rows = spark.read.schema(SCHEMA).parquet(folder)
    return rows.groupBy("fl", "el", "tl").agg(F.sum("support").alias("support"))


def follow(graphs: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts a stream of graph tables into ``folder``; a batch that runs again replaces its own rows."""

    def add(batch: DataFrame, number: int) -> None:
        rows = seed_support(adjacency_of(batch)).select("fl", "el", "tl", "support")
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return graphs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
