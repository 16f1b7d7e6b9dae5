"""Scans and reductions over segments, selection by predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def segmented_scan(rows: DataFrame, value: str, order: list[str], segment: list[str], inclusive: bool = True) -> DataFrame:
    """rows with ``scan``: the running sum within each segment, with or without the row itself."""
    w = W.partitionBy(*segment).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.sum(value).over(w)
    return rows.withColumn("scan", total if inclusive else total - F.col(value))


def global_scan(rows: DataFrame, value: str, order: str, inclusive: bool = True, parts: int = 200) -> DataFrame:
    """rows with ``scan``: the running sum over all rows in the order of a numeric column without repeats.

    Rows are cut into ranges at quantiles; a range's sums start after those of the ranges before
    it, whose totals, ``parts`` at most, come to the driver. No task sorts all rows.
    """
    cuts = sorted(set(rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)])).first()[0] or []))
    part = F.size(F.filter(F.lit(cuts), lambda c: c < F.col(order))) if cuts else F.lit(0)
    placed = rows.withColumn("part", part)
    totals, starts, total = {r["part"]: r["total"] for r in placed.groupBy("part").agg(F.sum(value).alias("total")).collect()}, [], 0
    for i in range(len(cuts) + 1):
        starts.append(total)
        total += totals.get(i) or 0
    w = W.partitionBy("part").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    running = F.sum(value).over(w) + F.element_at(F.lit(starts), F.col("part") + 1)
    return placed.withColumn("scan", running if inclusive else running - F.col(value)).drop("part")


def segmented_reduce(rows: DataFrame, value: str, segment: list[str]) -> DataFrame:
    """Sum of each segment."""
    return rows.groupBy(*segment).agg(F.sum(value).alias("total"))


def mark_segments(rows: DataFrame, flag: str, order: list[str], group: list[str]) -> DataFrame:
    """rows with ``segment``: the number of set flags up to and including the row, from 1 in each group."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("segment", F.sum(F.col(flag).cast("int")).over(w))


def copy_if(rows: DataFrame, predicate: Column) -> DataFrame:
    """Rows that satisfy the predicate, numbered by the caller's order if need be."""
    return rows.filter(predicate)
