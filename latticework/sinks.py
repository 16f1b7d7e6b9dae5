"""Where mined patterns go: a count, memory, or files with supports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count(patterns: DataFrame) -> int:
    return patterns.count()


def in_memory(patterns: DataFrame) -> DataFrame:
    """The patterns, kept for repeated use."""
    kept = patterns.cache()
    kept.count()
    return kept


def to_text(patterns: DataFrame, path: str, with_support: bool = True) -> None:
    """A line for each pattern: its code, and its support after a tab."""
    line = F.concat_ws("\t", "code", F.col("support").cast("string")) if with_support else F.col("code")
    patterns.select(line.alias("value")).write.text(path)


def to_parquet(patterns: DataFrame, path: str) -> None:
    patterns.write.parquet(path)
