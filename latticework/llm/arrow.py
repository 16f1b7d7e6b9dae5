"""Shared plumbing for the Arrow-batched operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The executors run one task per core; a library must not start threads of its own.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("OMP_NUM_THREADS", "1")

#: Code points for which Python's and the tokenizers' character classes agree
#: (letters, numbers and white space of ASCII and Latin); U+0130 lower-cases to two code points.
PLAIN = "\t\n\r\x20-\x7e\xa0-įı-ɏ"
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼½¾"


def map_rows(
    df: DataFrame, columns: list[tuple[str, str, str]], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """mapInArrow over only the named columns: (source column, name inside, type).

    Other columns, whatever their names, never reach Python.
    """
    return df.select(*[F.col(f"`{src}`").cast(kind).alias(name) for src, name, kind in columns]).mapInArrow(fn, schema)


def chunks(batch: pa.RecordBatch, rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that memory follows a slice and not a batch."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


class Memo:
    """A bounded dict from a string to what it costs to compute.

    ``pinned`` entries stay; when more than ``cap`` others are held, they are dropped and
    computed again on demand, so the bound changes speed and never a result.
    """

    def __init__(self, compute: Callable[[list[str]], list], pinned: dict | None = None, cap: int = 300_000):
        self.compute, self.pinned, self.cap = compute, pinned or {}, cap
        self.known: dict = dict(self.pinned)

    def need(self, keys: set[str]) -> dict:
        """The dict, after every key of ``keys`` is in it."""
        if len(self.known) > self.cap + len(self.pinned):
            self.known = dict(self.pinned)
        known = self.known
        missing = [k for k in keys if k not in known]  # a set less a keys view would walk the view
        if missing:
            self.known.update(zip(missing, self.compute(missing), strict=True))
        return self.known
