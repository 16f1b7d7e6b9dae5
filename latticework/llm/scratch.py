"""Tables between the steps of an operator, written to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark removes a query's shuffle files when it ends, instead of when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Without one, a session in a single process gets a temporary folder; on a cluster that would
    be a folder of one machine, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return tempfile.mkdtemp(prefix="scratch-")


@contextmanager
def cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Scratch:
    """One run's tables. A written table cuts lineage: a lost executor costs the tasks it ran.

    A table is dropped once nothing will read it; what a result still reads goes when the session
    ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.paths = spark, {}
        self.folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._system()[0].deleteOnExit(self._system()[1])

    def _system(self, path: str | None = None):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path or self.folder)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def keep(self, df: DataFrame, **options: str) -> DataFrame:
        """The rows, written and to be read again."""
        path = f"{self.folder}/{len(self.paths)}"
        with cleaned_shuffles(self.spark):
            df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            system, path = self._system(self.paths[id(table)][0])
            system.delete(path, True)


def kept(df: DataFrame) -> DataFrame:
    """The rows, written once to a folder of their own that goes when the session ends."""
    return Scratch(df.sparkSession, "kept").keep(df)
