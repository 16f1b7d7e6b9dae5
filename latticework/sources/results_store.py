"""Benchmark results as three append-only tables under one folder.

databases(iddb, name), experiment_description(idexp, description, variant, date) and
experiment_result(iddb, idexp, support, execution_time). A row whose key is there already isn't
written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "databases": ("iddb int, name string", ["iddb"]),
    "experiment_description": ("idexp int, description string, variant string, date timestamp", ["idexp"]),
    "experiment_result": ("iddb int, idexp int, support int, execution_time double", ["iddb", "idexp", "support"]),
}


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table's rows; none if it was never written."""
    schema, _ = SCHEMAS[table]
    if not exists(spark, f"{folder}/{table}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{table}")


def append(rows: DataFrame, folder: str, table: str) -> int:
    """Adds rows with new keys, one for each key; returns how many."""
    schema, keys = SCHEMAS[table]
    spark = rows.sparkSession
    columns = [c.split()[0] for c in schema.split(", ")]
    fresh = rows.select(*columns).dropDuplicates(keys).join(read(spark, folder, table).select(*keys), keys, "left_anti").select(*columns).persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(f"{folder}/{table}")
    fresh.unpersist()
    return n
