"""Molecule and protein files: MOL blocks, compound numbers, joined label files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.sources.graph_files import read_fsg

# Atomic numbers by symbol, in order from hydrogen on.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn"
).split()


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """A table of graphs from MOL blocks (V2000): vertex labels are atomic numbers, edge labels 0.

    Blocks end at ``$$$$``; one without atoms gives no graph. Unknown symbols have label 0.
    """
    blocks = spark.read.option("lineSep", "$$$$").text(path).withColumn("at", F.monotonically_increasing_id())
    lines = F.split(F.regexp_replace("value", r"^\r?\n", ""), r"\r?\n")
    head = blocks.select("at", lines.alias("l")).filter(F.size("l") > 4)
    counts = F.get("l", F.lit(3))
    sized = head.select("at", "l", F.trim(counts.substr(1, 3)).cast("int").alias("n"), F.trim(counts.substr(4, 3)).cast("int").alias("m")).filter("n > 0")
    codes = F.create_map(*[F.lit(x) for i, s in enumerate(SYMBOLS) for x in (s, i + 1)])
    symbol = lambda line: F.trim(line.substr(32, 3))
    atoms = F.transform(F.slice("l", F.lit(5), F.col("n")), lambda x: F.coalesce(F.try_element_at(codes, symbol(x)), F.lit(0)).cast("int"))
    end = lambda line, at: F.trim(line.substr(at, 3)).cast("int") - 1
    bonds = F.transform(F.slice("l", F.col("n") + 5, F.col("m")), lambda x: F.struct(end(x, 1).alias("src"), end(x, 4).alias("dst"), F.lit(0).alias("elabel")))
    graphs = sized.select("at", atoms.alias("vlabels"), bonds.alias("edges"))
    parts = graphs.withColumn("part", F.spark_partition_id())
    sizes = parts.groupBy("part").count().withColumn("start", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    local = parts.withColumn("r", F.row_number().over(W.partitionBy("part").orderBy("at")) - 1)
    return local.join(F.broadcast(sizes.select("part", "start")), "part").select((F.col("start") + F.col("r")).alias("gid"), "vlabels", "edges")


def compound_numbers(spark: SparkSession, path: str) -> DataFrame:
    """number: the lines that follow a line with the marker ``NSC`` within each record of a structure file."""
    blocks = spark.read.option("lineSep", "$$$$").text(path)
    lines = F.split("value", r"\r?\n")
    after = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("line"), (F.get(lines, i - 1).rlike(r"<.*NSC.*>") & (i > 0)).alias("hit"))), lambda s: s["hit"])
    return blocks.select(F.explode(after).alias("s")).select(F.trim("s.line").alias("number")).filter("number != ''")


def join_protein_graphs(spark: SparkSession, path: str) -> DataFrame:
    """Graphs of all files of a folder, vertex labels in one dictionary by first appearance, edge labels 0."""
    rows = read_fsg(spark, path)
    return rows.withColumn("edges", F.transform("edges", lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), F.lit(0).alias("elabel"))))
