"""Frequent connected subgraph patterns, level by level.

A level is one pass over the classes of equal graphs (``classes``): embeddings of the level's
patterns are walked in numpy to the places where a pattern may grow, and what can be grown is
counted by distinct graph; the frequent growths come to the driver, which keeps the canonical ones
and sends their dictionary back. Nothing but the count is shuffled, and no embedding is kept.

The single steps of a level are DataFrame plans too, partitioned by gid, for the queries that look at them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import dfscode as D
from latticework.plans import classes as C

#: Rows of a driver-made or counted table up to which it is broadcast (some 100 MB); longer ones are joined by shuffle.
MOST_BROADCAST = 1_000_000
PATTERNS = "code string, n_edges int, n_vertices int, support long"


def small(table: DataFrame, n: int) -> DataFrame:
    """table, to be broadcast if its number of rows allows."""
    return F.broadcast(table) if n <= MOST_BROADCAST else table


@contextmanager
def co_partitioned(spark: SparkSession):
    """Lets joins on (gid, vertex) use a partitioning by gid alone; the setting is restored."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def check_support(minsup: int, n_graphs: int | None = None, strict: bool = False) -> None:
    """ValueError for a support below 1, or, when strict, one not below the number of graphs."""
    if minsup < 1:
        raise ValueError("the minimum support must be at least 1")
    if strict and n_graphs is not None and minsup >= n_graphs:
        raise ValueError("the minimum support must be less than the number of graphs")


def seed_support(adj: DataFrame) -> DataFrame:
    """fl, el, tl, support of one-edge patterns: edges from a smaller or equal label, by distinct graph."""
    roots = adj.filter("slabel <= dlabel").select("gid", F.col("slabel").alias("fl"), F.col("elabel").alias("el"), F.col("dlabel").alias("tl"))
    return roots.distinct().groupBy("fl", "el", "tl").agg(F.count(F.lit(1)).alias("support"))


def frequent(supports: DataFrame, minsup: int) -> DataFrame:
    return supports.filter(F.col("support") >= minsup)


def shrink(adj: DataFrame, minsup: int) -> DataFrame:
    """Edges whose label triple is frequent; no frequent pattern has another."""
    f = frequent(seed_support(adj), minsup).select(F.col("fl").alias("lo"), F.col("el").alias("elabel"), F.col("tl").alias("hi"))
    known = f.limit(MOST_BROADCAST + 1).collect()
    if len(known) <= MOST_BROADCAST:
        f = F.broadcast(adj.sparkSession.createDataFrame(known, f.schema))
    return adj.withColumns({"lo": F.least("slabel", "dlabel"), "hi": F.greatest("slabel", "dlabel")}).join(f, ["lo", "elabel", "hi"], "left_semi").select(*adj.columns)


@contextmanager
def held(adj: DataFrame):
    """adj partitioned by gid and held, so that a query that reads it several times builds it once."""
    with co_partitioned(adj.sparkSession):
        base = adj.repartition("gid").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield base
        finally:
            base.unpersist()


def first_embeddings(adj: DataFrame, seeds: DataFrame) -> DataFrame:
    """pid, gid, vmap of one-edge patterns (pid, fl, el, tl); equal end labels give both directions.

    seeds, places and children are tables that the driver has made of its patterns: the callers
    pass them through ``small``.
    """
    ends = [F.col("slabel") == F.col("fl"), F.col("elabel") == F.col("el"), F.col("dlabel") == F.col("tl")]
    return adj.join(seeds, ends).select("pid", "gid", F.array("src", "dst").alias("vmap"))


SLOTS = "pid int, f int, t int, fl int, back boolean, least_el int, least_label int, root_label int, end_label int"


def slots(pid: int, code: D.Code, only: str | None = None, allowed: set[int] | None = None) -> list[tuple]:
    """Where a pattern may grow: rows of SLOTS.

    ``allowed``: the vertices from which the pattern's parent grew forward often enough. From any
    other vertex, but one that the last edge has added, the pattern can't either: its embeddings
    are fewer and its bounds no wider.

    Forward from the rightmost vertex to any label from the root's up; forward from a path vertex
    and backward to one only beyond the path edge that leaves it; never backward to the parent,
    nor along an edge that the code has. ``only`` keeps pure, path or backward growth.
    """
    path = D.rightmost_path(code)
    root, last, n = code[0][2], code[path[0]][1], D.vertex_count(code)
    last_label = code[path[0]][4]
    has = {e[:2] for e in code}
    out: list[tuple[str, tuple]] = [("pure", (pid, last, n, last_label, False, None, None, root, None))]
    for i in path:
        f, _, fl, el, tl = code[i]
        out.append(("path", (pid, f, n, fl, False, el, tl, root, None)))
    for i in path[1:]:
        f, _, fl, el, tl = code[i]
        if (last, f) not in has and (f, last) not in has:
            out.append(("backward", (pid, last, f, last_label, True, el, tl, root, fl)))
    new = code[-1][1] if D.is_forward(code[-1]) else None
    open_to = lambda kind, f: kind == "backward" or allowed is None or f in allowed or f == new
    return [row for kind, row in out if only in (None, kind) and open_to(kind, row[1])]


def possible(code: D.Code, edge: D.Edge) -> bool:
    """Whether a growth's labels let a code with it be canonical: no lower than the root's and, off the path, than the path edge's.

    Backward growths are always possible; a forward one must leave the rightmost path.
    """
    f, t, _, el, tl = edge
    if f > t:
        return True
    path = D.rightmost_path(code)
    if tl < code[0][2]:
        return False
    if f == code[path[0]][1]:
        return True
    leaving = [code[i] for i in path if code[i][0] == f]
    return bool(leaving) and (leaving[0][3], leaving[0][4]) <= (el, tl)


def extensions(embeddings: DataFrame, adj: DataFrame, places: DataFrame) -> DataFrame:
    """pid, gid, vmap, f, t, fl, el, tl, dst of every way an embedding grows at its pattern's slots.

    Embeddings and adjacency meet on (gid, vertex); label order and membership are residual.
    """
    at = embeddings.join(places, "pid").withColumn("src", F.get("vmap", F.col("f")))
    near = adj.select("gid", "src", "dst", F.col("elabel").alias("el"), F.col("dlabel").alias("tl"))
    grown = at.join(near, ["gid", "src"])
    beyond = F.col("least_el").isNull() | (F.col("least_el") < F.col("el"))
    forward = ~F.col("back") & ~F.array_contains("vmap", F.col("dst")) & (F.col("tl") >= F.col("root_label")) & (beyond | ((F.col("least_el") == F.col("el")) & (F.col("least_label") <= F.col("tl"))))
    backward = F.col("back") & (F.col("dst") == F.get("vmap", F.col("t"))) & (beyond | ((F.col("least_el") == F.col("el")) & (F.col("least_label") <= F.col("fl"))))
    return grown.filter(forward | backward).select("pid", "gid", "vmap", "f", "t", "fl", "el", "tl", "dst")


def extension_support(grown: DataFrame) -> DataFrame:
    """pid, f, t, fl, el, tl, support: distinct graphs of each growth. The distinct stays within gid's partitions."""
    keys = ["pid", "f", "t", "fl", "el", "tl"]
    return grown.select("gid", *keys).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("support"))


def grow(grown: DataFrame, children: DataFrame) -> DataFrame:
    """Embeddings of the children: forward appends the new vertex, backward keeps the mapping."""
    keys = ["pid", "f", "t", "fl", "el", "tl"]
    vmap = F.when(F.col("f") < F.col("t"), F.concat("vmap", F.array("dst"))).otherwise(F.col("vmap"))
    return grown.join(children, keys).select(F.col("child").alias("pid"), "gid", vmap.alias("vmap"))


@dataclass
class Strategy:
    """What a caller may replace: where patterns grow, which growths count, which codes are canonical, what happens to a finished level."""

    only: str | None = None
    wanted: Callable[[D.Code, D.Edge], bool] = lambda code, edge: True  # frequent growths that are followed
    many: int = 20_000  # candidates beyond which canonicality is tested on the executors
    on_level: list = field(default_factory=list)

    def places(self, pid: int, code: D.Code, allowed: set[int] | None) -> list[tuple]:
        """Rows of SLOTS at which a pattern may grow."""
        return slots(pid, code, self.only, allowed)

    def canonical(self, spark: SparkSession, codes: list[D.Code]) -> list[bool]:
        if len(codes) <= self.many:
            return [D.is_minimal(c) for c in codes]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([D.is_minimal(D.parse(t)) for t in b.column(1).to_pylist()])], names=["i", "ok"])

        df = spark.createDataFrame([(i, D.format_code(c)) for i, c in enumerate(codes)], "i long, code string")
        kept = {r["i"] for r in df.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "i long, ok boolean").filter("ok").collect()}
        return [i in kept for i in range(len(codes))]


def mine_codes(graphs: DataFrame, minsup: int, max_edges: int | None = None, strategy: Strategy | None = None) -> list[tuple[D.Code, int]]:
    """Every canonical frequent pattern with its support, in depth-first order of codes.

    graphs: an adjacency, whole graphs, or classes of them. The patterns of a level, and only they,
    come to the driver: their number depends on the labels and the support, not on the number of graphs.
    """
    check_support(minsup)
    spark, own = graphs.sparkSession, strategy or Strategy()
    found: list[tuple[D.Code, int]] = []
    with C.gathered(graphs) as classes:
        seeds = sorted(tuple(r) for r in frequent(C.count_seeds(classes), minsup).collect())
        triples = C.Triples([s[:3] for s in seeds])
        level = [(((0, 1, *s[:3]),), s[3]) for s in seeds]
        number = {s[:3]: i for i, s in enumerate(seeds)}
        seed_of = np.array([number.get(x, -1) for x in triples.all], np.int64)
        levels: list[C.Growths] = []
        grew: list[set[tuple[int, int, int]] | None] = [None] * len(level)
        while level:
            found += level
            for call in own.on_level:
                call(level)
            if max_edges is not None and len(level[0][0]) >= max_edges:
                break
            where = [s for pid, (c, _) in enumerate(level) for s in own.places(pid, c, None if grew[pid] is None else {f for f, _, _ in grew[pid]})]
            levels.append(C.Growths(triples, [c for c, _ in level], where, grew))
            counted = frequent(C.count_growths(classes, triples, seed_of, levels), minsup).collect()
            rows = sorted((*levels[-1].growth(r["key"], triples), r["support"], r["key"]) for r in counted)
            forward: dict[int, set[tuple[int, int, int]]] = {}
            for r in rows:
                if r[1] < r[2]:
                    forward.setdefault(r[0], set()).add((r[1], *r[4:6]))
            rows = [r for r in rows if own.wanted(level[r[0]][0], r[1:6])]
            codes = [(*level[r[0]][0], r[1:6]) for r in rows]
            kept = [(c, r) for c, r, ok in zip(codes, rows, own.canonical(spark, codes), strict=True) if ok]
            levels[-1].follow([r[7] for _, r in kept])
            level, grew = [(c, r[6]) for c, r in kept], [forward.get(r[0], set()) for _, r in kept]
    return sorted(found, key=lambda p: D.code_key(p[0]))


def mine(graphs: DataFrame, minsup: int, max_edges: int | None = None, strategy: Strategy | None = None) -> DataFrame:
    """PATTERNS of all frequent canonical patterns."""
    found = mine_codes(graphs, minsup, max_edges, strategy)
    return graphs.sparkSession.createDataFrame([(D.format_code(c), len(c), D.vertex_count(c), s) for c, s in found], PATTERNS)
