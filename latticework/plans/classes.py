"""Classes of equal graphs, and how often their patterns grow, in numpy.

Graphs that differ by their vertices' numbers alone are mined once, for as many graphs as there
are. Vertices are numbered anew by a colour that their surroundings give them; graphs whose numbers
still differ then are classes of their own, which costs time and changes no count.

A class is a row of CLASS. A level's growths are counted by walking its patterns' embeddings from
the seeds again, in pieces of a bounded number of rows, so that no embedding is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions import dfscode as D

#: Bytes of a number; the vertices' labels; source, target and label of both directions of every edge.
CLASS = "width int, labels binary, edges binary"
PIECE = 1 << 18  # rows, about, that an extension makes at a time
TOGETHER = 2048  # graphs whose growths are counted together
ROUNDS = 3  # of refining colours


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def binaries(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A column of binaries, of so many of the values each."""
    ends = np.append(0, np.cumsum(lengths * values.itemsize))
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def classes_of(graph: np.ndarray, src: np.ndarray, dst: np.ndarray, slabel: np.ndarray, elabel: np.ndarray, dlabel: np.ndarray) -> Iterator[pa.RecordBatch]:
    """CLASS rows of graphs, from both directions of their edges; vertices and graphs are numbers below 2**32."""
    if not len(graph):
        return
    ends = np.concatenate([graph << 32 | src, graph << 32 | dst])
    vertices, at = np.unique(ends, return_inverse=True)
    s, d = at[: len(src)], at[len(src) :]
    owner, label = vertices >> 32, np.empty(len(vertices), np.int64)
    label[s], label[d] = slabel, dlabel
    colour, kind = mixed(label.view(np.uint64)), mixed(elabel.view(np.uint64))
    for _ in range(ROUNDS):
        near = np.zeros(len(vertices), np.uint64)
        np.add.at(near, s, mixed(colour[d] + kind))
        colour = mixed(colour + near * np.uint64(3))
    order = np.lexsort((colour, owner))
    number = np.empty(len(vertices), np.int64)
    number[order] = np.arange(len(vertices))
    owner, label = owner[order], label[order]
    s, d = number[s], number[d]
    order = np.lexsort((elabel, s << 32 | d))
    s, d, elabel = s[order], d[order], elabel[order]
    new = np.append(True, owner[1:] != owner[:-1])
    starts, rank = np.flatnonzero(new), np.cumsum(new) - 1
    sizes, of = np.diff(np.append(starts, len(owner))), rank[s]
    edges = np.stack([s - starts[of], d - starts[of], elabel], axis=1)
    wide = np.zeros(len(starts), bool)
    wide[rank[(label < 0) | (label > 255)]] = True
    wide[of[(edges < 0).any(1) | (edges > 255).any(1)]] = True
    for chosen, kind in ((~wide, np.dtype("u1")), (wide, np.dtype("<i4"))):
        if chosen.any():
            n_edges = np.bincount(of, minlength=len(starts))[chosen]
            columns = [binaries(label[chosen[rank]].astype(kind), sizes[chosen]), binaries(edges[chosen[of]].astype(kind), 3 * n_edges)]
            yield pa.RecordBatch.from_arrays([pa.array([kind.itemsize] * len(n_edges), pa.int32()), *columns], names=["width", "labels", "edges"])


def classes_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CLASS rows of whole graphs (gid, vlabels, edges); edges with an end that has no label are left out."""
    for batch in batches:
        vlabels, edges = batch.column(1), batch.column(2)
        n_labels, n_edges = (x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in (vlabels, edges))
        labels, each = vlabels.flatten(), edges.flatten()
        known = labels.is_valid().to_numpy(zero_copy_only=False)
        label = labels.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        src, dst, el = (each.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        graph = np.repeat(np.arange(batch.num_rows), n_edges)
        first = (np.cumsum(n_labels) - n_labels)[graph]
        kept = known[first + src] & known[first + dst] & each.field(2).is_valid().to_numpy(zero_copy_only=False)
        graph, src, dst, el, first = (x[kept] for x in (graph, src, dst, el, first))
        two = lambda x, y: np.concatenate([x, y])
        yield from classes_of(two(graph, graph), two(src, dst), two(dst, src), label[two(first + src, first + dst)], two(el, el), label[two(first + dst, first + src)])


def classes_of_adjacency(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """CLASS rows of an adjacency sorted by gid, without nulls; some ``most`` rows, or one graph, are held at a time."""

    def finished(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        gid, src, dst, *labels = held
        graph = np.cumsum(np.append(0, gid[1:] != gid[:-1]))
        numbers = np.unique(np.concatenate([src, dst]), return_inverse=True)[1]
        return classes_of(graph, numbers[: len(src)], numbers[len(src) :], *(x.astype(np.int64) for x in labels))

    held: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n < most or held[0][0][0] == held[-1][0][-1]:
            continue
        columns = [np.concatenate(c) for c in zip(*held)]
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        yield from finished([c[:last] for c in columns])
        held = [[c[last:] for c in columns]]
        n -= last
    if n:
        yield from finished([np.concatenate(c) for c in zip(*held)])


@contextmanager
def gathered(graphs: DataFrame) -> Iterator[DataFrame]:
    """width, labels, edges, n: each class once, with its number of graphs, held.

    graphs: an adjacency, whole graphs, CLASS rows, or what this has given already.
    """
    if "n" in graphs.columns:
        yield graphs
        return
    if "vlabels" in graphs.columns:
        graphs = graphs.select("gid", "vlabels", "edges").mapInArrow(classes_of_rows, CLASS)
    elif "labels" not in graphs.columns:
        columns = ["gid", "src", "dst", "slabel", "elabel", "dlabel"]
        graphs = graphs.select(*columns).dropna().repartition("gid").sortWithinPartitions("gid").mapInArrow(classes_of_adjacency, CLASS)
    spark = graphs.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = graphs.groupBy("width", "labels", "edges").agg(F.count(F.lit(1)).alias("n")).repartition(parts)
    held = counted.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def n_graphs(classes: DataFrame) -> int:
    """Number of graphs that have an edge."""
    return classes.agg(F.sum("n")).first()[0] or 0


class Collection:
    """Classes with their edges, vertices numbered through: of each edge its ends and its label triple."""

    def __init__(self, batch: pa.RecordBatch):
        self.weight = batch.column(3).to_numpy(zero_copy_only=False)
        labels, edges, sizes, counts, at = [], [], [], [], 0
        for width, own, each in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            kind = np.uint8 if width == 1 else np.dtype("<i4")
            own, each = np.frombuffer(own, kind), np.frombuffer(each, kind)
            labels.append(own)
            edges.append(each)
            sizes.append(len(own))
            counts.append(len(each) // 3)
        label = np.concatenate(labels).astype(np.int64)
        edge = np.concatenate(edges).astype(np.int64).reshape(-1, 3)
        sizes, counts = np.array(sizes), np.array(counts)
        first = np.repeat(np.cumsum(sizes) - sizes, counts)
        self.n_vertices = len(label)
        self.graph = np.repeat(np.arange(len(sizes)), sizes)
        self.src, self.dst, self.el = first + edge[:, 0], first + edge[:, 1], edge[:, 2]
        self.fl, self.tl = label[self.src], label[self.dst]

    def shrink(self, triples: Triples) -> None:
        """Leaves the edges whose triple is among them, and lists each vertex's."""
        triple = triples.numbers(self.fl, self.el, self.tl)
        kept = triple >= 0
        self.triple, self.src, dst = triple[kept], self.src[kept], self.dst[kept]
        self.dst = dst.astype(np.int32)
        self.degree = np.bincount(self.src, minlength=self.n_vertices)
        self.start = np.cumsum(self.degree) - self.degree


class Triples:
    """Frequent label triples in both directions, sorted, by number."""

    def __init__(self, seeds: list[tuple[int, int, int]]):
        self.all = sorted({x for fl, el, tl in seeds for x in ((fl, el, tl), (tl, el, fl))})
        columns = np.array(self.all, np.int64).reshape(-1, 3)
        self.labels, self.elabels = np.unique(columns[:, [0, 2]]), np.unique(columns[:, 1])
        self.codes = self.code(*columns.T)
        self.fl, self.el, self.tl = columns.T
        self.first = {int(x): int(np.searchsorted(self.fl, x)) for x in np.unique(self.fl)}
        self.last = {int(x): int(np.searchsorted(self.fl, x, "right")) for x in np.unique(self.fl)}

    def code(self, fl: np.ndarray, el: np.ndarray, tl: np.ndarray) -> np.ndarray:
        a, b, c = np.searchsorted(self.labels, fl), np.searchsorted(self.elabels, el), np.searchsorted(self.labels, tl)
        return (a * (len(self.elabels) + 1) + b) * (len(self.labels) + 1) + c

    def numbers(self, fl: np.ndarray, el: np.ndarray, tl: np.ndarray) -> np.ndarray:
        """Numbers of triples, -1 for those that aren't here."""
        at = np.minimum(np.searchsorted(self.codes, self.code(fl, el, tl)), len(self.codes) - 1)
        same = (self.fl[at] == fl) & (self.el[at] == el) & (self.tl[at] == tl)
        return np.where(same, at, -1)


class Growths:
    """Where a level's patterns may grow: a key for every slot and triple that leaves its vertex.

    ``child`` is the number of the pattern that a growth makes, -1 where none is followed.
    """

    def __init__(self, triples: Triples, codes: list[D.Code], rows: list[tuple], grew: list[set[tuple[int, int, int]] | None]):
        """rows: SLOTS of the codes, by their numbers.

        grew: the forward growths (f, el, tl) of each code's parent that were frequent. But at the
        vertex that the last edge has added, the code has no other: its embeddings are fewer and its bounds no wider.
        """
        n_patterns = len(codes)
        new = [c[-1][1] if D.is_forward(c[-1]) else None for c in codes]
        rows = sorted(rows, key=lambda r: r[0])
        pid = np.array([r[0] for r in rows], np.int64)
        self.pid = pid
        self.first = np.searchsorted(pid, np.arange(n_patterns))
        self.count = np.bincount(pid, minlength=n_patterns)
        self.f, self.t = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
        self.back = np.array([r[4] for r in rows], bool)
        sizes = np.array([triples.last.get(r[3], 0) - triples.first.get(r[3], 0) for r in rows], np.int64)
        self.base = np.cumsum(sizes) - sizes
        self.offset = self.base - np.array([triples.first.get(r[3], 0) for r in rows], np.int64)
        self.child = np.full(int(sizes.sum()), -1, np.int32)
        for (p, f, _, fl, back, least_el, least_label, root, end), base, size in zip(rows, self.base, sizes):
            if not size:
                continue
            own = slice(triples.first[fl], triples.last[fl])
            el, tl = triples.el[own], triples.tl[own]
            open_to = (tl == end) if back else (tl >= root)
            if least_el is not None:
                open_to = open_to & ((el > least_el) | ((el == least_el) & ((fl if back else tl) >= least_label)))
            if grew[p] is not None and not back and f != new[p]:
                open_to = open_to & np.array([(f, int(a), int(b)) in grew[p] for a, b in zip(el, tl)])
            self.child[base : base + size][open_to] = 0

    def follow(self, keys: list[int]) -> None:
        """Numbers the growths that are followed, and closes all others."""
        self.child[:] = -1
        self.child[keys] = np.arange(len(keys))

    def growth(self, key: int, triples: Triples) -> tuple[int, int, int, int, int, int]:
        """Pattern and edge (f, t, fl, el, tl) of a key."""
        slot = int(np.searchsorted(self.base, key, "right")) - 1
        return (int(self.pid[slot]), int(self.f[slot]), int(self.t[slot]), *triples.all[key - int(self.offset[slot])])

    def extend(self, own: Collection, pid: np.ndarray, vmap: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Embeddings' number, slot, key and the new edge's end of all growths, piece by piece. vmap: a row for each vertex of the pattern."""
        count = self.count[pid]
        row = np.repeat(np.arange(len(pid), dtype=np.int32), count)
        slot = np.arange(len(row)) + np.repeat(self.first[pid] - (np.cumsum(count) - count), count)
        src = vmap[self.f[slot], row]
        degree = own.degree[src]
        total = np.cumsum(degree)
        cuts = np.searchsorted(total, np.arange(PIECE, total[-1] if len(total) else 0, PIECE)).tolist()
        bounds = sorted({0, *cuts, len(row)})
        for low, high in zip(bounds, bounds[1:]):
            n = degree[low:high]
            at = np.repeat(np.arange(low, high, dtype=np.int32), n)
            edge = np.arange(len(at)) + np.repeat(own.start[src[low:high]] - (np.cumsum(n) - n), n)
            key = self.offset[slot[low:high]].repeat(n) + own.triple[edge]
            ok = np.flatnonzero(self.child[key] >= 0)
            at, key, dst = at[ok], key[ok], own.dst[edge[ok]]
            i, s = row[at], slot[at]
            back = self.back[s]
            fits = np.ones(len(i), bool)
            for v in vmap:
                fits &= v[i] != dst
            if back.any():
                fits = np.where(back, vmap[np.where(back, self.t[s], 0), i] == dst, fits)
            ok = np.flatnonzero(fits)
            yield i[ok], s[ok], key[ok], dst[ok]


def count_growths(classes: DataFrame, triples: Triples, seed_of: np.ndarray, levels: list[Growths]) -> DataFrame:
    """key, support of the last level's growths, by graph; seed_of: number of each triple's one-edge pattern, or -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        support = np.zeros(len(levels[-1].child), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                own = Collection(batch.slice(start, TOGETHER))
                own.shrink(triples)
                n, found = len(own.weight), [np.zeros(0, np.int64)]
                for key in walk(own, seed_of, levels):
                    found.append(key)
                pairs = distinct(np.concatenate(found))
                support += np.bincount(pairs // n, own.weight[pairs % n], len(support)).astype(np.int64)
        seen = np.flatnonzero(support)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(support[seen])], names=["key", "n"])

    return classes.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("support"))


def walk(own: Collection, seed_of: np.ndarray, levels: list[Growths]) -> Iterator[np.ndarray]:
    """Key times number of graphs plus graph of the last level's growths, without repeats in a piece."""
    n = len(own.weight)
    seed = seed_of[own.triple]
    at = np.flatnonzero(seed >= 0)
    todo = [iter([(seed[at], np.stack([own.src[at].astype(np.int32), own.dst[at]]))])]

    def grown(level: Growths, pid: np.ndarray, vmap: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, s, key, dst in level.extend(own, pid, vmap):
            after = np.full((len(vmap) + 1, len(i)), -1, np.int32)
            np.take(vmap, i, axis=1, out=after[:-1], mode="clip")
            forward = np.flatnonzero(~level.back[s])
            after[level.t[s[forward]], forward] = dst[forward]
            yield level.child[key], after

    while todo:
        embeddings = next(todo[-1], None)
        if embeddings is None:
            todo.pop()
        elif len(todo) < len(levels):
            todo.append(grown(levels[len(todo) - 1], *embeddings))
        else:
            pid, vmap = embeddings
            for i, _, key, _ in levels[-1].extend(own, pid, vmap):
                yield distinct(key * n + own.graph[vmap[0, i]])


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def count_seeds(classes: DataFrame) -> DataFrame:
    """fl, el, tl, support of one-edge patterns, from a smaller or equal label, by graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Collection(batch)
            at = np.flatnonzero(own.fl <= own.tl)
            columns = [own.graph[own.src[at]], own.fl[at], own.el[at], own.tl[at]]
            order = np.lexsort(columns)
            graph, *labels = (c[order] for c in columns)
            changed = lambda cs: np.append(True, np.any([c[1:] != c[:-1] for c in cs], axis=0))[: len(order)]
            new = np.flatnonzero(changed([graph, *labels]))
            graph, labels = graph[new], [x[new] for x in labels]
            order = np.flatnonzero(changed(labels)[: len(new)])
            n = np.add.reduceat(own.weight[graph], order) if len(order) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[order], pa.int32()) for x in labels), pa.array(n, pa.int64())], names=["fl", "el", "tl", "n"])

    return classes.mapInArrow(run, "fl int, el int, tl int, n long").groupBy("fl", "el", "tl").agg(F.sum("n").alias("support"))
