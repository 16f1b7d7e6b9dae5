"""Readers and writers of graph collections.

Text: a line ``t …`` starts a graph, ``v id label`` is a vertex, ``e from to label`` an edge; other
lines don't count. The string form has ``u`` for edges and strings for labels. Binary: the number
of graphs, their offsets, and for each its length and content, all 64-bit; a graph is its vertex
labels and edges as 32-bit integers. Column binary: four sizes and four integer arrays, vertices
padded with -1. A table of graphs has gid, vlabels and edges; gid is the rank of a graph among
those with vertices.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.operators.embeddings import dense_ids
from latticework.operators.graphs import EDGE, ROWS, to_rows

FORMATS = ("txt", "fsg", "bin", "cudabin")
#: Bytes of content up to which a collection is written as one binary file.
MOST_BYTES = 1 << 40
#: Bytes of graphs that a task packs, and the driver holds, at a time.
PIECE_BYTES = 1 << 23
#: Strings of a label dictionary up to which it is sent to every task.
MOST_LABELS = 100_000
#: Graphs of a binary file that are read together.
SLICE = 1 << 15


def file_format(token: str) -> str:
    """A format's name, with or without a leading dash; ValueError for any other."""
    name = token.removeprefix("-")
    if name not in FORMATS:
        raise ValueError(f"unknown format {token!r}")
    return name


def read_graphs(spark: SparkSession, fmt: str, path: str, **options) -> DataFrame:
    """A table of graphs from files of any format."""
    readers = {"txt": read_txt, "fsg": read_fsg, "bin": read_bin, "cudabin": read_columns}
    return readers[file_format(fmt)](spark, path, **options)


def records_of(spark: SparkSession, path: str) -> DataFrame:
    """value, file, at: records of text files, cut before graph lines, and their places."""
    text = spark.read.option("lineSep", "\nt").text(path)
    return text.withColumn("file", F.col("_metadata.file_path")).withColumn("at", F.monotonically_increasing_id())


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """graph (file and first line's place), kind, a, b, c of the records of text files, in record order ``at``.

    A file is cut at its graph lines, so a record is a graph and graphs are parsed side by side.
    """
    lines = records_of(spark, path).select("file", "at", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    return lines.select("file", "at", "line", words.alias("w")).filter(F.get("w", F.lit(0)).isin("v", "e", "u"))


def ranked(rows: DataFrame) -> DataFrame:
    """rows with gid: the rank of (file, at) among the graphs, by files' names and places."""
    files = sorted(r["file"] for r in rows.select("file").distinct().collect())  # as many as the reader has listed
    numbers = F.broadcast(rows.sparkSession.createDataFrame(list(zip(files, range(len(files)))), "file string, number long"))
    place = (F.col("number") * F.lit(2.0**63) + F.col("at")).alias("place")
    starts = rows.join(numbers, "file").select(F.struct("number", "at", "file").alias("start"), place)
    gids = dense_ids(starts, "start", "gid", by="place").select("start.file", "start.at", "gid")
    return rows.join(gids, ["file", "at"])


def checked(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """A table of graphs; the query fails on an edge whose ends aren't vertices, or on gaps in vertex numbers."""
    rows = to_rows(vertices, edges)
    n = F.size("vlabels")
    bad = F.exists("edges", lambda e: (e["src"] < 0) | (e["dst"] < 0) | (e["src"] >= n) | (e["dst"] >= n))
    fault = F.raise_error(F.concat(F.lit("define vertices before edges: graph "), F.col("gid").cast("string"))).cast("array<int>")
    return rows.select("gid", F.when(~bad, F.col("vlabels")).otherwise(fault).alias("vlabels"), "edges")


def read_txt(spark: SparkSession, path: str) -> DataFrame:
    """Graphs of text files with integer labels."""
    rows = lines_of(spark, path)
    word = lambda i: F.get("w", F.lit(i)).cast("int")
    own = ranked(rows.filter(F.get("w", F.lit(0)) == "v"))
    vertices = own.groupBy("gid", word(1).alias("vid")).agg(F.max_by(word(2), "line").alias("vlabel"))
    gids = own.select("file", "at", "gid").distinct()
    edges = rows.filter(F.get("w", F.lit(0)) == "e").join(gids, ["file", "at"]).select("gid", word(1).alias("src"), word(2).alias("dst"), word(3).alias("elabel"))
    return checked(vertices, edges)


def read_fsg(spark: SparkSession, path: str, per_graph_labels: bool = False) -> DataFrame:
    """Graphs of text files with string labels, encoded from 0 by first appearance.

    One dictionary serves all graphs; with ``per_graph_labels`` each graph has its own, so equal
    strings of different graphs may get different numbers. Records are parsed whole, once for
    numbers of graphs and labels and once for the graphs, without a shuffle; a dictionary of more
    than ``MOST_LABELS`` strings, or one for each graph, is joined.
    """
    found = None if per_graph_labels else read_records(spark, path)
    if found is not None:
        return found
    rows = lines_of(spark, path)
    word = lambda i: F.get("w", F.lit(i))
    own = ranked(rows.filter(word(0) == "v")).select("file", "at", "gid", "line", word(1).cast("int").alias("vid"), word(2).alias("label"))
    gids = own.select("file", "at", "gid").distinct()
    links = rows.filter(word(0) == "u").join(gids, ["file", "at"]).select("gid", "line", word(1).cast("int").alias("src"), word(2).cast("int").alias("dst"), word(3).alias("label"))
    scope = ["gid"] if per_graph_labels else []

    def encoded(table: DataFrame, name: str) -> DataFrame:
        first = table.groupBy(*scope, "label").agg(F.min(F.struct("gid", "line")).alias("first"))
        if scope:
            codes = first.withColumn(name, F.row_number().over(W.partitionBy(*scope).orderBy("first")) - 1)
        else:
            places = dense_ids(first.select("first", F.col("first.gid").alias("at")), "first", name, by="at")
            codes = first.join(places, "first")
        return table.join(codes.select(*scope, "label", F.col(name).cast("int").alias(name)), [*scope, "label"])

    vertices = encoded(own, "vlabel").select("gid", "vid", "vlabel")
    return checked(vertices, encoded(links, "elabel").select("gid", "src", "dst", "elabel"))


def words_of(values: pa.Array) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray, pa.Array]]]:
    """Which records have vertices; for the lines v and u of those, their record, line and words."""
    lines = pc.split_pattern(values, "\n")
    record = pc.list_parent_indices(lines).to_numpy()
    line = within(np.asarray(pc.list_value_length(lines), np.int64))
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(lines.flatten()))
    first = pc.list_element(words, 0)
    is_v, is_u = (np.asarray(pc.equal(first, x)) for x in "vu")
    has = np.zeros(len(values), bool)
    has[record[is_v]] = True
    out = {}
    for kind, own, least in (("v", is_v, 3), ("u", is_u & has[record], 4)):
        w = words.filter(pa.array(own))
        if len(w) and pc.min(pc.list_value_length(w)).as_py() < least:
            raise ValueError(f"a line {kind} has fewer than {least} words")
        out[kind] = (record[own], line[own], w)
    return has, out


def read_records(spark: SparkSession, path: str) -> DataFrame | None:
    """``read_fsg`` with one dictionary, or None if that has more than MOST_LABELS strings."""
    rows = records_of(spark, path)
    files = sorted(r["file"] for r in rows.select("file").distinct().collect())  # as many as the reader has listed
    if not files:
        return spark.createDataFrame([], ROWS)
    numbers = F.broadcast(spark.createDataFrame(list(zip(files, range(len(files)))), "file string, number long"))
    records = rows.join(numbers, "file").select("number", "at", "value")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, at = (batch.column(i).to_numpy() for i in (0, 1))
            has, words = words_of(batch.column(2))
            out = []
            for n, part in sorted(set(zip(number[has].tolist(), (at[has] >> 33).tolist()))):
                out.append(("", None, n, part, int((has & (number == n) & (at >> 33 == part)).sum())))
            for kind, last in (("v", 2), ("u", 3)):
                record, line, w = words[kind]
                if len(w):
                    order = np.lexsort((line, at[record], number[record]))
                    labels = pc.list_element(w, last).dictionary_encode()
                    codes, first = np.unique(labels.indices.to_numpy()[order], return_index=True)
                    for c, i in zip(codes.tolist(), order[first].tolist()):
                        out.append((kind, labels.dictionary[c].as_py(), int(number[record[i]]), int(at[record[i]]), int(line[i])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["kind", "label", "number", "at", "n"])

    with kept_on_disk(records.mapInArrow(seen, "kind string, label string, number long, at long, n long")) as found:
        parts = sorted(tuple(r) for r in found.filter("kind = ''").groupBy("number", "at").agg(F.sum("n")).collect())  # one for each piece of a file
        firsts = found.filter("kind != ''").groupBy("kind", "label").agg(F.min(F.struct("number", "at", "n")).alias("first")).limit(MOST_LABELS + 1).collect()
    if len(firsts) > MOST_LABELS:
        return None
    labels = {kind: [r["label"] for r in sorted((r for r in firsts if r["kind"] == kind), key=lambda r: tuple(r["first"]))] for kind in "vu"}
    starts, total = {}, 0
    for n, part, k in parts:
        starts[n, part] = total
        total += k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following = dict(starts)
        known = {kind: pa.array(x, pa.string()) for kind, x in labels.items()}
        for batch in batches:
            number, at = (batch.column(i).to_numpy() for i in (0, 1))
            has, words = words_of(batch.column(2))
            if not has.any():
                continue
            gid = np.zeros(len(has), np.int64)
            for n, part in sorted(set(zip(number[has].tolist(), (at[has] >> 33).tolist()))):
                own = has & (number == n) & (at >> 33 == part)
                k = int(own.sum())
                gid[own] = following[n, part] + np.arange(k)
                following[n, part] += k
            place, gids, n = np.cumsum(has) - 1, gid[has], int(has.sum())
            word = lambda w, i: pc.list_element(w, i).cast(pa.int32()).to_numpy()
            code = lambda w, i, kind: pc.index_in(pc.list_element(w, i), value_set=known[kind]).to_numpy()
            record, _, w = words["v"]
            g, vid, vlabel = place[record], word(w, 1), code(w, 2, "v")
            order = np.lexsort((vid, g))
            g, vid, vlabel = g[order], vid[order], vlabel[order]
            nv = np.bincount(g, minlength=n)
            if len(gap := np.flatnonzero(vid != within(nv))):
                raise ValueError(f"vertex numbers aren't dense from 0: graph {gids[g[gap[0]]]}")
            record, _, w = words["u"]
            g, src, dst, elabel = (place[record], word(w, 1), word(w, 2), code(w, 3, "u")) if len(w) else (np.zeros(0, np.int64) for _ in range(4))
            order = np.lexsort((elabel, dst, src, g))
            g, src, dst, elabel = (x[order] for x in (g, src, dst, elabel))
            if len(bad := np.flatnonzero((src < 0) | (dst < 0) | (src >= nv[g]) | (dst >= nv[g]))):
                raise ValueError(f"define vertices before edges: graph {gids[g[bad[0]]]}")
            rows = graph_rows(0, n, nv, vlabel, np.bincount(g, minlength=n), [src, dst, elabel])
            yield pa.RecordBatch.from_arrays([pa.array(gids), *rows.columns[1:]], names=rows.schema.names)

    return records.mapInArrow(run, ROWS)


@contextmanager
def kept_on_disk(df: DataFrame) -> Iterator[DataFrame]:
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        yield held
    finally:
        held.unpersist()


def write_txt(graphs: DataFrame, path: str) -> None:
    """One record for each graph: its vertices by number, then its edges in order of their text."""
    v = F.transform("vlabels", lambda label, i: F.concat_ws(" ", F.lit("v"), i.cast("string"), label.cast("string")))
    e = F.array_sort(F.transform("edges", lambda x: F.concat_ws(" ", F.lit("e"), x["src"].cast("string"), x["dst"].cast("string"), x["elabel"].cast("string"))))
    head = F.array(F.concat(F.lit("t # "), F.col("gid").cast("string")))
    graphs.select(F.concat_ws("\n", F.concat(head, v, e)).alias("value"), "gid").orderBy("gid").select("value").write.text(path)


def graph_bytes(vlabels: list[int], edges: list) -> bytes:
    """A graph's content: number of vertices, their labels, then src, dst and label of its edges."""
    flat = [x for e in edges for x in ((e["src"], e["dst"], e["elabel"]) if isinstance(e, dict) else e)]
    return np.array([len(vlabels), *vlabels, *flat], "<i4").tobytes()


def graph_of_bytes(raw: bytes) -> tuple[list[int], list[tuple[int, int, int]]]:
    """ValueError if the content is cut short."""
    if len(raw) < 4 or len(raw) % 4:
        raise ValueError("buffer too small")
    a = np.frombuffer(raw, "<i4")
    n = int(a[0])
    if len(a) < 1 + n or (len(a) - 1 - n) % 3:
        raise ValueError("buffer too small")
    return a[1 : 1 + n].tolist(), [tuple(x) for x in a[1 + n :].reshape(-1, 3).tolist()]


def pack_bin(graphs: list[tuple[list[int], list]]) -> bytes:
    """The binary form of some graphs; ValueError if there are none."""
    if not graphs:
        raise ValueError("an empty collection can't be written")
    parts = [graph_bytes(*g) for g in graphs]
    offsets = np.cumsum([0, *[len(p) + 8 for p in parts[:-1]]]) + 8 * (1 + len(parts))
    head = np.array([len(parts), *offsets], "<i8").tobytes()
    return head + b"".join(np.array([len(p)], "<i8").tobytes() + p for p in parts)


def unpack_bin(raw: bytes, parts: int = 1, part: int = 0) -> Iterator[tuple[int, list[int], list[tuple[int, int, int]]]]:
    """Number, vertex labels and edges of each graph, or of those of one contiguous part, the last one with the remainder.

    Only the part's graphs are decoded: offsets say where they lie. ValueError if its offsets or
    the end don't fit.
    """
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    if len(raw) < 8 * (n + 1):
        raise ValueError("buffer too small")
    size = n // parts
    first, last = part * size, n if part == parts - 1 else (part + 1) * size
    offsets = np.frombuffer(raw[8 : 8 * (n + 1)], "<i8")
    end = 8 * (n + 1) if not first else int(offsets[first]) if first < n else len(raw)
    for i in range(first, last):
        at = int(offsets[i])
        if at != end or at + 8 > len(raw):
            raise ValueError(f"graph {i}: offset {at}, expected {end}")
        end = at + 8 + int(np.frombuffer(raw[at : at + 8], "<i8")[0])
        if end > len(raw):
            raise ValueError("buffer too small")
        yield (i, *graph_of_bytes(raw[at + 8 : end]))
    if last == n and end != len(raw):
        raise ValueError("content after the last graph")


def arrow_rows(rows: list[tuple]) -> pa.RecordBatch:
    edges = [[dict(zip(("src", "dst", "elabel"), e)) for e in r[2]] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array(edges, pa.list_(EDGE))], names=["gid", "vlabels", "edges"])


def local_file(spark: SparkSession, path: str) -> str | None:
    """Name in the file system of a path that is one local file, else None."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri()
    return whole.getPath() if whole.getScheme() == "file" and os.path.isfile(whole.getPath()) else None


def sliced(spark: SparkSession, first: int, last: int, read: Callable[[int, int], pa.RecordBatch]) -> DataFrame:
    """A table of graphs, of which ``read`` gives those from one number up to another."""
    slices = max(1, -(-(last - first) // SLICE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                if first + i * SLICE < last:
                    yield read(first + i * SLICE, min(last, first + (i + 1) * SLICE))

    return spark.range(0, slices, 1, min(slices, 1000)).mapInArrow(run, ROWS)


def graph_rows(first: int, n: int, nv: np.ndarray, labels: np.ndarray, ne: np.ndarray, edges: list[np.ndarray]) -> pa.RecordBatch:
    """ROWS of n graphs numbered from ``first``."""
    ends = [pa.array(np.append(0, np.cumsum(x)).astype(np.int32)) for x in (nv, ne)]
    links = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c, np.int32)) for c in edges], fields=list(EDGE))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.ListArray.from_arrays(ends[0], pa.array(np.ascontiguousarray(labels, np.int32))), pa.ListArray.from_arrays(ends[1], links)], names=["gid", "vlabels", "edges"])


def read_at(name: str, start: int, size: int, kind: str) -> np.ndarray:
    with open(name, "rb") as f:
        f.seek(start)
        raw = f.read(size)
    if len(raw) != size:
        raise ValueError("buffer too small")
    return np.frombuffer(raw, kind)


def bin_slice(name: str, n: int, first: int, last: int) -> pa.RecordBatch:
    """Graphs from number ``first`` up to ``last`` of a binary file of n; ValueError if offsets, lengths or the end don't fit."""
    whole = os.path.getsize(name)
    offsets = read_at(name, 8 * (1 + first), 8 * (min(last + 1, n) - first), "<i8")
    if last == n:
        offsets = np.append(offsets, whole)
    sizes = np.diff(offsets)
    if (not first and offsets[0] != 8 * (n + 1)) or offsets[-1] > whole or (sizes < 12).any() or (sizes % 4).any():
        raise ValueError(f"graphs {first} to {last}: offsets don't fit")
    a = read_at(name, int(offsets[0]), int(offsets[-1] - offsets[0]), "<i4")
    starts, words = (offsets[:-1] - offsets[0]) // 4, sizes // 4
    length = np.stack([a[starts], a[starts + 1]], axis=1).copy().view("<i8").ravel()
    nv = a[starts + 2].astype(np.int64)
    rest = words - 3 - nv
    if (length != sizes - 8).any() or (nv < 0).any() or (rest < 0).any() or (rest % 3).any():
        raise ValueError("buffer too small, or content after a graph")
    labels = a[np.repeat(starts + 3, nv) + within(nv)]
    at = np.repeat(starts + 3 + nv, rest // 3) + 3 * within(rest // 3)
    return graph_rows(first, last - first, nv, labels, rest // 3, [a[at + i] for i in range(3)])


def columns_slice(name: str, n: int, m: int, widest: int, first: int, last: int) -> pa.RecordBatch:
    """Graphs from number ``first`` up to ``last`` of a column file of n graphs, m ends and so many places a graph."""
    at = 4 * (4 + 2 * m)
    labels = read_at(name, at + 4 * first * widest, 4 * (last - first) * widest, "<i4")
    begin, stop, end = first * widest, last * widest, n * widest
    offsets = read_at(name, at + 4 * (end + begin), 4 * (stop - begin), "<i4")
    after = -1
    while after < 0:  # the next offset that is set; the last one always is
        some = read_at(name, at + 4 * (end + stop), 4 * min(1 << 16, end + 1 - stop), "<i4")
        known = some[some >= 0]
        after, stop = (int(known[0]) if len(known) else -1), stop + len(some)
    used = np.flatnonzero(offsets >= 0)
    starts = np.append(offsets[used], after)
    counts = np.diff(starts)
    low = int(starts[0])
    ends, kinds = (read_at(name, 4 * (4 + low + skip), 4 * (after - low), "<i4") for skip in (0, m))
    own = np.repeat(used, counts)
    graph, src = own // max(widest, 1), own % max(widest, 1)
    dst = ends - (first + graph) * widest
    forward = src < dst
    nv, ne = np.bincount(used // max(widest, 1), minlength=last - first), np.bincount(graph[forward], minlength=last - first)
    return graph_rows(first, last - first, nv, labels[used], ne, [c[forward] for c in (src, dst, kinds)])


def read_bin(spark: SparkSession, path: str, total_parts: int = 1, part: int | None = None) -> DataFrame:
    """Graphs of a binary file, or of one of its contiguous parts, of which alone the graphs are decoded.

    A single file in a local or mounted folder, which executors must share, is read in slices side
    by side; from other stores a file is read whole by one task.
    """

    local = local_file(spark, path)
    if local:
        with open(local, "rb") as f:
            n = int(np.frombuffer(f.read(8), "<i8")[0])
        size = n // total_parts
        first, last = (0, n) if part is None else (part * size, n if part == total_parts - 1 else (part + 1) * size)
        return sliced(spark, first, last, lambda a, b: bin_slice(local, n, a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                found = unpack_bin(raw, total_parts, part or 0) if part is not None else unpack_bin(raw)
                while rows := list(islice(found, 1000)):
                    yield arrow_rows(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ROWS)


def part_of(index: Column, n: int, parts: int) -> Column:
    """Which of so many contiguous parts a graph's number lies in; the last one takes the remainder."""
    return F.least(F.floor(index / max(1, n // parts)), F.lit(parts - 1)).cast("long")


def pack_columns(graphs: list[tuple[list[int], list]]) -> bytes:
    """The column form: sizes, both directions of all edges, their labels, vertex labels and offsets, padded."""
    widest = max((len(v) for v, _ in graphs), default=0)
    ends: list[int] = []
    labels: list[int] = []
    vertex_labels = np.full(len(graphs) * widest, -1, np.int64)
    offsets = np.full(len(graphs) * widest + 1, -1, np.int64)
    for g, (v, e) in enumerate(graphs):
        near: list[list[tuple[int, int]]] = [[] for _ in v]
        for x in e:
            s, d, label = (x["src"], x["dst"], x["elabel"]) if isinstance(x, dict) else x
            near[s].append((d, label))
            near[d].append((s, label))
        for i, label in enumerate(v):
            vertex_labels[g * widest + i] = label
            offsets[g * widest + i] = len(ends)
            for d, x in sorted(near[i]):
                ends.append(g * widest + d)
                labels.append(x)
    offsets[-1] = len(ends)
    head = [len(graphs), len(ends), widest, sum(len(v) for v, _ in graphs)]
    return np.concatenate([np.array(x, "<i4") for x in (head, ends, labels, vertex_labels, offsets)]).astype("<i4").tobytes()


def unpack_columns(raw: bytes) -> Iterator[tuple[int, list[int], list[tuple[int, int, int]]]]:
    a = np.frombuffer(raw, "<i4")
    n, m, widest, _ = a[:4].tolist()
    if len(a) != 4 + 2 * m + 2 * n * widest + 1:
        raise ValueError("buffer too small")
    ends, labels = a[4 : 4 + m], a[4 + m : 4 + 2 * m]
    vertex_labels, offsets = a[4 + 2 * m : 4 + 2 * m + n * widest], a[4 + 2 * m + n * widest :]
    # The next offset that is set, at or after each place.
    following = np.minimum.accumulate(np.where(offsets >= 0, offsets, np.iinfo(np.int32).max)[::-1])[::-1]
    for g in range(n):
        own = slice(g * widest, (g + 1) * widest)
        size = int((offsets[own] >= 0).sum())
        starts = offsets[own][:size].tolist()
        starts.append(int(following[(g + 1) * widest]))
        edges = [(i, int(ends[k]) - g * widest, int(labels[k])) for i in range(size) for k in range(starts[i], starts[i + 1])]
        yield g, vertex_labels[own][:size].tolist(), sorted(e for e in edges if e[0] < e[1])


def read_columns(spark: SparkSession, path: str) -> DataFrame:
    """Graphs of a column binary file; read in slices or whole like ``read_bin``."""
    local = local_file(spark, path)
    if local:
        with open(local, "rb") as f:
            n, m, widest, _ = np.frombuffer(f.read(16), "<i4").tolist()
        if os.path.getsize(local) != 4 * (4 + 2 * m + 2 * n * widest + 1):
            raise ValueError("buffer too small")
        return sliced(spark, 0, n, lambda a, b: columns_slice(local, n, m, widest, a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                yield arrow_rows(list(unpack_columns(raw)))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ROWS)


def write_graphs(graphs: DataFrame, fmt: str, path: str) -> None:
    """Writes a table of graphs: text by the executors; the single-file binary forms through the driver.

    Executors sort and pack those, some MB of graphs at a time, and the driver passes one piece
    after the other on to the file. ValueError above MOST_BYTES, or for an empty collection as bin.
    """
    name = file_format(fmt)
    if name == "txt":
        write_txt(graphs, path)
        return
    if name == "fsg":
        raise ValueError("the string form can't be written")
    held = graphs.persist(StorageLevel.DISK_ONLY)
    try:
        bytes_of = F.sum(F.lit(20).cast("long") + 4 * F.size("vlabels") + 12 * F.size("edges"))
        total, n, widest, vertices, ends = held.agg(bytes_of, F.count(F.lit(1)), F.max(F.size("vlabels")), F.sum(F.size("vlabels")), 2 * F.sum(F.size("edges"))).first()
        if (total or 0) > MOST_BYTES:
            raise ValueError(f"more than {MOST_BYTES} bytes; write text or Parquet")
        if name == "bin" and not n:
            raise ValueError("an empty collection can't be written")
        if name == "cudabin" and max(n * (widest or 0), ends or 0) >= 1 << 31:
            raise ValueError("places don't fit 32-bit integers; write bin, text or Parquet")
        pieces = held.repartitionByRange(-(-(total or 1) // PIECE_BYTES), "gid").sortWithinPartitions("gid")
        if name == "bin":
            packed = pieces.mapInArrow(packed_bin, "first long, n long, sizes binary, content binary").persist(StorageLevel.DISK_ONLY)
        else:
            packed = pieces.mapInArrow(lambda batches: packed_columns(batches, widest), "first long, n long, ends binary, labels binary, vlabels binary, offsets binary").persist(StorageLevel.DISK_ONLY)
        try:
            with created(graphs.sparkSession, path) as write:
                if name == "bin":
                    at = 8 * (1 + n)
                    write(np.array([n], "<i8").tobytes())
                    for _, raw in in_order(packed, "sizes"):
                        sizes = np.frombuffer(raw, "<i8")
                        write((at + np.cumsum(sizes) - sizes).astype("<i8").tobytes())
                        at += int(sizes.sum())
                    for _, raw in in_order(packed, "content"):
                        write(raw)
                else:
                    write(np.array([n, ends or 0, widest or 0, vertices or 0], "<i4").tobytes())
                    at = 0
                    for k, raw in in_order(packed, "ends"):
                        write((np.frombuffer(raw, "<i4") + at * (widest or 0)).astype("<i4").tobytes())
                        at += k
                    for _, raw in in_order(packed, "labels"):
                        write(raw)
                    for _, raw in in_order(packed, "vlabels"):
                        write(raw)
                    at = 0
                    for _, raw in in_order(packed, "offsets"):
                        own = np.frombuffer(raw, "<i4")  # the last one is the piece's number of ends
                        write(np.where(own[:-1] >= 0, own[:-1] + at, -1).astype("<i4").tobytes())
                        at += int(own[-1])
                    write(np.array([at], "<i4").tobytes())
        finally:
            packed.unpersist()
    finally:
        held.unpersist()


def in_order(packed: DataFrame, column: str) -> Iterator[tuple[int, bytes]]:
    """Number of graphs and bytes of each piece, in the order of gid; a partition is held at a time."""
    before = None
    for first, n, raw in packed.select("first", "n", column).toLocalIterator(prefetchPartitions=True):
        if before is not None and first < before:
            raise RuntimeError("pieces out of order")
        before = first
        yield n, bytes(raw)


@contextmanager
def created(spark: SparkSession, path: str) -> Iterator[Callable[[bytes], None]]:
    """A function that appends bytes to a new file on any of Hadoop's file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)

    def write(raw: bytes) -> None:
        for i in range(0, len(raw), 1 << 22):
            stream.write(bytearray(raw[i : i + (1 << 22)]))

    try:
        yield write
    finally:
        stream.close()


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Numbers of vertices and of edges of each graph, all vertex labels, and src, dst, label of all edges."""
    v, e = batch.column("vlabels"), batch.column("edges")
    labels, edges = v.flatten(), e.flatten()
    columns = [labels, *(edges.field(i) for i in range(3))]
    if any(c.null_count for c in columns):
        raise ValueError("a null label or end can't be written")
    sizes = [np.asarray(x.value_lengths().fill_null(0), np.int64) for x in (v, e)]
    found = [c.to_numpy(zero_copy_only=False).astype("<i4") for c in columns]
    return *sizes, found[0], found[1:]


def within(sizes: np.ndarray) -> np.ndarray:
    """Numbers from 0 in each of the runs of such sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def packed_bin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """first (gid), n, sizes (of the graphs with their lengths, 64-bit) and content of pieces of the binary form."""
    for batch in batches:
        if not batch.num_rows:
            continue
        nv, ne, labels, edges = flat(batch)
        words = 3 + nv + 3 * ne
        starts = np.cumsum(words) - words
        out = np.empty(words.sum(), "<i4")
        long = (4 * (words - 2)).astype("<i8").view("<i4").reshape(-1, 2)
        out[starts], out[starts + 1], out[starts + 2] = long[:, 0], long[:, 1], nv
        out[np.repeat(starts + 3, nv) + within(nv)] = labels
        at = np.repeat(starts + 3 + nv, ne) + 3 * within(ne)
        for i, c in enumerate(edges):
            out[at + i] = c
        yield pa.RecordBatch.from_arrays([pa.array([batch.column("gid")[0].as_py()], pa.int64()), pa.array([batch.num_rows], pa.int64()), pa.array([(4 * words).astype("<i8").tobytes()], pa.binary()), pa.array([out.tobytes()], pa.binary())], names=["first", "n", "sizes", "content"])


def packed_columns(batches: Iterator[pa.RecordBatch], widest: int) -> Iterator[pa.RecordBatch]:
    """first (gid), n and the four arrays of pieces of the column form, places and offsets counted from the piece's start."""
    for batch in batches:
        if not batch.num_rows:
            continue
        nv, ne, labels, (src, dst, label) = flat(batch)
        n = batch.num_rows
        start = widest * np.repeat(np.arange(n), ne)
        a, b, x = np.concatenate([start + src, start + dst]), np.concatenate([start + dst, start + src]), np.concatenate([label, label])
        order = np.lexsort((x, b, a))
        places = widest * np.repeat(np.arange(n), nv) + within(nv)
        vlabels, offsets = np.full(n * widest, -1, "<i4"), np.full(n * widest + 1, -1, "<i4")
        vlabels[places] = labels
        offsets[places] = np.searchsorted(a[order], places)
        offsets[-1] = len(a)
        arrays = [b[order].astype("<i4"), x[order].astype("<i4"), vlabels, offsets]
        yield pa.RecordBatch.from_arrays([pa.array([batch.column("gid")[0].as_py()], pa.int64()), pa.array([n], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in arrays)], names=["first", "n", "ends", "labels", "vlabels", "offsets"])


def concatenate(collections: list[DataFrame]) -> DataFrame:
    """Collections one after the other, graphs numbered on."""
    out, start = None, 0
    for c in collections:
        moved = c.withColumn("gid", F.col("gid") + start)
        out = moved if out is None else out.unionByName(moved)
        last = c.agg(F.max("gid")).first()[0]
        start += 0 if last is None else last + 1
    return out
