"""Chroma audio fingerprints, and the alignment of recordings by them.

A recording becomes frames of the energy in the twelve pitch classes. Sixteen filters, each a
difference of two rectangles of a window of frames, are read off the integral image; each result
is cut into four steps, coded in two bits whose neighbours differ in one, and the sixteen make one
32-bit integer for each window. Recordings meet on equal integers: for a pair, the histogram of
offsets between equal integers shows where they align, and there the share of differing bits
decides.
"""

from __future__ import annotations

import functools
import hashlib
import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.jaccard_join import mixed
from latticework.llm.scratch import Scratch

RATE = 4096
FRAME, HOP = 1024, 256
WIDEST = 16
#: Kind of split, width in frames, height in pitch classes, lowest class: by a rule over i.
FILTERS = [(i % 5, (4, 8, 12, 16)[i % 4], (6, 12, 9, 6)[i // 4], (5 * i) % 12) for i in range(16)]
STEP = 0.12  # half width of the two inner steps of a filter's logarithm
GRAY = np.array([0, 1, 3, 2], np.uint32)


@functools.cache
def pitch_weights() -> np.ndarray:
    """Which pitch class each frequency bin between 100 and 1600 Hz counts for."""
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    use = (hertz >= 100) & (hertz <= 1600)
    weights = np.zeros((len(hertz), 12), np.float32)
    weights[np.flatnonzero(use), np.round(12 * np.log2(hertz[use] / 440)).astype(int) % 12] = 1
    return weights


def chroma(samples: np.ndarray, slice_frames: int = 4096) -> np.ndarray:
    """Frames of twelve pitch classes, each of length one; silent frames are zero.

    A recording of any length is transformed slice by slice, so memory follows a slice.
    """
    if len(samples) < FRAME:
        return np.zeros((0, 12), np.float32)
    every = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out, window = np.empty((len(every), 12), np.float32), np.hanning(FRAME).astype(np.float32)
    for start in range(0, len(every), slice_frames):
        frames = every[start : start + slice_frames] * window
        energy = (np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32) ** 2) @ pitch_weights()
        length = np.linalg.norm(energy, axis=1, keepdims=True)
        out[start : start + slice_frames] = np.where(length > 1e-6, energy / np.maximum(length, 1e-6), 0)
    return out


def wav_samples(raw: bytes) -> np.ndarray:
    """Samples at RATE of a WAV file's bytes: 8 or 16 bits, any rate, channels averaged."""
    with wave.open(io.BytesIO(raw)) as file:
        width, rate, channels = file.getsampwidth(), file.getframerate(), file.getnchannels()
        if width not in (1, 2):
            raise ValueError(f"samples of {8 * width} bits aren't read")
        data = np.frombuffer(file.readframes(file.getnframes()), "<i2" if width == 2 else np.uint8)
    whole = (data.astype(np.float32) - (128 if width == 1 else 0)) / (128.0 if width == 1 else 32768.0)
    whole = whole[: len(whole) // channels * channels].reshape(-1, channels).mean(axis=1)
    at = np.arange(int(len(whole) * RATE / rate)) * (rate / RATE)
    return np.interp(at, np.arange(len(whole)), whole).astype(np.float32) if len(whole) else whole


def codes(frames: np.ndarray) -> np.ndarray:
    """One packed integer for each window of WIDEST frames."""
    n = len(frames) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    # Pitch classes wrap round, so a rectangle may begin at any of them.
    image = np.zeros((len(frames) + 1, 25))
    image[1:, 1:] = np.cumsum(np.cumsum(np.hstack([frames, frames]), axis=0), axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, b0: int, b1: int) -> np.ndarray:
        return image[at + t1, b1] - image[at + t0, b1] - image[at + t1, b0] + image[at + t0, b0]

    out = np.zeros(n, np.uint32)
    for kind, w, h, low in FILTERS:
        whole, half, third, mid = area(0, w, low, low + h), w // 2, h // 3, low + h // 2
        if kind == 0:
            part = area(0, w, mid, low + h)
        elif kind == 1:
            part = area(half, w, low, low + h)
        elif kind == 2:
            part = area(0, half, low, mid) + area(half, w, mid, low + h)
        elif kind == 3:
            part = area(0, w, low + third, low + h - third)
        else:
            part = area(w // 4, w - w // 4, low, low + h)
        value = np.log1p(part) - np.log1p(np.maximum(whole - part, 0))
        out = out << np.uint32(2) | GRAY[np.digitize(value, (-STEP, 0, STEP))]
    return out


def digest(found: np.ndarray) -> str | None:
    return hashlib.sha256(found.tobytes()).hexdigest()[:32] if len(found) else None


def fingerprint_recordings(media: DataFrame, id_col: str, source_col: str, load: Callable[[object], np.ndarray] | None = None, source_type: str = "array<float>", ask: Callable[[object], np.ndarray] | None = None, every: int = 0) -> DataFrame:
    """id, codes (array<int>), class (a digest of the codes) of every recording.

    ``load`` turns the source column's value into samples at RATE; by default the value is the
    samples, and ``wav_samples`` reads files' bytes. A null, empty or too short recording has no
    codes and a null class; one of any length is transformed in slices. Null ids and repeated rows
    stay, an empty table gives an empty one, other columns are not read. With ``ask``, ids that
    ``every`` divides have asked_codes and asked_class too, of the samples that ``ask`` gives.
    """
    read = load or (lambda value: np.asarray(value, np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda fn, v: codes(chroma(fn(v))) if v is not None and len(v) else np.zeros(0, np.uint32)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                values = part.column(1).to_pylist()
                found = [[of(read, v) for v in values]]
                if ask:
                    found.append([of(ask, v) if i is not None and i % every == 0 else np.zeros(0, np.uint32) for i, v in zip(part.column(0).to_pylist(), values)])
                columns = [x for f in found for x in (pa.array([c.view(np.int32) for c in f], pa.list_(pa.int32())), pa.array([digest(c) for c in f], pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "codes", "class", "asked_codes", "asked_class"][: 1 + len(columns)])

    schema = "id long, codes array<int>, class string" + (", asked_codes array<int>, asked_class string" if ask else "")
    return media.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{source_col}`").cast(source_type).alias("source")).mapInArrow(run, schema)


def postings(index: DataFrame, hot: int = 64) -> DataFrame:
    """key, part, matches, places (binary, 64 and 32 bits): where the index has an integer.

    index: match_id, match_codes. An integer's places in a chunk of recordings are one row; where
    they are ``hot`` or more, the row has a part by chunk, so no task gets all of a frequent integer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, chunk = TaskContext.get(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                lengths = np.array(part.column(1).value_lengths().to_pylist(), np.int64)
                key = part.column(1).flatten().to_numpy(zero_copy_only=False)
                match = np.repeat(part.column(0).to_numpy(zero_copy_only=False), lengths)
                place = np.arange(len(key)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                order = np.argsort(key, kind="stable")
                key, match, place = key[order], match[order].astype("<i8"), place[order].astype("<i4")
                starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
                ends = np.append(starts[1:], len(key))
                chunk += 1
                own = 1 + (hash((context.partitionId() if context else 0, chunk)) & 0x3FFFFFFF)
                for i in range(0, len(starts), 20_000):
                    pairs = list(zip(starts[i : i + 20_000].tolist(), ends[i : i + 20_000].tolist()))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key[starts[i : i + 20_000]], pa.int32()), pa.array([own if e - s >= hot else 0 for s, e in pairs], pa.int32()),
                            pa.array([match[s:e].tobytes() for s, e in pairs], pa.binary()), pa.array([place[s:e].tobytes() for s, e in pairs], pa.binary()),
                        ],
                        names=["key", "part", "matches", "places"],
                    )

    return index.select("match_id", "match_codes").mapInArrow(run, "key int, part int, matches binary, places binary")


def merged(rows: DataFrame, spread: int) -> DataFrame:
    """Rows of ``postings`` of one key and part put together, up to some ``spread`` places a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size = [], None, 0

        def flush() -> None:
            if held:
                out.append((held[0], held[1], b"".join(held[2]), b"".join(held[3])))

        for batch in batches:
            for key, part, matches, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[0], held[1]) == (key, part) and size < spread:
                    held[2].append(matches)
                    held[3].append(places)
                    size += len(places) // 4
                else:
                    flush()
                    held, size = (key, part, [matches], [places]), len(places) // 4
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "part", "matches", "places"), x)) for x in out], POSTING) if out else pa.RecordBatch.from_pylist([], POSTING)
            out.clear()
        flush()
        yield pa.RecordBatch.from_pylist([dict(zip(("key", "part", "matches", "places"), x)) for x in out], POSTING)

    return rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run, "key int, part int, matches binary, places binary")


POSTING = pa.schema([("key", pa.int32()), ("part", pa.int32()), ("matches", pa.binary()), ("places", pa.binary())])


def vote(met: DataFrame, least_votes: int, share: int) -> DataFrame:
    """class, match_id, match_offset with ``least_votes`` equal integers. met: class, at, matches, places.

    A query's places are counted together; one with more than ``share`` of them is dealt to as
    many parts by the recording, so that a task's group has a bound.
    """
    many = met.groupBy("class").agg(F.sum(F.length("places") / 4).alias("n")).filter(F.col("n") > share).select("class", F.ceil(F.col("n") / share).cast("int").alias("parts"))
    rows = met.join(many, "class", "left").select("class", "at", "matches", "places", F.coalesce("parts", F.lit(1)).alias("parts"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                out: tuple[list, ...] = ([], [], [], [])
                for c, at, matches, places, parts in zip(*(x.to_pylist() for x in batch.slice(start, 1000).columns), strict=True):
                    offsets = np.frombuffer(places, "<i4") - np.int32(at)
                    match = np.frombuffer(matches, "<i8")
                    which = (mixed(match.view(np.uint64)) % np.uint64(parts)).astype(np.int64) if parts > 1 else np.zeros(len(match), np.int64)
                    for p in np.unique(which).tolist():
                        own = which == p
                        for column, x in zip(out, (c, p, match[own].tobytes(), offsets[own].tobytes())):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.string(), pa.int32(), pa.binary(), pa.binary()))], names=["class", "part", "matches", "offsets"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def counted() -> pa.RecordBatch:
            match, offset = np.frombuffer(b"".join(held[2]), "<i8"), np.frombuffer(b"".join(held[3]), "<i4")
            order = np.lexsort((offset, match))
            match, offset = match[order], offset[order]
            starts = np.flatnonzero(np.append(True, (match[1:] != match[:-1]) | (offset[1:] != offset[:-1])))
            enough = starts[np.diff(np.append(starts, len(match))) >= least_votes]
            return pa.RecordBatch.from_arrays([pa.array([held[0]] * len(enough), pa.string()), pa.array(match[enough], pa.int64()), pa.array(offset[enough], pa.int32())], names=["class", "match_id", "match_offset"])

        for batch in batches:
            for c, p, matches, offsets in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and (held[0], held[1]) != (c, p):
                    yield counted()
                    held = None
                held = held or (c, p, [], [])
                held[2].append(matches)
                held[3].append(offsets)
        if held:
            yield counted()

    dealt = rows.mapInArrow(deal, "class string, part int, matches binary, offsets binary")
    return dealt.repartition("class", "part").sortWithinPartitions("class", "part").mapInArrow(count, "class string, match_id long, match_offset int")


def align_classes(own: DataFrame, reps: DataFrame, scratch: Scratch, least_votes: int, most_error: float, spread: int) -> DataFrame:
    """class, match_id, match_offset, bit_error, n of every verified alignment. own: class, codes; reps: match_id, match_codes."""
    keys = own.select("class", F.posexplode("codes").alias("at", "key"))
    met = scratch.keep(keys.join(merged(postings(reps), spread), "key").select("class", "at", "matches", "places"))
    voted = vote(met, least_votes, share=64 * spread)
    sides = voted.join(own, "class").join(reps, "match_id")
    first = F.greatest(F.lit(0), -F.col("match_offset"))
    n = F.least(F.size("codes") - first, F.size("match_codes") - first - F.col("match_offset"))
    bits = F.zip_with(F.slice("codes", first + 1, n), F.slice("match_codes", first + F.col("match_offset") + 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))  # bit_count widens an int with its sign
    error = F.aggregate(bits, F.lit(0), lambda a, b: a + b) / (32.0 * n)
    scored = sides.select("class", "match_id", "match_offset", error.alias("bit_error"), n.alias("n")).filter(F.col("bit_error") <= most_error)
    pairs = scored.groupBy("class", "match_id").agg(F.max(F.struct(agreement(), -F.abs("match_offset"), "match_offset", "bit_error", "n")).alias("b"))
    return pairs.select("class", "match_id", "b.match_offset", "b.bit_error", "b.n")


def representatives(index: DataFrame) -> DataFrame:
    """match_id, match_codes: of recordings with equal codes the smallest id."""
    return index.filter("class is not null and id is not null").groupBy("class").agg(F.min("id").alias("match_id"), F.first("codes").alias("match_codes")).select("match_id", "match_codes")


def align_all(queries: DataFrame, index: DataFrame, least_votes: int = 2, most_error: float = 0.35, spread: int = 1000) -> DataFrame:
    """Every verified alignment: id, match_id, match_offset, bit_error, n, a row for each query and class of the index.

    Both tables have id, codes, class; recordings with equal codes stand as one, by the smallest
    id, and so do queries until the end. A query probes with all of its integers, and every
    recording is indexed; an integer's places travel ``spread`` at a time. An alignment needs
    ``least_votes`` equal integers at one offset and at most ``most_error`` of the overlap's bits
    differing; every offset with the votes is verified, and of a pair's the one with most bits
    equal beyond chance counts (at overlaps of one length: the least bit error), then the one
    nearest to 0. n is the overlap.
    """
    named = queries.filter("class is not null and id is not null").select("id", "class", "codes")
    own = named.groupBy("class").agg(F.first("codes").alias("codes"))
    pairs = align_classes(own, representatives(index), Scratch(queries.sparkSession, "chroma"), least_votes, most_error, spread)
    return named.select("id", "class").join(pairs, "class").select("id", "match_id", "match_offset", "bit_error", "n")


def agreement() -> Column:
    """What orders alignments: equal bits beyond chance, so that a few equal integers at an edge don't win over a whole excerpt."""
    return F.round(F.col("n") * (0.5 - F.col("bit_error")), 9).alias("agreement")


def best_of(found: DataFrame, by: str = "id") -> DataFrame:
    """Each query's best alignment, then the smaller id."""
    best = found.groupBy(by).agg(F.max(F.struct(agreement(), -F.col("match_id"), "match_id", "match_offset", "bit_error")).alias("b"))
    return best.select(by, "b.match_id", "b.match_offset", "b.bit_error")


def align(queries: DataFrame, index: DataFrame, least_votes: int = 2, most_error: float = 0.35) -> DataFrame:
    """Each query's best alignment of ``align_all``. Queries without one are absent."""
    return best_of(align_all(queries, index, least_votes, most_error))


def tones(vector: list[float]) -> np.ndarray:
    """A recording made from a vector: each value is a tone of an eighth of a second, by its size."""
    step = np.floor(np.nan_to_num(np.asarray(vector, np.float64)) * 40).astype(np.int64) % 24
    hertz = np.repeat(220.0 * 2 ** (step / 12), RATE // 8)
    return np.sin(2 * np.pi * np.cumsum(hertz) / RATE).astype(np.float32)


def excerpt(vector: list[float]) -> np.ndarray:
    """The middle of a vector's recording, from a place between frames, with some noise."""
    whole = tones(vector)
    part = whole[len(whole) // 4 + 77 : 3 * len(whole) // 4]
    return part + np.random.default_rng(len(whole)).normal(0, 0.1, len(part)).astype(np.float32)


def search_recordings(vectors: DataFrame, every: int = 20, id_col: str = "vec_id", source_col: str = "embedding", least_votes: int = 2, most_error: float = 0.35, spread: int = 1000) -> DataFrame:
    """Fingerprints every vector's recording, and finds noisy excerpts of each ``every``-th among them all.

    Returns, for every row: the id, n_codes, fingerprint, is_query, and for queries the best
    alignment's match_id (the smallest id of equal recordings), match_offset and bit_error, null
    if there is none, and partners: every verified alignment with a class of recordings other than
    its own (match_id, match_offset, bit_error), by match_id. Repeated rows stay, and rows of one
    id go by their own recordings; null ids are no queries; an empty table gives an empty one.
    """
    scratch = Scratch(vectors.sparkSession, "chroma")
    table = scratch.keep(fingerprint_recordings(vectors, id_col, source_col, tones, ask=excerpt, every=every))
    own = table.filter("asked_class is not null").groupBy(F.col("asked_class").alias("class")).agg(F.first("asked_codes").alias("codes"))
    reps = representatives(table)
    pairs = scratch.keep(align_classes(own, reps, scratch, least_votes, most_error, spread).withColumnRenamed("class", "asked_class"))
    least = table.filter("class is not null and id is not null").groupBy("class").agg(F.min("id").alias("least"))
    asked = table.filter("asked_class is not null").select("asked_class", "class").distinct().join(least, "class")
    others = pairs.join(asked, "asked_class").filter("match_id != least").groupBy("asked_class", "class").agg(F.sort_array(F.collect_list(F.struct("match_id", "match_offset", "bit_error"))).alias("partners"))
    found = asked.select("asked_class", "class").join(best_of(pairs, "asked_class"), "asked_class", "left").join(others, ["asked_class", "class"], "left")
    is_query = F.coalesce(F.pmod("id", F.lit(every)) == 0, F.lit(False)).alias("is_query")
    rows = table.select("id", F.size("codes").alias("n_codes"), "class", is_query, "asked_class")
    alone = rows.filter("asked_class is null").select("id", "n_codes", "class", "is_query").unionByName(rows.filter("asked_class is not null").join(found, ["asked_class", "class"]).drop("asked_class"), allowMissingColumns=True)
    return alone.select(F.col("id").alias(id_col), "n_codes", F.col("class").alias("fingerprint"), "is_query", "match_id", "match_offset", "bit_error", "partners")
