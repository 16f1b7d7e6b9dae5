"""N-gram Jaccard join by parity sketches, and the components of its links.

A document is its set of word n-grams, as 64-bit codes. Equal texts form a class, and classes are
what is joined: copies are counted where they lie and only one of them goes on. Sets whose
similarity reaches the threshold t differ in at most (1 - t) / (1 + t) of their summed sizes, so
every band of sizes has a greatest difference d.

Candidates. The code space is cut into more than d blocks. A block's parity word is the XOR of its
members' codes: one differing n-gram changes one block, so among d + 1 filled blocks of two linked
sets one parity word at least is equal. Sets meet in the band of the larger one; a set enters
its own band and, if a partner may lie there, the next. Empty blocks aren't joined on: a set
with so few others that a link could hide behind them also enters with another cut of the code
space, until a cut has enough. A key that many classes of one task have is hot: the first of them
leads, and only the lead goes to the key's task; the others are dealt out with the lead's name.

Filter. A second sketch holds one parity bit for each of its places, of which there are eight
times as many as a link of the set may differ in, or more. The Hamming distance of two such
sketches, the longer one folded, is a lower bound of their symmetric difference; a pair above the
allowed difference is dropped. So the bound works alike at a hundred n-grams and at twenty thousand.

Verification compares the whole texts' sets exactly. In the first round every class is compared
with the first class of one of its groups only, and components are formed. Two more rounds take
what still lies in several components, first classes and groups: one verifies a spanning forest of
the pairs that pass the filter, so that a group of copies never becomes all its pairs, and the
last one every pair whose sides are still apart. So no link between components stays unseen. Pairs
are sent to their first class in parts of bounded size, and a text travels once for each part or
pair that needs it.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.arrow import map_rows
from latticework.llm.components import connected
from latticework.llm.scratch import Scratch

U = np.uint64
LEAST_PLACES = 512  # bits of the smallest sketch
CHUNK = 1024  # classes of one side of a block of comparisons
PART = 256  # pairs verified with one copy of their first class's text
HOT = 8  # classes of a task's chunk from which on a key is hot
CHUNK_KEYS = 400_000  # keys of a chunk
SALTS = 1024  # parts that a hot key's classes are dealt to
PLAIN, LEADS = -1, -2
LONG = 10_000  # classes of a key that are held at a time
WORDED = "[^ \\t\\n\\x0B\\f\\r]"  # a character of a word


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct codes of a text's word n-grams; a shorter text is one sequence, an empty one none.

    Words are runs of anything but space and U+0009 to U+000D, with A-Z lower-cased.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, U)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00" + b" ".join(words))], U)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    m, total = len(words) - n + 1, np.zeros(1, U)
    for k in range(n):
        total = mixed(total + codes[k : k + m])
    return np.unique(total)


class Bands:
    """Bands of set sizes for a threshold of ``percent`` per hundred."""

    def __init__(self, percent: int):
        self.percent = percent
        starts = [1]
        while starts[-1] < 1 << 40:
            starts.append(max(starts[-1] + 1, -(-starts[-1] * 3 // 2), starts[-1] * 100 // percent + 1))
        self.starts = starts
        self.lookup = np.array(starts)

    def allowed(self, sizes):
        """Greatest symmetric difference of two linked sets, by their summed sizes."""
        return sizes * (100 - self.percent) // (100 + self.percent)

    def blocks(self, band: int) -> int:
        """Blocks of a band: one more than its greatest difference, and room for those that stay empty.

        The room is twice the number of empty ones to expect in the largest set and three times
        its deviation, so that nearly every set has enough others in its first cut.
        """
        most = self.starts[band + 1] - 1
        least = int(self.allowed(2 * most)) + 1
        empty = least * math.exp(-most / least)
        return least + math.ceil(2 * empty + 3 * math.sqrt(empty))

    def keys(self, codes: np.ndarray) -> list[np.ndarray]:
        """Join keys of a sorted, non-empty set in all bands it enters."""
        size = len(codes)
        own = int(np.searchsorted(self.lookup, size, "right")) - 1
        out = []
        for band in (own, own + 1):
            partner = min(self.starts[band + 1] - 1, size * 100 // self.percent)
            if partner < self.starts[band]:
                break
            blocks = self.blocks(band)
            d = int(self.allowed(size + partner))
            cut = 0
            while True:
                own_codes = codes if not cut else np.sort(mixed(codes + U(cut)))
                at = np.searchsorted(own_codes, edges(blocks))
                filled = np.flatnonzero(np.diff(at, append=size))
                words = np.bitwise_xor.reduceat(own_codes, at[filled])
                place = filled.astype(U) + U(blocks << 24) + U((cut & 0xFF) << 56)
                out.append(mixed(words ^ mixed(place)))
                if len(filled) > d:
                    break
                cut += 1
        return out


@functools.lru_cache(maxsize=256)
def edges(blocks: int) -> np.ndarray:
    """First code of each of so many equal blocks of the code space."""
    return np.array([(i << 64) // blocks for i in range(blocks)], U)


@functools.lru_cache(maxsize=8)
def bands(percent: int) -> Bands:
    return Bands(percent)


def places(size: int, percent: int) -> int:
    """Bits of a set's sketch: a power of two, eight times the difference that a link allows or more."""
    return max(LEAST_PLACES, 1 << int(8 * bands(percent).allowed(2 * size)).bit_length())


def parity(codes: np.ndarray, percent: int) -> np.ndarray:
    """The sketch: at each place, whether an odd number of codes falls there."""
    n = places(len(codes), percent)
    counts = np.bincount((mixed(codes) & U(n - 1)).astype(np.int64), minlength=n)
    return np.packbits(counts & 1)


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the shortest one's length.

    A code's place is the low bits of its hash, so halves added without carry are the sketch of
    half as many places.
    """
    lengths = np.array([len(s) for s in sketches])
    least = int(lengths.min()) // 8
    out = np.empty((len(sketches), least), U)
    for n in np.unique(lengths):
        which = np.flatnonzero(lengths == n)
        rows = np.frombuffer(b"".join([sketches[i] for i in which]), U).reshape(len(which), -1)
        while rows.shape[1] > least:
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:]
        out[which] = rows
    return out


def distances(first: list[bytes], second: list[bytes]) -> np.ndarray:
    """Hamming distances of pairs of sketches."""
    lengths = np.array([min(len(x), len(y)) for x, y in zip(first, second)])
    out = np.zeros(len(first), np.int64)
    for n in np.unique(lengths):
        which = np.flatnonzero(lengths == n)
        rows = folded([first[i] for i in which] + [second[i] for i in which])
        out[which] = np.bitwise_count(rows[: len(which)] ^ rows[len(which) :]).sum(axis=1, dtype=np.int64)
    return out


def sets(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """class, n_shingles, sketch of every class of texts (class, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [shingles(t, n) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(c) for c in found], pa.int64()), pa.array([parity(c, percent).tobytes() for c in found], pa.binary())],
                    names=["class", "n_shingles", "sketch"],
                )

    return map_rows(texts, [("class", "class", "long"), ("text", "text", "string")], run, "class long, n_shingles long, sketch binary")


def keyed(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """key, class, lead of every class's join keys.

    lead is PLAIN, but for a key that is hot in a chunk: there the first class's row has LEADS, and
    each of its classes, the first included, has a row that names the first. A hot key thus has
    one row with LEADS for each chunk of the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, waiting, size = bands(percent), [], 0

        def chunk() -> Iterator[pa.RecordBatch]:
            k = np.concatenate([x for _, keys in waiting for x in keys]).view(np.int64)
            c = np.repeat(np.array([x for x, _ in waiting]), [sum(map(len, keys)) for _, keys in waiting])
            k, c = distinct_rows(k, c)
            starts, count = runs(k)
            hot = count >= HOT
            lead = np.full(len(k), PLAIN)
            lead[starts[hot]] = LEADS
            rest = np.repeat(hot, count)
            one = ~rest
            one[starts] = True
            for which, leads in ((one, lead), (rest, np.repeat(c[starts], count))):
                at = np.flatnonzero(which)
                for i in range(0, len(at), 100_000):
                    rows = at[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(k[rows]), pa.array(c[rows]), pa.array(leads[rows])], names=["key", "class", "lead"])

        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                for c, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    keys = own.keys(shingles(text, n))
                    waiting.append((c, keys))
                    size += sum(map(len, keys))
                if size > CHUNK_KEYS:
                    yield from chunk()
                    waiting, size = [], 0
        if waiting:
            yield from chunk()

    return map_rows(texts, [("class", "class", "long"), ("text", "text", "string")], run, "key long, class long, lead long")


def distinct_rows(k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by both, each once."""
    order = np.lexsort((c, k))
    k, c = k[order], c[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return k[fresh], c[fresh]


def runs(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return starts, np.diff(np.append(starts, len(k)))


def shared_keys(rows: DataFrame) -> DataFrame:
    """group, class, first of keys that several classes have.

    Two classes alone are one row, without a group. Of more, every class has a row, the first one
    too; keys with the same classes are one group. Rows come sorted by key and class, so a key
    streams through whatever its size: one with more than LONG classes is a group by its own key,
    and so is a hot one, whose dealt classes have their lead as first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(g: np.ndarray, c: np.ndarray, f: np.ndarray, ok: np.ndarray | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(g, mask=ok), pa.array(c), pa.array(f)], names=["group", "class", "first"])

        def complete(k: np.ndarray, c: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
            starts, count = runs(k)
            own = np.logical_or.reduceat(hot, starts)
            name = np.where(own, k[starts], np.bitwise_xor.reduceat(mixed(c.view(U)), starts).view(np.int64))
            pair = ~own & (count == 2)
            keep = np.repeat(own | (count > 1), count)
            keep[starts[pair]] = False
            return rows_of(np.repeat(name, count)[keep], c[keep], np.repeat(c[starts], count)[keep], np.repeat(pair, count)[keep])

        none = np.zeros(0, np.int64)
        k, c, hot = none, none, none.astype(bool)  # the last group's rows, which may go on
        going = None  # key, first and last class of a group too long to be held
        for batch in batches:
            new_k, new_c, lead = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            dealt = lead >= 0
            if dealt.any():
                yield rows_of(new_k[dealt], new_c[dealt], lead[dealt])
            k, c, hot = np.append(k, new_k[~dealt]), np.append(c, new_c[~dealt]), np.append(hot, lead[~dealt] == LEADS)
            if not len(k):
                continue
            fresh = np.ones(len(k), bool)
            fresh[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
            # A class may have a key twice, as plain and leading: it leads then.
            hot = np.logical_or.reduceat(hot, np.flatnonzero(fresh))
            k, c = k[fresh], c[fresh]
            if going:
                n = int(np.searchsorted(k, going[0], "right")) if k[0] == going[0] else 0
                more = c[:n][c[:n] != going[2]]
                if len(more):
                    yield rows_of(np.full(len(more), going[0]), more, np.full(len(more), going[1]))
                    going = (going[0], going[1], more[-1])
                k, c, hot = k[n:], c[n:], hot[n:]
                if not len(k):
                    continue
                going = None
            last = int(np.searchsorted(k, k[-1]))
            if last:
                yield complete(k[:last], c[:last], hot[:last])
            k, c, hot = k[last:], c[last:], hot[last:]
            if len(k) > LONG:
                yield rows_of(k, c, np.full(len(k), c[0]))
                going, k, c, hot = (k[0], c[0], c[-1]), none, none, none.astype(bool)
        if len(k):
            yield complete(k, c, hot)

    part = F.when(F.col("lead") < 0, F.lit(-1)).otherwise(F.pmod(F.xxhash64("class"), F.lit(SALTS)))
    return rows.repartition("key", part).sortWithinPartitions("key", "class").mapInArrow(run, "group long, class long, first long").distinct()


def near_enough(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches leave room for a link. pairs: a, b, n_a, n_b, s_a, s_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                a, b, n_a, n_b, s_a, s_b = batch.slice(start, 1024).columns
                size = n_a.to_numpy() + n_b.to_numpy()
                keep = pa.array(distances(s_a.to_pylist(), s_b.to_pylist()) * (100 + percent) <= size * (100 - percent))
                yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return pairs.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def rivals(members: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs of classes of one group, of different components, that the sketches don't rule out.

    With ``forest``, a block returns only as many pairs as join what its pairs would join; the
    others follow in a later round if those pairs prove to be no links.

    ``members``: group, class, comp, n_shingles, sketch, of unresolved groups. A group with more
    than CHUNK classes is dealt out in blocks; two sides of a block are in one task at a time.
    """
    size = members.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
    dealt = members.join(size, "group").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(F.col("part"), o).alias("i"), F.greatest(F.col("part"), o).alias("j")))
    rows = dealt.withColumn("block", F.explode(both)).select("group", F.col("block.i").alias("i"), F.col("block.j").alias("j"), "part", "class", "comp", F.col("n_shingles").alias("n"), "sketch")

    def compare(block: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        c, comp, n, part = (block[x] for x in ("class", "comp", "n", "part"))
        i, j = block["i"][0], block["j"][0]
        bits = folded(block["sketch"].tolist())
        comp = comp.copy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for x in np.flatnonzero(part == i):
            y = np.flatnonzero((part == j) & (comp != comp[x]) & ((c > c[x]) if i == j else True))
            if len(y):
                apart = np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1, dtype=np.int64)
                y = y[apart * (100 + percent) <= (n[y] + n[x]) * (100 - percent)]
                if forest and len(y):
                    labels, one = np.unique(comp[y], return_index=True)
                    y = y[one]
                    comp[np.isin(comp, labels)] = comp[x]
                found.append((np.full(len(y), c[x]), c[y]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = (np.concatenate(z) for z in zip(*found))
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ("group", "i", "j")):
            a, b = compare(group)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "class").mapInArrow(run, "a long, b long").distinct()


def sorted_groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Groups of equal ``by`` columns of sorted batches, each as arrays by column; one group is held at a time."""
    held: list[dict[str, np.ndarray]] = []
    join = lambda parts: {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {f: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(batch.schema.names)}
        change = np.zeros(batch.num_rows - 1, bool)
        for k in by:
            change |= cols[k][1:] != cols[k][:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            part = {k: v[start:end] for k, v in cols.items()}
            if held and any(held[0][k][0] != part[k][0] for k in by):
                yield join(held)
                held = []
            held.append(part)
    if held:
        yield join(held)


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose whole texts' sets are linked. texts: class, text.

    A class's pairs lie in parts of PART; each part gets its text once, before those of its pairs.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    side = lambda x: texts.select(F.col("class").alias(x), "text")
    first = parts.join(side("a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    rows = first.unionByName(dealt.join(side("b"), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = None
        for batch in batches:
            found: tuple[list[int], list[int]] = ([], [])
            for start in range(0, batch.num_rows, 128):
                for a, b, text in zip(*(c.to_pylist() for c in batch.slice(start, 128).columns), strict=True):
                    y = shingles(text, n)
                    if b is None:
                        x = y
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        found[0].append(a)
                        found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["a", "b"])

    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "b").select("a", "b", "text").mapInArrow(run, "a long, b long").distinct()


def components_of(texts: DataFrame, sized: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """class, comp of every class with a link. texts: class, text; dropped when no longer needed."""
    groups = scratch.keep(shared_keys(keyed(texts, n, percent)))
    stars = groups.filter("class != first").select(F.col("first").alias("a"), F.col("class").alias("b")).distinct()
    side = lambda x: sized.select(F.col("class").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    likely = scratch.keep(near_enough(stars.join(side("a"), "a").join(side("b"), "b"), percent))
    members = scratch.keep(groups.filter("group is not null").select("group", "class").distinct())
    scratch.drop(groups)
    needed = likely.select(F.col("a").alias("class")).union(likely.select("b")).union(members.select("class")).distinct()
    near = scratch.keep(texts.select("class", "text").join(needed, "class", "left_semi"))

    tried = scratch.keep(likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = scratch.keep(verified(tried, near, n, percent))
    comps = connected(links, scratch=scratch)
    for forest in (True, False):
        at = lambda x: comps.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}"))  # noqa: E731, B023
        rest = likely.join(at("a"), "a", "left").join(at("b"), "b", "left")
        rest = rest.select("a", "b", F.coalesce("comp_a", "a").alias("x"), F.coalesce("comp_b", "b").alias("y")).filter("x != y")
        if forest:  # one pair for two components
            rest = rest.groupBy(F.least("x", "y"), F.greatest("x", "y")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
        placed = members.join(comps.select(F.col("node").alias("class"), "comp"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
        several = placed.groupBy("group").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("group")
        unresolved = scratch.keep(placed.join(several, "group").join(sized, "class"))
        pairs = rest.select("a", "b").union(rivals(unresolved, percent, forest)).distinct()
        pairs = scratch.keep(pairs.join(tried, ["a", "b"], "left_anti"))
        links = scratch.keep(verified(pairs, near, n, percent))
        scratch.drop(unresolved)
        tried = tried.union(pairs)
        if not links.isEmpty():
            comps = connected(links.union(comps.select("node", "comp")), scratch=scratch)
    scratch.drop(near, members, likely)
    return comps.select(F.col("node").alias("class"), "comp")


def with_digest(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """doc_id, text, worded, digest, and ``more``. The digest is that of a text with words, and of any other row a value of its own."""
    own, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    worded = F.coalesce(text.rlike(WORDED), F.lit(False))
    digest = F.when(worded, F.unhex(F.md5(text.cast("binary")))).otherwise(F.encode(own.cast("string"), "utf-8"))
    return docs.select(own.alias("doc_id"), text.alias("text"), worded.alias("worded"), digest.alias("digest"), *more)


def linked_texts(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """digest, doc_id, n_shingles, component_id, stays of every text with words.

    doc_id is the least that has the text; stays marks one text of each component, that of the
    least doc_id. A text that only rows with a null id have takes no part.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    plain = with_digest(docs, id_col, text_col).filter("worded")
    reps = scratch.keep(plain.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("class", F.monotonically_increasing_id()))
    # A text that only rows without an id have is read from one of those.
    at = F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("at")
    rows = plain.select("digest", at, "text").join(reps.select("digest", at, "doc_id", "class"), ["digest", "at"]).dropDuplicates(["digest", "at"])
    texts = scratch.keep(rows.select("class", "doc_id", "text"), compression="zstd")
    sized = scratch.keep(sets(texts, n, percent))
    comps = components_of(texts.filter("doc_id is not null"), sized, n, percent, scratch)
    scratch.drop(texts)
    root = reps.join(comps, "class", "left").withColumn("comp", F.coalesce("comp", "class")).join(sized.select("class", "n_shingles"), "class")
    least = root.groupBy("comp").agg(F.min(F.struct("doc_id", "class")).alias("least"))
    named = root.join(least, "comp")
    return scratch.keep(named.select("digest", "doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), (F.col("least.class") == F.col("class")).alias("stays")))


def link_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of word
    n-grams; component_id is the smallest doc_id reachable by links, itself included. A null or
    empty text, or one without words, has an empty set and links with nothing; a text may have any
    length. A row with a null id takes no part and has a null component. Repeated rows link with
    each other, their sets being equal; rows of one id and several texts go by their own texts. An
    empty table gives an empty one; other columns are not read.
    """
    found = linked_texts(docs, n, percent, id_col, text_col)
    rows = with_digest(docs, id_col, text_col).select("doc_id", "digest")
    out = rows.join(found.select("digest", "n_shingles", "component_id"), "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), own.alias("component_id"))


def one_per_component(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that stay: of each component the one with the least doc_id.

    Of repeated rows one stays. Rows of one id and different texts fall together only if their
    texts are linked; of those that are, the one with the smaller place in the table of texts
    stays. Rows with a null id, and rows without words, all stay: they take no part in links.
    """
    stays = linked_texts(docs, n, percent, "doc_id", "text").filter("stays and doc_id is not null").select("digest", "doc_id")
    rows = with_digest(docs, "doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).drop("text")
    one = rows.filter("worded and doc_id is not null").join(stays, ["digest", "doc_id"], "left_semi").dropDuplicates(["digest", "doc_id"])
    return one.select("row.*").unionByName(rows.filter("not worded or doc_id is null").select("row.*"))
