"""Masked pseudo-likelihood with a bidirectional window network and a memory of the corpus.

Tokens are words, lower-cased, of any script; in scripts without spaces every character is one, and
so is every other sign. A token is the 32-bit hash of its text; hashes fall in 2**16 places, which
is the vocabulary. (Tokens of a public vocabulary took 280 CPU seconds a GB more.) The network
predicts every token from the three on either side, the token itself masked: the neighbours'
embeddings, each weighed by its distance and side, are summed, pass a tanh layer, and two softmaxes
name the token's class: first a row of classes, then a column. The places most frequent in the
corpus have classes of their own, the others share classes by rank; a place's probability is its
class's, times its share of the class in the corpus. The summed conditional log-probabilities of a
text's tokens are its score.

Every window of the corpus is trained on once, in numpy: texts are dealt to rounds of growing
size; in a round each task runs Adam over its own texts, and the weights are averaged by their
number of tokens, block by block on the executors. Steps grow with the tokens, and what reaches
the driver is one set of weights and one count for each place of the vocabulary.

The memory grows with the corpus too. At every token with two on either side, the whole corpus is
asked what stood between these neighbours elsewhere, in four rounds by the context's hash: the
counts, less the occurrence itself, correct the network's probability, which enters as so many
occurrences as the context has different tokens. So a text whose passages recur elsewhere scores
above one of its own.
"""

from __future__ import annotations

import functools
import pickle
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.arrow import chunks, map_rows
from latticework.llm.jaccard_join import mixed
from latticework.llm.scratch import Scratch

REACH = 3  # tokens on either side that the network sees
NEAR = 2  # tokens on either side that the memory goes by
#: Words of letters, digits and underscores; from U+2E80 on, and other than those, single signs.
SPLIT = re.compile("[^\\W\u2e80-\U0010ffff]+|\\S").findall
SPACE = re.compile("\\s").search
PLACES_ALL = 1 << 16  # places of the vocabulary
GRID = 32
CLASSES = GRID * GRID
BEYOND = CLASSES  # class of what lies beyond a text
EVERY = 8  # remainders of contexts' keys, a power of two
TOGETHER = 2  # remainders of which the memory is asked in one round
FACTORS = {k: np.uint32(f) for k, f in zip((-2, -1, 1, 2), (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))}
HOT = 64  # places of a chunk from which on a context is hot
CHUNK = 1 << 19  # places of a task that ask together
BUCKET = 400_000  # places, about, whose contexts are counted together
BATCH = 1024  # rows that reach Python together while the memory is asked
MEMBER, COUNT, HELD = 0, 1, 2
PACKED = "kind int, at long, chunk long, first long, a binary, b binary, c binary, d binary"
ANSWERS = "kind int, chunk long, first long, a binary, b binary, c binary, d binary"
BLOCK = 1 << 14  # weights that are averaged together
#: First slice of sixteen of each round of training; a text is in the round of its slice.
ROUNDS = (0, 1, 5)
RATES = (0.01, 0.005, 0.002)
PLACES = [*range(-REACH, 0), *range(1, REACH + 1)]


@functools.cache
def sign_kinds() -> np.ndarray:
    """For each code point 0 if it is white space, 1 if words have it, 2 if it is a token of its own; as SPLIT finds."""
    out = np.full(0x110000, 2, np.uint8)
    points = np.arange(len(out), dtype="<u4")
    every = points[(points < 0xD800) | (points >= 0xE000)].tobytes().decode("utf-32-le")
    out[[ord(x) for x in re.findall("\\s", every)]] = 0
    out[[i for i in range(0x2E80) if len(SPLIT(chr(i) + "a")) == 1 and out[i]]] = 1
    return out


def hashes(raw: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """xxh32 of pieces of raw, step by step for all that are shorter than 16 bytes; the others one by one."""
    import xxhash

    data = raw + bytes(4)
    octets, words = np.frombuffer(data, np.uint8), np.ndarray(len(raw) + 1, "<u4", data, strides=(1,))
    one, two, three, four, five = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)
    turned = lambda x, n: x << np.uint32(n) | x >> np.uint32(32 - n)
    out = lengths.astype(np.uint32) + five
    for k in range(3):
        at = np.flatnonzero(lengths >= 4 * k + 4)
        out[at] = turned(out[at] + words[starts[at] + 4 * k] * three, 17) * four
    for k in range(3):
        at = np.flatnonzero(lengths & 3 > k)
        out[at] = turned(out[at] + octets[starts[at] + (lengths[at] & ~3) + k] * five, 11) * one
    out = (out ^ out >> np.uint32(15)) * two
    out = (out ^ out >> np.uint32(13)) * three
    out ^= out >> np.uint32(16)
    for i in np.flatnonzero(lengths >= 16).tolist():
        out[i] = xxhash.xxh32_intdigest(raw[starts[i] : starts[i] + lengths[i]])
    return out


def line_tokens(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a line's tokens, and the code points at which they start."""
    points = np.frombuffer(line.encode("utf-32-le"), "<u4")
    kind = np.concatenate([[0], sign_kinds().take(points), [0]])
    word, sign = kind == 1, kind == 2
    starts = np.flatnonzero((word[1:-1] & ~word[:-2]) | sign[1:-1])
    ends = np.flatnonzero((word[1:-1] & ~word[2:]) | sign[1:-1]) + 1
    raw = line.encode()
    if len(raw) == len(line):
        return hashes(raw, starts, ends - starts), starts
    place = np.concatenate([[0], np.cumsum(1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF))])
    return hashes(raw, place[starts], place[ends] - place[starts]), starts


def token_hashes(texts: list[str | None], most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, one text after the other, and how many each has.

    Some ``most`` code points are worked on together; a longer text is cut at white space.
    """
    tokens, counts = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
    parts: list[str] = []
    owners: list[int] = []

    def finish() -> None:
        found, starts = line_tokens("\n".join(parts))
        ends = np.cumsum([len(x) + 1 for x in parts])
        np.add.at(counts, owners, np.diff(np.searchsorted(starts, ends), prepend=0))
        tokens.append(found)
        parts.clear()
        owners.clear()

    size = 0
    for i, text in enumerate(texts):
        text, start = (text or "").lower(), 0
        while start < len(text):
            space = SPACE(text, start + most)
            end = space.end() if space else len(text)
            parts.append(text[start:end])
            owners.append(i)
            size, start = size + end - start, end
            if size >= most:
                finish()
                size = 0
    if parts:
        finish()
    return np.concatenate(tokens), counts


def tokens_of(text: str | None) -> np.ndarray:
    """Hashes of a text's tokens."""
    return token_hashes([text])[0]


def tokenize(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, slice, doc_id, ids (hashes, little-endian 32-bit integers) of every text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), binaries(*token_hashes(part.column(1).to_pylist()))], names=["doc_id", "ids"])

    rows = map_rows(docs, [(id_col, "doc_id", "long"), (text_col, "text", "string")], run, "doc_id long, ids binary").withColumn("row", F.monotonically_increasing_id())
    return rows.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(16)).cast("int"))


def count_tokens(rows: DataFrame) -> DataFrame:
    """place, n over all texts; pre-added in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PLACES_ALL, np.int64)
        for texts in token_lists(batches, 0):
            total += np.bincount(np.concatenate(texts) % PLACES_ALL, minlength=PLACES_ALL)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["place", "n"])

    return rows.select("ids").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))


class Classes:
    """Class of each place, and the logarithm of its share of it; by the places' counts.

    The more frequent half of the classes has one place each; ties go by place. A place without
    a count counts as half an occurrence.
    """

    def __init__(self, counts: dict[int, int]):
        n = np.zeros(PLACES_ALL)
        n[list(counts)] = list(counts.values())
        rank = np.empty(PLACES_ALL, np.int64)
        rank[np.lexsort((np.arange(PLACES_ALL), -n))] = np.arange(PLACES_ALL)
        half = CLASSES // 2
        self.of = np.where(rank < half, rank, half + rank % half).astype(np.int32)
        n = np.maximum(n, 0.5)
        self.share = np.log(n / np.bincount(self.of, n, CLASSES)[self.of]).astype(np.float32)


class Network:
    """Weights of the window network."""

    SHAPES = {"embed": lambda h: (CLASSES + 1, h), "place": lambda h: (2 * REACH, h), "bias": lambda h: (h,), "coarse": lambda h: (h, GRID), "coarse_bias": lambda h: (GRID,), "fine": lambda h: (GRID, h, GRID), "fine_bias": lambda h: (GRID, GRID)}

    def __init__(self, flat: np.ndarray | None = None, hidden: int = 16, seed: int = 7):
        self.hidden, at = hidden, 0
        sizes = {name: int(np.prod(shape(hidden))) for name, shape in self.SHAPES.items()}
        if flat is None:
            r = np.random.default_rng(seed)
            spread = {"embed": 0.3, "coarse": 0.2, "fine": 0.2}
            flat = np.concatenate([r.normal(0, spread[x], n) if x in spread else np.full(n, float(x == "place")) for x, n in sizes.items()])
        self.flat = flat.astype(np.float32)
        for name, n in sizes.items():
            setattr(self, name, self.flat[at : at + n].reshape(self.SHAPES[name](hidden)))
            at += n

    def layer(self, contexts: np.ndarray) -> np.ndarray:
        total = (self.embed * self.place[0] + self.bias).take(contexts[:, 0], 0)
        one = np.empty_like(total)
        for k in range(1, 2 * REACH):
            total += np.take(self.embed * self.place[k], contexts[:, k], 0, out=one, mode="clip")  # else it is buffered
        return np.tanh(total, out=total)

    def groups(self, targets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Order of targets by row of classes, and each row's bounds in it."""
        rows = (targets // GRID).astype(np.uint8)
        order = np.argsort(rows, kind="stable")
        ends = np.cumsum(np.bincount(rows, minlength=GRID))
        return order, [(g, int(s), int(e)) for g, (s, e) in enumerate(zip([0, *ends[:-1]], ends)) if s < e]

    def forward(self, contexts: np.ndarray, targets: np.ndarray) -> tuple:
        """Order, bounds, hidden layer in that order, and for both softmaxes the target's logit, all exponentials and their sums."""
        order, bounds = self.groups(targets)
        hidden, at = self.layer(contexts.take(order, 0)), targets[order]
        fine = np.empty((len(targets), GRID), np.float32)
        for g, s, e in bounds:
            np.matmul(hidden[s:e], self.fine[g], out=fine[s:e])
            fine[s:e] += self.fine_bias[g]
        return order, bounds, hidden, exponentials(hidden @ self.coarse + self.coarse_bias, at // GRID), exponentials(fine, at % GRID)

    def log_prob(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Log-probability of each target class given its context."""
        out = np.empty(len(targets), np.float32)
        for start in range(0, len(targets), 1 << 13):
            order, _, _, (own, _, total), (own_fine, _, total_fine) = self.forward(contexts[start : start + (1 << 13)], targets[start : start + (1 << 13)])
            out[start + order] = own + own_fine - np.log(total * total_fine)
        return out

    def gradient(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Of the mean cross-entropy, as flat weights."""
        order, bounds, hidden, (_, coarse, total), (_, fine, total_fine) = self.forward(contexts, targets)
        contexts, targets, rows = contexts.take(order, 0), targets[order], np.arange(len(targets))
        out = Network(np.zeros_like(self.flat), self.hidden)
        coarse *= (1 / (total * len(rows)))[:, None]
        fine *= (1 / (total_fine * len(rows)))[:, None]
        coarse[rows, targets // GRID] -= 1 / len(rows)
        fine[rows, targets % GRID] -= 1 / len(rows)
        back = coarse @ self.coarse.T
        ones = np.ones(len(rows), np.float32)
        out.coarse[:], out.coarse_bias[:] = hidden.T @ coarse, ones @ coarse
        for g, s, e in bounds:
            back[s:e] += fine[s:e] @ self.fine[g].T
            out.fine[g], out.fine_bias[g] = hidden[s:e].T @ fine[s:e], ones[s:e] @ fine[s:e]
        hidden *= hidden
        back *= 1 - hidden
        out.bias[:] = ones @ back
        pairs = np.complex64 if self.hidden % 2 == 0 else np.float32  # two numbers are added at a time
        for k in range(2 * REACH):
            at = contexts[:, k].astype(np.uint16)
            by = np.argsort(at, kind="stable")
            ordered = at[by]
            starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            sums, which = np.add.reduceat(back.view(pairs).take(by, 0), starts, axis=0).view(np.float32), ordered[starts]
            out.place[k] = np.einsum("nh,nh->h", sums, self.embed[which])
            out.embed[which] += sums * self.place[k]
        return out.flat


def exponentials(logits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits at the targets, exponentials, and their sums; logits beyond 60 count as 60."""
    np.clip(logits, -60, 60, out=logits)
    own = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    return own, logits, logits @ np.ones(logits.shape[1], np.float32)


class Adam:
    def __init__(self, network: Network, rate: float):
        self.network, self.rate, self.steps = network, rate, 0
        self.first, self.second = np.zeros_like(network.flat), np.zeros_like(network.flat)

    def step(self, contexts: np.ndarray, targets: np.ndarray) -> None:
        self.steps += 1
        slope = self.network.gradient(contexts, targets)
        self.first += 0.1 * (slope - self.first)
        self.second += 0.01 * (slope * slope - self.second)
        rate = self.rate * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        self.network.flat -= rate * self.first / (np.sqrt(self.second) + 1e-8)


def windows(texts: list[np.ndarray], classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context classes (a column for each of PLACES), target class and place of every token of the texts."""
    gap = np.full(REACH, BEYOND, np.int32)
    line = np.concatenate([gap, *(x for t in texts for x in (classes.of[t % PLACES_ALL], gap))])
    lengths = np.array([len(t) for t in texts])
    at = np.arange(lengths.sum()) + np.repeat(REACH * np.arange(1, len(texts) + 1), lengths)
    return np.stack([line[at + k] for k in PLACES], axis=1), line[at], np.concatenate(texts) % PLACES_ALL if texts else np.zeros(0, np.uint32)


def token_lists(batches: Iterator[pa.RecordBatch], column: int, most: int = 200_000) -> Iterator[list[np.ndarray]]:
    """Texts' tokens, some texts at a time; a text with more than ``most`` tokens comes alone."""
    held, size = [], 0
    for batch in batches:
        for ids in batch.column(column).to_pylist():
            if held and size + len(ids) // 4 > most:
                yield held
                held, size = [], 0
            held.append(np.frombuffer(ids, np.uint32))
            size += len(ids) // 4
    if held:
        yield held


@functools.cache
def keep_memory() -> None:
    """The C library raises its bounds to the largest block freed; below them memory isn't given back and cleared again at every step."""
    np.ones(31 << 20, np.uint8)


def train(rows: DataFrame, classes: Classes, batch: int = 8192) -> Network:
    """A network that has been fitted to every window of rows (slice, ids) once.

    An empty table leaves the initial weights.
    """
    flat = Network().flat
    for turn, rate in enumerate(RATES):
        low, high = ROUNDS[turn], [*ROUNDS[1:], 16][turn]
        model = pickle.dumps((flat, classes))

        def run(batches: Iterator[pa.RecordBatch], model: bytes = model, rate: float = rate) -> Iterator[pa.RecordBatch]:
            start, own = pickle.loads(model)
            network, n = Network(start.copy()), 0
            keep_memory()
            adam = Adam(network, rate)
            for texts in token_lists(batches, 0):
                contexts, targets, _ = windows(texts, own)
                mix = np.random.default_rng(n).permutation(len(targets))
                steps = -(-len(targets) // batch)
                for part in np.array_split(mix, steps) if steps else ():
                    adam.step(contexts.take(part, 0), targets[part])
                n += len(targets)
            if n:
                context = TaskContext.get()
                parts = np.array_split(network.flat, range(BLOCK, len(network.flat), BLOCK))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(parts)), pa.int32()), pa.array([context.partitionId() if context else 0] * len(parts), pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
                    names=["block", "shard", "n", "weights"],
                )

        trained = rows.filter((F.col("slice") >= low) & (F.col("slice") < high)).select("ids").mapInArrow(run, "block int, shard int, n long, weights binary")
        means = dict(trained.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(averaged, "block int, weights binary").collect())
        if means:
            flat = np.concatenate([np.frombuffer(means[b], np.float32) for b in sorted(means)])
    return Network(flat)


def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block and its mean weights, by the tokens they were trained on; one block is held at a time."""
    block, total, n = None, None, 0
    out: list[tuple[int, bytes]] = []
    for batch in batches:
        for b, k, w in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if b != block:
                if block is not None:
                    out.append((block, (total / n).astype(np.float32).tobytes()))
                block, total, n = b, 0.0, 0
            total, n = total + k * np.frombuffer(w, np.float32).astype(np.float64), n + k
    if block is not None:
        out.append((block, (total / n).astype(np.float32).tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([w for _, w in out], pa.binary())], names=["block", "weights"])


def remainders(tokens: np.ndarray) -> np.ndarray:
    """Of the contexts' keys by EVERY, for each token but the outer NEAR."""
    end = len(tokens) - NEAR
    total = np.zeros(end - NEAR, np.uint32)
    for k, factor in FACTORS.items():
        total += tokens[NEAR + k : end + k] * factor
    return total >> np.uint32(32 - EVERY.bit_length() + 1)


def context_keys(tokens: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of the NEAR tokens on either side, for each token but the outer NEAR of a text, or for those at some places."""
    every, key = remainders(tokens), np.uint64(0)
    at, every = (np.arange(NEAR, len(tokens) - NEAR), every) if at is None else (at, every[at - NEAR])
    for k in FACTORS:
        key = mixed(key + tokens[at + k].astype(np.uint64) + np.uint64(1))
    return key & ~np.uint64(EVERY - 1) | every.astype(np.uint64)


def places_asked(tokens: np.ndarray, lengths: np.ndarray, turn: int, block: int = 1 << 14, keyed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text's number, place and (if keyed) key of what is asked in a round, in texts that lie one after the other.

    Contexts are hashed along all texts, a block at a time; those that reach over an end are left out.
    """
    texts, places, keys = ([np.zeros(0, kind)] for kind in (np.uint32, np.int64, np.uint64))
    ends = np.cumsum(lengths, dtype=np.int64)
    starts, number = ends - lengths, np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths)
    for start in range(0, len(tokens) - 2 * NEAR, block):
        own = tokens[start : start + block + 2 * NEAR]
        at = np.flatnonzero(remainders(own) // TOGETHER == turn) + NEAR
        text = number[start + at]
        inner = (start + at - starts[text] >= NEAR) & (ends[text] - start - at > NEAR)
        at = at[inner]
        texts.append(text[inner])
        places.append(start + at)
        if keyed:
            keys.append(context_keys(own, at))
    return np.concatenate(texts), np.concatenate(places), np.concatenate(keys)


def binaries(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A column of binaries, of so many of the values each."""
    ends = np.append(0, np.cumsum(lengths)) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def by_round(tokens: np.ndarray, lengths: np.ndarray, logs: np.ndarray) -> list[pa.Array]:
    """For each round of the memory, the logs of each text's places that are asked in it."""
    found = [places_asked(tokens, lengths, turn, keyed=False)[:2] for turn in range(EVERY // TOGETHER)]
    return [binaries(logs[at], np.bincount(text, minlength=len(lengths))) for text, at in found]


@functools.lru_cache(maxsize=2)
def scorer(model: bytes) -> tuple[Network, Classes]:
    flat, classes = pickle.loads(model)
    return Network(flat), classes


def score_texts(rows: DataFrame, classes: Classes, network: Network) -> DataFrame:
    """row, doc_id, n_tokens, network (summed log-probability), ids and the logs of the memory's rounds (32-bit floats)."""
    model = pickle.dumps((network.flat, classes))
    rounds = [f"logs{i}" for i in range(EVERY // TOGETHER)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kinds = scorer(model)
        keep_memory()
        for batch in batches:
            done = 0
            for texts in token_lists(iter([batch]), 2, 100_000):
                contexts, targets, places = windows(texts, kinds)
                logs = (own.log_prob(contexts, targets) + kinds.share[places]).astype("<f4")
                lengths = np.array([len(t) for t in texts])
                each = np.split(logs, np.cumsum(lengths)[:-1])
                part = batch.slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(lengths, pa.int64()), pa.array([float(x.sum(dtype=np.float64)) for x in each], pa.float64()), part.column(2), *by_round(np.concatenate(texts), lengths, logs)],
                    names=["row", "doc_id", "n_tokens", "network", "ids", *rounds],
                )

    return rows.select("row", "doc_id", "ids").mapInArrow(run, "row long, doc_id long, n_tokens long, network double, ids binary, " + ", ".join(f"{x} binary" for x in rounds))


def flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a column of binaries one after the other, and how many each has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2]
    return np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind), np.diff(offsets) // np.dtype(kind).itemsize


def asked_in(ids: pa.Array, logs: pa.Array, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text's number, key, token and log of the places that are asked in a round. logs: that round's."""
    tokens, lengths = flat(ids, "<u4")
    text, at, key = places_asked(tokens, lengths, turn)
    return text, key, tokens[at], flat(logs, "<f4")[0]


def asked_at(scored: DataFrame, remainder: int) -> DataFrame:
    """row, doc_id, n_tokens, network and keys, tokens, logs of the places whose context's hash has that remainder by EVERY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = asked_in(batch.column(4), batch.column(5), remainder // TOGETHER)
            own = found[1] % np.uint64(EVERY) == remainder
            text, key, token, log = (x[own] for x in found)
            ends = pa.array(np.append(0, np.cumsum(np.bincount(text, minlength=batch.num_rows))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (key.view(np.int64), token.view(np.int32), log)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *lists], names=["row", "doc_id", "n_tokens", "network", "keys", "tokens", "logs"])

    return scored.select("row", "doc_id", "n_tokens", "network", "ids", f"logs{remainder // TOGETHER}").mapInArrow(run, "row long, doc_id long, n_tokens long, network double, keys array<long>, tokens array<int>, logs array<float>")


def score_windows(rows: DataFrame, classes: Classes, network: Network, remainder: int = 0) -> DataFrame:
    """row, doc_id, n_tokens, network (summed log-probability) and, for one round of the memory, keys, tokens, logs."""
    return asked_at(score_texts(rows, classes, network), remainder)


def packed(rows: list[tuple], kinds: str) -> pa.RecordBatch:
    """Rows of PACKED, or of another such schema; arrays become their bytes."""
    names = [x.split()[0] for x in kinds.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = [[x.tobytes() if isinstance(x, np.ndarray) else x for x in column] for column in zip(*rows)]
    return pa.RecordBatch.from_arrays([pa.array(c, types[k.split()[1]]) for c, k in zip(columns, kinds.split(", "), strict=True)], names=names)


def spread(scored: DataFrame, buckets: int, turn: int | None = None) -> DataFrame:
    """PACKED rows: the places where the memory is asked, cut into chunks, a chunk's places by range of their keys.

    scored has keys, tokens, logs, or, for a round, ids and its logs. MEMBER: keys, tokens, logs
    and numbers of texts of a chunk's places in a bucket. A context that HOT places of a chunk have
    is hot there: COUNT has key, token and number of the chunk's entries from ``first`` on, and its
    places, which needn't meet in one task, stay with the chunk, by entry. HELD: the chunk's rows,
    and entries, logs and numbers of texts of those places.
    """

    def chunk_rows(chunk: int, rows: np.ndarray, text: np.ndarray, key: np.ndarray, token: np.ndarray, log: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(key)
        key, token, log, text = key[order], token[order], log[order], text[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        hot = np.diff(np.append(starts, len(key))) >= HOT
        hot = np.repeat(hot, np.diff(np.append(starts, len(key))))
        entries, logs, texts = (np.zeros(0, x) for x in ("<u4", "<f4", "<u4"))
        edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
        if hot.any():
            k, t, logs, texts = key[hot], token[hot], log[hot], text[hot]
            order = np.lexsort((t, k))
            k, t, logs, texts = k[order], t[order], logs[order], texts[order]
            new = np.append(True, (k[1:] != k[:-1]) | (t[1:] != t[:-1]))
            first = np.flatnonzero(new)
            entries, n = (np.cumsum(new) - 1).astype("<u4"), np.diff(np.append(first, len(k)))
            k, t = k[first], t[first]
            bounds = [0, *np.searchsorted(k, edges).tolist(), len(k)]
            for bucket, (s, e) in enumerate(zip(bounds, bounds[1:])):
                if s < e:
                    yield packed([(COUNT, bucket, chunk, s, k[s:e], t[s:e], n[s:e].astype("<i8"), None)], PACKED)
            key, token, log, text = key[~hot], token[~hot], log[~hot], text[~hot]
        bounds = [0, *np.searchsorted(key, edges).tolist(), len(key)]
        for bucket, (s, e) in enumerate(zip(bounds, bounds[1:])):
            if s < e:
                yield packed([(MEMBER, bucket, chunk, 0, key[s:e], token[s:e], log[s:e], text[s:e])], PACKED)
        yield packed([(HELD, chunk % buckets, chunk, 0, rows, entries, logs, texts)], PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        chunk = (context.partitionId() if context else 0) << 32
        held: list[tuple] = []
        n_texts = n_places = 0
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            if turn is None:
                text = np.repeat(np.arange(len(rows), dtype=np.uint32), np.array(batch.column(1).value_lengths().to_pylist(), np.int64))
                key, token, log = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                key, token = key.view(np.uint64), token.view(np.uint32)
            else:
                text, key, token, log = asked_in(batch.column(1), batch.column(2), turn)
            held.append((rows, text + np.uint32(n_texts), key, token, log))
            n_texts, n_places = n_texts + len(rows), n_places + len(key)
            if n_places >= CHUNK:
                yield from chunk_rows(chunk, *(np.concatenate(x) for x in zip(*held)))
                held, n_texts, n_places, chunk = [], 0, 0, chunk + 1
        if n_places:
            yield from chunk_rows(chunk, *(np.concatenate(x) for x in zip(*held)))

    columns = ["row", "keys", "tokens", "logs"] if turn is None else ["row", "ids", f"logs{turn}"]
    return scored.select(*columns).mapInArrow(run, PACKED)


def count_contexts(rows: DataFrame, buckets: int) -> DataFrame:
    """ANSWERS: what the rows of ``spread`` come to, for their chunks.

    MEMBER: numbers of texts and gains of the places whose context occurs elsewhere. COUNT: for the
    chunk's entries from ``first`` on, a token's and its context's occurrences in the corpus, and
    the context's kinds of tokens. HELD rows pass through. A bucket is held at a time, in which a
    hot context has one entry for each chunk and token.
    """

    def finished(blobs: list[tuple]) -> Iterator[pa.RecordBatch]:
        sizes = [len(x[3]) // 8 for x in blobs]
        joined = lambda i, kind: np.concatenate([np.frombuffer(x[i], kind) for x in blobs])
        key, token = joined(3, "<u8"), joined(4, "<u4")
        n = np.concatenate([np.frombuffer(x[5], "<i8") if x[0] == COUNT else np.ones(k, np.int64) for x, k in zip(blobs, sizes)])
        log = np.concatenate([np.zeros(k, "<f4") if x[0] == COUNT else np.frombuffer(x[5], "<f4") for x, k in zip(blobs, sizes)])
        order = np.argsort(key)
        ordered = key[order]
        starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        total = np.add.reduceat(n[order], starts)
        lengths = np.diff(np.append(starts, len(key)))
        several = total > 1
        order = order[np.repeat(several, lengths)]  # the places of contexts that occur elsewhere
        total, lengths = total[several], lengths[several]
        group = np.repeat(np.arange(len(total), dtype=np.uint64), lengths) << np.uint64(32) | token[order]
        by = np.argsort(group)
        group, order = group[by], order[by]
        new = np.append(True, group[1:] != group[:-1])[: len(group)]
        first = np.flatnonzero(new)
        context = (group >> np.uint64(32)).astype(np.int64)
        kinds = np.bincount(context[first], minlength=len(total))[context]
        each = np.add.reduceat(n[order], first)[np.cumsum(new) - 1] if len(first) else np.zeros(0, np.int64)
        total = total[context]
        # Back in the order of the blobs.
        place = np.full(len(key), -1)
        place[order] = np.arange(len(order))
        logs = log[order].astype(np.float64)
        gain = gains(each, total, kinds, logs).astype("<f4")
        ends = np.cumsum(sizes)
        for (kind, chunk, first_entry, _, _, _, text), s, e in zip(blobs, ends - sizes, ends):
            at = place[s:e]
            if kind == COUNT:
                yield packed([(COUNT, chunk, first_entry, each[at], total[at], kinds[at].astype("<i8"), None)], ANSWERS)
            elif len(own := np.flatnonzero(at >= 0)):
                yield packed([(MEMBER, chunk, 0, np.frombuffer(text, "<u4")[own], gain[at[own]], None, None)], ANSWERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for kind, at, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == HELD:
                    yield packed([(kind, *rest)], ANSWERS)
                    continue
                if held and at != bucket:
                    yield from finished(held)
                    held = []
                bucket = at
                held.append((kind, *rest))
        if held:
            yield from finished(held)

    return rows.repartition(buckets, "at").sortWithinPartitions("at").mapInArrow(run, ANSWERS)


def gains(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, log: np.ndarray) -> np.ndarray:
    """What the corpus adds to a place's log-probability: its token's and context's occurrences but this one, and the network's as so many as the context has kinds."""
    return np.log((n - 1 + kinds * np.exp(log)) / (total - 1 + kinds)) - log


def gains_of(found: DataFrame, buckets: int) -> DataFrame:
    """row, gain from what ``count_contexts`` gives; a chunk is held at a time."""

    def finished(blobs: list[tuple]) -> pa.RecordBatch:
        rows, entries, logs, texts = next((np.frombuffer(x, kind) for x, kind in zip(b[3:], ("<i8", "<u4", "<f4", "<u4"))) for b in blobs if b[0] == HELD)
        gain = np.zeros(len(rows))
        n_entries = int(entries[-1]) + 1 if len(entries) else 0
        n, total, kinds = (np.zeros(n_entries, np.int64) for _ in range(3))
        for kind, _, first, *a in blobs:
            if kind == MEMBER:
                gain += np.bincount(np.frombuffer(a[0], "<u4"), np.frombuffer(a[1], "<f4"), len(rows))
            elif kind == COUNT:
                for out, x in zip((n, total, kinds), a):
                    out[first : first + len(x) // 8] = np.frombuffer(x, "<i8")
        if n_entries:
            gain += np.bincount(texts, gains(n[entries], total[entries], kinds[entries], logs.astype(np.float64)), len(rows))
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(gain)], names=["row", "gain"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and blob[1] != held[-1][1]:
                    yield finished(held)
                    held = []
                held.append(blob)
        if held:
            yield finished(held)

    return found.repartition(buckets, "chunk").sortWithinPartitions("chunk").mapInArrow(run, "row long, gain double")


def round_of(scored: DataFrame, n_places: int, scratch: Scratch, turn: int | None = None) -> DataFrame:
    """row, gain of one round of the memory, kept; n_places: about as many places are asked."""
    buckets = max(1, -(-n_places // BUCKET))
    with small_batches(scored.sparkSession):
        return scratch.keep(gains_of(count_contexts(spread(scored, buckets, turn), buckets), buckets))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows reach Python some BATCH at a time, as they may have many tokens each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remembered(scored: DataFrame, scratch: Scratch) -> DataFrame:
    """row, gain: what the rest of the corpus adds to a text's log-probability, where it has the same contexts.

    A context that occurs once in the corpus adds nothing. scored: a round's keys, tokens, logs.
    """
    return round_of(scored, scored.agg(F.sum(F.size("keys"))).first()[0] or 0, scratch)


def remembered_everywhere(scored: DataFrame, scratch: Scratch) -> DataFrame:
    """``remembered`` over all rounds; scored is kept and has each token."""
    n_places = (scored.agg(F.sum("n_tokens")).first()[0] or 0) * TOGETHER // EVERY
    out = None
    for turn in range(EVERY // TOGETHER):
        gain = round_of(scored, n_places, scratch, turn)
        out = gain if out is None else out.unionByName(gain)
    return out.groupBy("row").agg(F.sum("gain").alias("gain"))


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from every text of docs and scores them all.

    Returns doc_id, n_tokens, log_prob (summed, with the memory), mean_log_prob, network_log_prob
    (without), gain (the difference) and mean_gain. A null or empty text has no tokens, log_prob 0
    and null means. A text may have any length; it is scored whole. Repeated rows are scored one by
    one, and remember each other; null ids stay null, ties don't arise, an empty table gives an
    empty one, other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "scoring")
    rows = scratch.keep(tokenize(docs, id_col, text_col), compression="zstd")
    classes = Classes(dict(count_tokens(rows).collect()))
    scored = scratch.keep(score_texts(rows, classes, train(rows, classes)), compression="zstd")
    scratch.drop(rows)
    out = scored.select("row", "doc_id", "n_tokens", "network").join(remembered_everywhere(scored, scratch), "row", "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    total, n = F.col("network") + F.col("gain"), F.nullif("n_tokens", F.lit(0))
    return out.select("doc_id", "n_tokens", total.alias("log_prob"), (total / n).alias("mean_log_prob"), F.col("network").alias("network_log_prob"), "gain", (F.col("gain") / n).alias("mean_gain"))
