"""Packing token ids into training sequences by Karmarkar-Karp differencing.

Documents are tokenised once, in the task that reads them. A document's whole windows become
sequences of their own; remainders gather in a bucket of a bounded number of tokens, and a full
bucket is packed at once: multiway differencing merges the two partial partitions with the
largest imbalances, largest window against smallest, until one partition is left, whose windows
are nearly equal. The window count starts at the least that can hold the tokens and rises when a
window exceeds the capacity, as long as the padding stays within ``slack``; what still exceeds it
then is cut off and moved to windows with room. Where a bucket is so small that its padding is
above ``slack`` nevertheless, the emptiest windows are poured into the others, and the last one
is cut into powers of two, which need no padding.

There is no shuffle: a task's memory is a bucket, a long document adds sequences and not rows to
any group, and a lost task is computed again from its own input rows.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from latticework.llm.arrow import Memo, chunks, map_rows

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Code points whose classes and lower case agree in Python and the library, up to U+017F.
PLAIN = "\t\n\r\x20-\x7e\xa0-įı-ſ"
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBERS = "0-9²³¹¼½¾"
#: The pre-token pattern of the word vocabulary, over plain code points.
PRE_TOKEN = rf"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+"

#: What the vocabulary's pieces have at the end of a word.
END = "</w>"
TOGETHER = 512  # pre-tokens that the library encodes as one text


class WordIds:
    """Token ids of whole texts as little-endian 32-bit integers; built once per Python worker.

    Pre-tokens merge independently, so each distinct one is encoded once and then looked up.
    Texts beyond plain code points, or with an added token's string, go to the library whole.
    """

    def __init__(self, vocab_path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocab_path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.find = re.compile(PRE_TOKEN).findall
        self.odd = re.compile(f"[^{PLAIN}]").search
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max([0, *self.library.get_vocab().values()]) + 1, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith(END)]] = True
        self.memo = Memo(self.encode_words, cap=300_000)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, found: list[str]) -> list[bytes]:
        """``encode`` of pre-tokens, many in one text: spaces part them, and the last id of each is one that ends a word.

        Should a text have another number of ends, its pre-tokens are encoded one by one.
        """
        out: list[bytes] = []
        for start in range(0, len(found), TOGETHER):
            part = found[start : start + TOGETHER]
            (raw,) = self.encode([" ".join(part)])
            stops = (4 * np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 4).tolist()
            whole = len(stops) == len(part) and stops[-1] == len(raw)
            out += [raw[a:b] for a, b in zip([0, *stops], stops)] if whole else self.encode(part)
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        cut = [None if self.odd(t) or any(a in t for a in self.added) else self.find(t.lower()) for t in texts]
        known = self.memo.need(set().union(*(c for c in cut if c)))
        return [self.encode([t])[0] if c is None else b"".join(map(known.__getitem__, c)) for t, c in zip(texts, cut, strict=True)]


@functools.lru_cache(maxsize=4)
def words(vocab_path: str) -> WordIds:
    return WordIds(vocab_path)


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Item numbers of k windows with nearly equal sums, by the largest differencing method.

    A partial partition lists its windows that have items, by rising sum; the others count as
    zero. Merging b into a gives b's largest windows a's empty ones, and pairs b's others, falling,
    with a's, rising; the windows of a beyond stay as they are, so a small b costs little.
    """
    fresh = iter(range(len(sizes), 1 << 62))
    heap = [(-s, i, [(s, i, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap)[2]
        b = heap[0][2]
        if len(a) < len(b):
            a, b = b, a
        alone = max(0, len(b) - (k - len(a)))
        new = b[alone:] + [(x[0] + y[0], next(fresh), (x[2], y[2])) for x, y in zip(a, reversed(b[:alone]))]
        merged = a[alone:]
        if len(new) > 16:
            merged += new
            merged.sort()
        else:
            for entry in new:
                bisect.insort(merged, entry)
        least = merged[0][0] if len(merged) == k else 0
        heapq.heapreplace(heap, (least - merged[-1][0], next(fresh), merged))

    def items(tree: object) -> list[int]:
        out, stack = [], [tree]
        while stack:
            x = stack.pop()
            stack.extend(x) if isinstance(x, tuple) else out.append(x)
        return sorted(out)

    full = [items(tree) for _, _, tree in heap[0][2]] if heap else []
    return full + [[] for _ in range(k - len(full))]


def pack(sizes: list[int], capacity: int = 4096, slack: float = 0.005) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start in item, length); every sum at most the capacity.

    Sizes are positive. Ties keep item order. No items give no sequences.
    """
    total = sum(sizes)
    if not total:
        return []
    count = -(-total // capacity)
    most = max(count, int(total * (1 + slack) // capacity))
    bins: list[list[int]] = []
    while True:
        bins = differencing(sizes, count)
        if count == most or max(sum(sizes[i] for i in b) for b in bins) <= capacity:
            break
        count = most if count + 1 >= most - 1 else count + (most - count) // 2
    windows = [[(i, 0, sizes[i]) for i in b] for b in bins]
    held = [sum(sizes[i] for i in b) for b in bins]

    def move(source: int, target: int, n: int) -> None:
        """n tokens from the end of one window to another, cutting one piece at most."""
        held[source] -= n
        held[target] += n
        while n:
            i, start, length = windows[source].pop()
            part = min(n, length)
            if part < length:
                windows[source].append((i, start, length - part))
            windows[target].append((i, start + length - part, part))
            n -= part

    roomy = [w for w in range(count) if held[w] < capacity]
    for w in range(count):
        while held[w] > capacity:
            if held[roomy[-1]] >= capacity:
                roomy.pop()
                continue
            move(w, roomy[-1], min(held[w] - capacity, capacity - held[roomy[-1]]))
    if count * capacity - total > slack * total:
        by_fill = sorted(range(count), key=lambda w: -held[w])
        full, empty = 0, count - 1
        while full < empty:
            if held[by_fill[full]] == capacity:
                full += 1
            elif not held[by_fill[empty]]:
                empty -= 1
            else:
                move(by_fill[empty], by_fill[full], min(held[by_fill[empty]], capacity - held[by_fill[full]]))
        last = by_fill[full]
        if held[last] < capacity:
            left = held[last]
            while left & (left - 1):
                bit = left & -left
                windows.append([])
                held.append(0)
                move(last, len(windows) - 1, bit)
                left -= bit
    return [w for w in windows if w]


def pack_documents(
    docs: DataFrame,
    vocab_path: str,
    capacity: int = 4096,
    end_id: int = 2,
    bucket_tokens: int = 1 << 21,
    slack: float = 0.005,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's, without special tokens, then ``end_id``; a null or empty
    text is ``end_id`` alone. Every id lies in exactly one piece; a sequence holds at most
    ``capacity`` ids, offsets are gapless from 0. Sequence ids are unique over the table.
    ``with_ids`` adds the piece's ids as little-endian 32-bit integers. Repeated rows are packed
    one by one, null ids stay null, an empty table gives an empty one, other columns are not read.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")] + ["ids"] * with_ids
    types = [pa.int64()] * 7 + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = words(vocab_path), array("I", [end_id]).tobytes()
        sequence = TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []  # doc_id, ids, first id's place in the document, document's tokens
        gathered = 0
        rows: list[tuple] = []

        def piece(doc: int | None, ids: bytes, base: int, tokens: int, start: int, length: int, offset: int) -> None:
            cut = ids[4 * start : 4 * (start + length)]
            rows.append((doc, base + start, length, zlib.crc32(cut), tokens, sequence, offset) + ((cut,) if with_ids else ()))

        def flush() -> None:
            nonlocal sequence, gathered
            for window in pack([len(x[1]) // 4 for x in waiting], capacity, slack):
                offset = 0
                for i, start, length in sorted(window):
                    piece(*waiting[i], start, length, offset)
                    offset += length
                sequence += 1
            waiting.clear()
            gathered = 0

        def drain() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)
            rows.clear()
            return out

        for batch in batches:
            for part in chunks(batch):
                for doc, ids in zip(part.column(0).to_pylist(), own.ids([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n - capacity + 1, capacity):
                        piece(doc, ids, 0, n, start, capacity, 0)
                        sequence += 1
                    if rest := n % capacity:
                        waiting.append((doc, ids[4 * (n - rest) :], n - rest, n))
                        gathered += rest
                    if gathered >= bucket_tokens:
                        flush()
                if rows:
                    yield drain()
        flush()
        if rows:
            yield drain()

    return map_rows(docs, [(id_col, "doc_id", "long"), (text_col, "text", "string")], run, SCHEMA + ", ids binary" * with_ids)
