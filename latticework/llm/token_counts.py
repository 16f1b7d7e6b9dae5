"""Token counts by the whole-token shortcut.

Which vocabulary strings are a token of their own is proved once for a vocabulary, with the
library itself: a string qualifies if it is exactly one pre-token and encodes alone to exactly
one id. A text is cut into pre-tokens; those that qualify count one each without any merging,
and only the rest goes through the library's merges, each distinct pre-token once for as long as
a bounded memo holds it. Pre-tokens are merged independently of each other, so the sum is exact.

Texts with code points outside the range where the pre-token patterns provably agree, or with
the string of an added token, go to the library whole.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from latticework.llm.arrow import LETTERS, NUMBERS, PLAIN, Memo, chunks, map_rows

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

#: The byte-level pre-token pattern, over plain code points.
PRE_TOKEN = rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WholeTokenCounter:
    """Counts of one vocabulary file; built once per Python worker."""

    def __init__(self, vocab_path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocab_path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.find = re.compile(PRE_TOKEN).findall
        self.odd = re.compile(f"[^{PLAIN}]").search
        self.memo = Memo(self.merge, dict.fromkeys(self.prove(), 1))

    def prove(self) -> list[str]:
        """Vocabulary strings that are one pre-token and one token when encoded alone."""
        alphabet, found = byte_alphabet(), []
        for piece in self.library.get_vocab(with_added_tokens=False):
            try:
                text = bytes(alphabet[c] for c in piece).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if not self.odd(text) and self.find(text) == [text]:
                found.append(text)
        return [s for s, n in zip(found, self.merge(found), strict=True) if n == 1]

    def merge(self, pre_tokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(pre_tokens, add_special_tokens=False)]

    def whole(self, text: str) -> bool:
        """Whether the text must go to the library as a whole."""
        return self.odd(text) is not None or any(a in text for a in self.added)

    def counts(self, texts: list[str]) -> list[int]:
        cut = [None if self.whole(t) else self.find(t) for t in texts]
        known = self.memo.need(set().union(*(c for c in cut if c)))
        return [self.merge([t])[0] if c is None else sum(map(known.__getitem__, c)) for t, c in zip(texts, cut, strict=True)]


@functools.lru_cache(maxsize=4)
def counter(vocab_path: str) -> WholeTokenCounter:
    return WholeTokenCounter(vocab_path)


def count_tokens(
    docs: DataFrame, vocab_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    No begin, end or added special tokens; special strings inside a text as the library takes
    them by default. A null or empty text has 0 bytes and 0 tokens; a null id stays null;
    repeated rows are counted one by one; an empty table gives an empty one; other columns are
    not read. Map-only: no shuffle, memory bounded by a slice of a batch and the memo.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocab_path)
        for batch in batches:
            for part in chunks(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = own.counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([x > limit for x in n], pa.bool_()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return map_rows(docs, [(id_col, "doc_id", "long"), (text_col, "text", "string")], run, SCHEMA)
