"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes its space-marked form and is cut where no vocabulary piece spans the cut: no
merge can ever join symbols across such a place, so the parts encode independently. Which cuts
hold is proved from the vocabulary when it is loaded. Inside a part an agenda ordered by score,
then by position, holds the adjacent symbol pairs whose concatenation is a piece; the best pair
is merged, its new neighbours enter the agenda, and stale entries are skipped. Symbols that are
no piece in the end fall back to their bytes. In each Arrow batch every part that is met for the
first time is encoded and decoded by the sentencepiece library too, and so is one whole text of
each slice; any difference raises an error.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from latticework.llm.arrow import Memo, chunks, map_rows

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values: piece types


class PieceCodec:
    """Encoder and decoder of one model file; built once per Python worker."""

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if spec.model_type != 2 or not spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("only merge-type models with byte fallback and no normalisation")
        if not norm.add_dummy_prefix or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only models with a prefix mark and no user-defined pieces")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        places = {x: i for i, x in enumerate(sorted({-p.score for p in model.pieces if p.type == NORMAL}))}
        self.rank = {p.piece: places[-p.score] for p in model.pieces if p.type == NORMAL}
        self.surface = [p.piece if p.type == NORMAL else "" for p in model.pieces]
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.find = re.compile(self.cuts()).findall
        self.memo = Memo(self.parts, cap=400_000)

    def cuts(self) -> str:
        """The pattern of the parts: cuts at word marks and, if the vocabulary allows, around letter runs."""
        inside = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}
        if any(b == MARK and a != MARK for a, b in inside):
            return "(?s).+"
        letter = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]").match
        if any(bool(letter(a)) != bool(letter(b)) and a != MARK for a, b in inside):
            return f"(?s){MARK}*[^{MARK}]+|{MARK}+"
        letters = "A-Za-zÀ-ÖØ-öø-ɏ"
        return f"(?s){MARK}*[{letters}]+|{MARK}*[^{letters}{MARK}]+|{MARK}+"

    def agenda(self, part: str) -> list[int]:
        """Ids of one part, by merging the best-scored adjacent pair until none is a piece.

        An agenda entry is one integer: the pair's score rank above its left symbol's position.
        """
        known, rank = self.ids, self.rank
        symbols: list = list(part)
        n = len(symbols)
        left_of = symbols[0]
        heap = []
        for i in range(1, n):
            right = symbols[i]
            r = rank.get(left_of + right)
            if r is not None:
                heap.append(r << 32 | i - 1)
            left_of = right
        if heap:
            before, after = list(range(-1, n - 1)), list(range(1, n + 1))
            heapq.heapify(heap)
            pop, push = heapq.heappop, heapq.heappush
            while heap:
                top = pop(heap)
                i = top & 0xFFFFFFFF
                left, j = symbols[i], after[i]
                if left is None or j >= n:
                    continue
                piece = left + symbols[j]
                if rank.get(piece) != top >> 32:
                    continue  # one side was merged elsewhere meanwhile
                symbols[i], symbols[j] = piece, None
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    r = rank.get(piece + symbols[k])
                    if r is not None:
                        push(heap, r << 32 | i)
                h = before[i]
                if h >= 0:
                    r = rank.get(symbols[h] + piece)
                    if r is not None:
                        push(heap, r << 32 | h)
        out: list[int] = []
        for s in symbols:
            if s is not None:
                i = known.get(s)
                if i is None:
                    out += [self.byte_id[b] for b in s.encode()]
                else:
                    out.append(i)
        return out

    def surface_of(self, ids: list[int]) -> str:
        """The text of ids: pieces, with runs of byte pieces read as UTF-8, marks as spaces."""
        if self.id_byte.keys().isdisjoint(ids):
            return "".join([self.surface[i] for i in ids]).replace(MARK, " ")
        raw = b"".join(bytes([self.id_byte[i]]) if i in self.id_byte else self.surface[i].encode() for i in ids)
        return raw.decode(errors="replace").replace(MARK, " ")

    def parts(self, missing: list[str]) -> list[tuple[bytes, str]]:
        """For each part: its ids as little-endian 32-bit integers, and its decoded text."""
        ids = [self.agenda(p) for p in missing]
        found = [(array("I", x).tobytes(), self.surface_of(x)) for x in ids]
        # The library puts its prefix mark before a text; a leading newline keeps the part apart from it.
        lead = self.library.encode("\n")
        whole = self.library.encode(["\n" + p.replace(MARK, " ") for p in missing], num_threads=1)
        for p, own, (_, text), theirs, decoded in zip(missing, ids, found, whole, self.library.decode(whole, num_threads=1), strict=True):
            if theirs != lead + own or decoded != "\n" + text:
                raise ValueError(f"encoding differs from the library's for {p!r}")
        return found

    def compare(self, text: str, ids: bytes, decoded: str) -> None:
        """ValueError if a whole text's ids, begin and end included, or their decoded text differ from the library's."""
        theirs = self.library.encode(text, add_bos=True, add_eos=True)
        if array("I", theirs).tobytes() != ids or self.library.decode(theirs) != decoded:
            raise ValueError(f"encoding differs from the library's for {text[:200]!r}")

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text: ids with begin and end as bytes, and what those ids decode to."""
        cut = [self.find(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self.memo.need(set().union(*cut))
        first, last = array("I", [self.bos]).tobytes(), array("I", [self.eos]).tobytes()
        out = []
        for parts in cut:
            got = [known[p] for p in parts]
            text = "".join([x[1] for x in got])
            out.append((b"".join([first, *[x[0] for x in got], last]), text[1:] if text[:1] == " " else text))
        if texts:
            self.compare(texts[0], *out[0])
        return out


@functools.lru_cache(maxsize=4)
def codec(model_path: str) -> PieceCodec:
    return PieceCodec(model_path)


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and round trip of every whole text.

    Returns doc_id, n_tokens (begin and end included), ids (binary, little-endian 32-bit),
    decoded (the text that the ids decode to). A null text counts as empty: begin and end only,
    decoded to the empty text; a text of any length is encoded whole. Null ids stay null, repeated
    rows are encoded one by one, an empty table gives an empty one, other columns are not read. Of
    pairs with equal scores the first in the text is merged. Map-only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for part in chunks(batch):
                got = own.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(i) // 4 for i, _ in got], pa.int64()), pa.array([i for i, _ in got], pa.binary()), pa.array([d for _, d in got], pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return map_rows(docs, [(id_col, "doc_id", "long"), (text_col, "text", "string")], run, "doc_id long, n_tokens long, ids binary, decoded string")


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_pieces, with SHA-256 digests in place of ids and decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for part in chunks(batch):
                got = own.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(i) // 4 for i, _ in got], pa.int64()), pa.array([digest(i) for i, _ in got], pa.string()), pa.array([digest(d.encode()) for _, d in got], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return map_rows(docs, [(id_col, "doc_id", "long"), (text_col, "text", "string")], run, SCHEMA)
