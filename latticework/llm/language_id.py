"""Language identification by rank-order n-gram profiles.

A profile lists a language's most frequent letter n-grams, of one to three letters with word
ends marked, counted over every training text. A document's own list is compared with each
profile by the out-of-place distance: the sum of rank differences, with the list's length for an
n-gram that the profile lacks. The nearest profile wins; the score is one minus its distance as
a share of the greatest possible one.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.llm.arrow import chunks, map_rows

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
UNDETERMINED = "und"
BITS = 18  # letters lie below U+40000


@functools.cache
def letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else 0."""
    table = np.zeros(0x110000, np.int64)
    found = [c for c in range(1 << BITS) if chr(c).isalpha()]
    table[found] = found
    return table


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of the lower-cased text; the top bits tell the order n.

    Anything but letters ends a word. N-grams with a word end inside, or nothing else, don't count.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.zeros(len(points) + 2, np.int64)
    np.take(letters(), points, out=a[1:-1])
    inner = a != 0
    keep = inner.copy()
    keep[1:] |= inner[:-1]
    keep[0] = True
    a = a[keep]  # one word end between words
    one = a[a != 0]
    if not len(one):
        return one
    two = (a[:-1] << BITS) | a[1:]
    three = ((two[:-1] << BITS) | a[2:])[a[1:-1] != 0]
    return np.concatenate([one, two | (1 << 3 * BITS), three | (2 << 3 * BITS)])


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)


def count_grams(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """lang, code, n over all rows with both columns; pre-added in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        size = 0

        def add() -> None:
            for lang, arrays in waiting.items():
                one = np.unique(np.concatenate(arrays), return_counts=True)
                total[lang] = merged([total[lang], one]) if lang in total else one
            waiting.clear()

        for batch in batches:
            for part in chunks(batch):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    codes = grams(text)
                    waiting.setdefault(lang, []).append(codes)
                    size += len(codes)
                    if size > 4_000_000:
                        add()
                        size = 0
        add()
        for lang, (codes, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(n)], names=["lang", "code", "n"])

    counted = map_rows(docs, [(lang_col, "lang", "string"), (text_col, "text", "string")], run, "lang string, code long, n long")
    return counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def learn_profiles(docs: DataFrame, top: int = 400, lang_col: str = "lang", text_col: str = "text") -> dict[str, list[int]]:
    """Each language's ``top`` most frequent n-grams, ties by code; all rows count.

    The lists come to the driver: their size depends on languages and ``top``, never on rows.
    Rows with a null language or text don't count; no such rows give no profiles.
    """
    known = docs.filter(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    counts = count_grams(known, lang_col, text_col).withColumn("part", F.pmod(F.xxhash64("code"), F.lit(32)))
    best = W.partitionBy("lang", "part").orderBy(F.desc("n"), "code")
    rows = counts.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top).select("lang", "code", "n").collect()
    profiles: dict[str, list[tuple[int, int]]] = {}
    for lang, code, n in rows:
        profiles.setdefault(lang, []).append((-n, code))
    return {lang: [code for _, code in sorted(found)[:top]] for lang, found in sorted(profiles.items())}


class Profiles:
    """Ranks of all profiles' n-grams, ready for comparing documents."""

    def __init__(self, profiles: dict[str, list[int]], top: int):
        self.langs, self.top = list(profiles), top
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for k, profile in enumerate(profiles.values()):
            self.ranks[np.searchsorted(self.codes, profile), k] = np.arange(len(profile))
        self.codes = np.append(self.codes, np.iinfo(np.int64).max)

    def nearest(self, text: str | None) -> tuple[str, float]:
        """Language and score; ``und`` and 0 for a text that is null or has no letter."""
        return self.compared(text)[:2]

    def compared(self, text: str | None) -> tuple[str, float, int]:
        """Language, score, and the magnitude of the number of n-grams compared, in halves of its binary logarithm."""
        codes = grams(text) if text else np.zeros(0, np.int64)
        if not len(codes) or not self.langs:
            return UNDETERMINED, 0.0, 0
        codes, n = np.unique(codes, return_counts=True)
        codes = codes[np.argsort(-n, kind="stable")[: self.top]]
        at = np.searchsorted(self.codes, codes)
        ranks = np.where((self.codes[at] == codes)[:, None], self.ranks[at], -1)
        apart = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(codes))[:, None])).sum(axis=0)
        k = int(np.argmin(apart))
        return self.langs[k], float(1 - apart[k] / (len(codes) * self.top)), int(2 * np.log2(len(codes)))


def identify(docs: DataFrame, profiles: dict[str, list[int]], top: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) for every whole text.

    A null text, or one without letters, gives ``und`` with score 0; so does every text if there
    are no profiles. Equal distances go to the language that sorts first. Repeated rows are
    scored one by one, null ids stay null, an empty table gives an empty one, and other columns
    are not read. A text of any length is read whole. Map-only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Profiles(profiles, top)
        for part in (x for batch in batches for x in chunks(batch)):
            got = [own.nearest(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_rows(docs, [(id_col, "doc_id", "long"), (text_col, "text", "string")], run, "doc_id long, lang_pred string, score double")


def in_fold(id_col: str, folds: int, fold: int):
    """Whether crc32 of the id as text leaves that remainder; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify_held_out(docs: DataFrame, folds: int = 4, fold: int = 2, top: int = 400) -> DataFrame:
    """Learns from the documents outside the fold and predicts all: SCHEMA's columns."""
    profiles = learn_profiles(docs.filter(~in_fold("doc_id", folds, fold)), top)
    found = identify(docs, profiles, top)
    return found.select("doc_id", in_fold("doc_id", folds, fold).alias("held_out"), "lang_pred", "score")


def learn_floors(docs: DataFrame, profiles: dict[str, list[int]], top: int, deviations: float, least_score: float, lang_col: str = "lang", text_col: str = "text") -> dict[int, float]:
    """The lowest score of a text in a learned language, by ``magnitude`` of its distinct n-grams.

    Over all rows with a language whose nearest profile is theirs: the mean score less so many
    deviations, for magnitudes with 30 such rows at least. It is never above six tenths of the
    mean, as texts that are all alike deviate little, and never below ``least_score``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = Profiles(profiles, top), {}
        for part in (x for batch in batches for x in chunks(batch)):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found, score, size = own.compared(text)
                if found == lang:
                    n, a, b = sums.get(size, (0, 0.0, 0.0))
                    sums[size] = (n + 1, a + score, b + score * score)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *(pa.array([v[k] for v in sums.values()], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.float64())))], names=["size", "n", "a", "b"])

    counted = map_rows(docs, [(lang_col, "lang", "string"), (text_col, "text", "string")], run, "size int, n long, a double, b double").groupBy("size").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    out = {}
    for r in counted.filter("n >= 30").collect():  # a row a magnitude
        mean = r["a"] / r["n"]
        out[r["size"]] = max(least_score, min(0.6 * mean, mean - deviations * max(0.0, r["b"] / r["n"] - mean * mean) ** 0.5))
    return out


@functools.lru_cache(maxsize=2)
def profiles_of(model: bytes) -> tuple[Profiles, dict[int, float]]:
    profiles, top, floors = pickle.loads(model)
    return Profiles(profiles, top), floors


def keep_identified(docs: DataFrame, folds: int = 4, fold: int = 2, top: int = 400, least_score: float = 0.2, deviations: float = 6.0) -> DataFrame:
    """The rows of docs, all columns, whose text is in a learned language.

    A document is rejected if it is undetermined, or if its nearest profile is so far that the
    score is below the floor: that of all learned documents of its magnitude (``learn_floors``),
    and never below ``least_score``. Profiles and floors are learned as in identify_held_out; if
    there is none to learn, every text with a letter stays. Map-only after learning.
    """
    known = docs.filter(~in_fold("doc_id", folds, fold))
    profiles = learn_profiles(known, top)
    floors = learn_floors(known.filter("lang is not null and text is not null"), profiles, top, deviations, least_score) if profiles else {}
    model = pickle.dumps((profiles, top, floors))

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        own, least = profiles_of(model)
        if not own.langs:
            return pd.Series([bool(t) and len(grams(t)) > 0 for t in texts], dtype=bool)
        found = [own.compared(t) for t in texts]
        return pd.Series([lang != UNDETERMINED and score >= least.get(size, least_score) for lang, score, size in found], dtype=bool)

    return docs.filter(accepted(F.col("text").cast("string")))
