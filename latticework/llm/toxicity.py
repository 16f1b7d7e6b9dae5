"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; unlabelled documents are a mixture of both classes.
With the class prior p the risk of a scorer g is

    p * mean over positives of loss(g) + max(0, mean over unlabelled of loss(-g) - p * mean over positives of loss(-g))

whose second part estimates the negatives' risk. When that estimate falls below zero, the step
descends on its negation instead, so that the fit doesn't run after the positives it has seen.
The scorer is linear over the presence of words and of word beginnings; those most
over-represented among positives against the estimated negatives are the inputs, counted over
every document. It is trained in numpy: first on a bounded sample, chosen by a hash of the id, to
start from; then on all unlabelled documents against the confirmed examples, whose number is
bounded: each step's gradient is summed where the documents lie, over counts of equal inputs.
Every whole text of the table is scored.
"""

from __future__ import annotations

import functools
import math
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.arrow import Memo, chunks, map_rows
from latticework.llm.scratch import Scratch

SCORED = "doc_id long, score double, predicted int"
WORDS = re.compile(r"[^\W\d_]+").findall
STEMS = range(4, 9)


def units(word: str) -> list[str]:
    """The word itself, and its beginnings of four to eight letters."""
    return [word + "$", *[word[:n] for n in STEMS if n < len(word)]]


def count_units(rows: DataFrame, likely: list[str] | None = None) -> DataFrame:
    """unit, pos, unl: confirmed examples (positive 1), and all documents, that have the unit; pre-added in each task.

    With ``likely``, only those units are counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {u: i for i, u in enumerate(likely or [])}
        known: dict[str, tuple[int, ...]] = {}  # units of each word
        totals = [np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)]

        def units_of(word: str) -> tuple[int, ...]:
            found = known.get(word)
            if found is None:
                every = units(word)
                found = known[word] = tuple(number.setdefault(u, len(number)) for u in every) if likely is None else tuple(number[u] for u in every if u in number)
            return found

        for batch in batches:
            for part in chunks(batch):
                seen: tuple[list[int], list[int]] = ([], [])
                for positive, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = set().union(*map(units_of, set(WORDS((text or "").lower()))))
                    seen[0].extend(found)
                    if positive:
                        seen[1].extend(found)
                for k in (0, 1):
                    new = np.bincount(np.array(seen[k], np.int64), minlength=len(number))
                    new[: len(totals[k])] += totals[k]
                    totals[k] = new
                if len(known) > 150_000:
                    known.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()), pa.array(totals[1]), pa.array(totals[0])], names=["unit", "pos", "unl"])

    counted = map_rows(rows, [("positive", "positive", "int"), ("text", "text", "string")], run, "unit string, pos long, unl long")
    return counted.groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))


class Presence:
    """Which of the chosen units a text has."""

    def __init__(self, chosen: list[str]):
        self.place = {u: i for i, u in enumerate(chosen)}
        self.memo = Memo(lambda words: [tuple({self.place[u] for u in units(w) if u in self.place}) for w in words], cap=150_000)

    def of(self, text: str | None) -> list[int]:
        words = set(WORDS((text or "").lower()))
        known = self.memo.need(words)
        return sorted(set().union(*map(known.__getitem__, words))) if words else []


def share_of(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def grown(x: np.ndarray, g: np.ndarray) -> np.ndarray:
    return np.append(g.astype(x.dtype) @ x, g.sum()) / len(x)


def combined(w: np.ndarray, positive: np.ndarray, loss: float, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """The direction to go against, from the unlabelled documents' mean loss and its gradient.

    It is the risk's gradient, or, where the negatives' estimate is below zero, that of its negation.
    """
    p = positive @ w[:-1].astype(positive.dtype) + w[-1]
    step = unlabelled - prior * grown(positive, share_of(p))
    return step + prior * grown(positive, share_of(p) - 1) if loss - prior * np.logaddexp(0, p).mean() >= 0 else -step


def slope(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    u = unlabelled @ w[:-1].astype(unlabelled.dtype) + w[-1]
    return combined(w, positive, np.logaddexp(0, u).mean(), grown(unlabelled, share_of(u)), prior)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 2e-4, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss, by Adam."""
    w = np.append(np.zeros(positive.shape[1]), math.log(prior / (1 - prior))) if start is None else start.copy()
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        step = slope(w, positive, unlabelled, prior)
        step[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step**2
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def learn(
    docs: DataFrame, labels: DataFrame, fold_filter: Column, n_positive: int = 2500, n_start: int = 5000, n_units: int = 600, least_z: float = 4.0, prior: float | None = None
) -> dict:
    """A model {units, weights, bias} from documents and labels (doc_id, toxic).

    Only rows for which ``fold_filter`` (over doc_id) holds take part. Confirmed toxic documents
    are bounded: ``n_positive``, those with the smallest hash of their id. All documents, whatever
    their label, are the unlabelled ones; ``n_start`` of them give the start of the training.
    ``prior`` is the share of toxic documents; if not given, the share among the labelled rows
    that take part. Without positives, or without unlabelled documents, the model scores
    everything near 0. A unit must be over-represented by ``least_z`` standard errors to be one of
    at most ``n_units`` inputs.
    """
    seen = labels.filter(fold_filter & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    n, toxic = seen.agg(F.count(F.lit(1)), F.sum((F.col("toxic") == 1).cast("long"))).first()
    if not toxic:
        return {"units": [], "weights": [], "bias": -40.0}
    share = min(max(prior if prior is not None else toxic / n, 1e-4), 0.5)
    near = lambda ids, k, mark: ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(k).withColumn("positive", F.lit(mark))
    open_docs = docs.filter(fold_filter & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = lambda rows: F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in rows.collect()], "doc_id long, positive int"))
    # Bounded: at most n_positive and n_start rows of two small columns.
    confirmed, starting = table(near(seen.filter("toxic = 1"), n_positive, 1)), table(near(open_docs, n_start, 0))
    marked = open_docs.join(confirmed, "doc_id", "left").select(F.coalesce("positive", F.lit(0)).alias("positive"), "text")
    n_unl, n_pos = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum("positive"), F.lit(0))).first()
    if not n_pos or not n_unl:
        return {"units": [], "weights": [], "bias": -40.0}
    p, u = F.col("pos") / n_pos, F.col("unl") / n_unl
    neg = F.greatest((u - share * p) / (1 - share), F.lit(0.5 / n_unl))
    z = (p - neg) / F.sqrt(neg / n_unl + p * (1 - p) / n_pos + F.lit(1.0) / n_pos**2)
    # Units of too few confirmed examples can't be chosen: theirs, a bounded number, are found first.
    least = max(3, n_pos // 200)
    likely = sorted(r["unit"] for r in count_units(open_docs.join(confirmed, "doc_id")).filter(F.col("pos") >= least).collect())
    best = count_units(marked, likely).filter((F.col("pos") >= least) & (p > 3 * neg)).withColumn("z", z).filter(F.col("z") >= least_z).orderBy(F.desc("z"), "unit").limit(n_units)
    chosen = [r["unit"] for r in best.select("unit", "z").collect()]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Presence(chosen)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["positive", "has"])

    sample = open_docs.join(confirmed, "doc_id").unionByName(open_docs.join(starting, "doc_id"))
    rows = map_rows(sample, [("positive", "positive", "int"), ("text", "text", "string")], vectors, "positive int, has array<int>").collect()
    rows.sort(key=lambda r: (r[0], r[1]))  # one order whatever the partitions
    positive, started = ([r[1] for r in rows if r[0] == k] for k in (1, 0))
    x = dense(positive, len(chosen))
    weights, bias = fit(x, dense(started, len(chosen)), share)
    if n_unl > len(started) and chosen:
        weights, bias = refine(open_docs, chosen, x, share, weights, bias)
    return {"units": chosen, "weights": list(map(float, weights)), "bias": float(bias)}


def dense(rows: list[list[int]], width: int) -> np.ndarray:
    x = np.zeros((len(rows), width), np.float32)
    for i, has in enumerate(rows):
        x[i, has] = 1
    return x


def refine(docs: DataFrame, chosen: list[str], positive: np.ndarray, prior: float, weights: np.ndarray, bias: float, steps: int = 25, rate: float = 0.02, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias after Adam steps on the risk over every document as an unlabelled one.

    Documents are counted by the units they have, pre-added in each task, and written once. Each
    step sums losses and gradients over those rows where they lie; a row a task comes to the driver.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Presence(chosen)
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([pa.array([own.of(t) for t in part.column(0).to_pylist()], pa.list_(pa.int32()))], names=["has"])

    rows = scratch.keep(map_rows(docs, [("text", "text", "string")], vectors, "has array<int>").groupBy("has").agg(F.count(F.lit(1)).alias("n")))
    w, x = np.append(weights, bias), positive.astype(np.float64)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):

        def run(batches: Iterator[pa.RecordBatch], w: np.ndarray = w.copy()) -> Iterator[pa.RecordBatch]:
            total, grown, n_docs = 0.0, np.zeros(len(w)), 0
            for batch in batches:
                flat, n = batch.column(0).flatten().to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
                lengths = np.array(batch.column(0).value_lengths().to_pylist(), np.int64)
                at = np.repeat(np.arange(len(n)), lengths)
                g = np.bincount(at, w[flat], len(n)) + w[-1] if len(flat) else np.full(len(n), w[-1])
                share = n / (1 + np.exp(-np.clip(g, -40, 40)))
                total += float((n * np.logaddexp(0, g)).sum())
                grown[:-1] += np.bincount(flat, share[at], len(w) - 1) if len(flat) else 0
                grown[-1] += share.sum()
                n_docs += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([grown.tobytes()], pa.binary()), pa.array([n_docs], pa.int64())], names=["loss", "slope", "n"])

        parts = rows.mapInArrow(run, "loss double, slope binary, n long").collect()
        parts.sort(key=lambda r: (r["n"], r["loss"], bytes(r["slope"])))  # one order of adding
        n_docs = sum(r["n"] for r in parts)
        mean_loss, mean_slope = sum(r["loss"] for r in parts) / n_docs, sum(np.frombuffer(r["slope"]) for r in parts) / n_docs
        step = combined(w, x, mean_loss, mean_slope, prior)
        step[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step**2
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    scratch.drop(rows)
    return w[:-1], float(w[-1])


@functools.lru_cache(maxsize=2)
def scorer(model: bytes) -> tuple[Presence, np.ndarray, float]:
    own = pickle.loads(model)
    return Presence(own["units"]), np.array(own["weights"]), own["bias"]


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: toxic likelier), predicted (1 if score >= 0.5) of every whole text.

    A null or empty text has the score of a text without any chosen unit; a text of any length is
    read whole. Repeated rows are scored one by one, null ids stay null, an empty table gives an
    empty one, and no other column is read. Map-only.
    """

    raw = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w, bias = scorer(raw)
        for batch in batches:
            for part in chunks(batch):
                g = np.array([w[own.of(t)].sum() for t in part.column(1).to_pylist()]) + bias
                s = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return map_rows(docs, [(id_col, "doc_id", "long"), (text_col, "text", "string")], run, SCORED)


def outside_fold(folds: int, fold: int) -> Column:
    """Rows to learn from: crc32 of the id as text leaves another remainder than ``fold``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != fold


def score_held_out(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """Learns outside the fold and scores all: doc_id, held_out, score, predicted."""
    model = learn(docs, labels, outside_fold(folds, fold))
    held = F.coalesce(~outside_fold(folds, fold), F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, least_toxic: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, with a score below ``least_toxic``. Map-only after learning."""
    model = learn(docs, labels, outside_fold(folds, fold))

    raw = pickle.dumps(model)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        own, w, bias = scorer(raw)
        least = math.log(least_toxic / (1 - least_toxic))
        return pd.Series([w[own.of(t)].sum() + bias < least for t in texts], dtype=bool)

    return docs.filter(clean(F.col("text").cast("string")))
