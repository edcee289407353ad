"""Toxicity by non-negative positive-unlabelled learning.

A text's features are the hashed words and word beginnings that it holds. A
linear classifier is trained in numpy from confirmed toxic texts and unlabelled
ones. With the prior p of the toxic class, the risk over the unlabelled
texts less p times that over the toxic ones, both as if not toxic, estimates
the risk over texts that are not toxic; where it falls below zero, which only
overfitting can cause, the step goes back up it.

Labels come only from keys whose crc32 is no multiple of ``FOLDS``, and so do
the unlabelled texts, whose labels are not read. All of these texts count: each
task sums its texts' part of the risk's slope, in whole numbers, so that neither
order nor partitioning changes the result. Confirmed toxic are the texts of at
most ``MAX_TOXIC`` keys, those of smallest hash; nothing else is bounded. Only
positive labels are read. The prior is the least that a feature allows, as the
share of the unlabelled texts that holds it can't be below the prior times its
share among the toxic ones. Features that toxic texts hold no more often than chance
would have it are left out.

Null and empty texts have no features; their score is that of the bias. Keys
without a label, null keys and repeated rows are scored like any others; of
repeated labels the largest counts. Without any toxic label all scores are the
clipped prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pagegrain.llm.common import map_columns, quoted, remove, slices, written
from pagegrain.llm.wordhash import Words, chunks

BITS = 18
FOLDS = 5
MAX_TOXIC = 3000
BEGINNINGS = (4, 5, 6)
LEAST_TEXTS = 3
LEAST_SIGMAS = 3.0
SURE = 2.0
EPOCHS = 60
RATE = 0.2
DECAY = 1e-4
SCALE = 1 << 24
#: Text bytes whose features a task holds at once.
SLICE_BYTES = 1 << 20
#: Buckets held before repeats are dropped.
MOST_HELD = 1 << 20


def _buckets(found: Words) -> np.ndarray:
    """Buckets of the words' beginnings and of the words, a row for each kind."""
    hashes = [found.hashes(np.minimum(found.start + k, found.end), k) for k in BEGINNINGS]
    return (np.stack([*hashes, found.hashes()]) >> np.uint64(64 - BITS)).astype(np.int32)


def _distinct(keys: list[np.ndarray]) -> np.ndarray:
    found = np.concatenate([*keys, np.empty(0, np.int32)])
    found.sort()
    return found[np.concatenate((np.ones(min(1, len(found)), bool), found[1:] != found[:-1]))]


def features_of(texts: list[str | None], place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct buckets of whole texts, ordered by both;
    with ``place``, (text, place) of the buckets whose place isn't negative."""
    data = [(t or "").lower().encode() for t in texts]
    begins = np.cumsum([0, *[len(t) + 1 for t in data]])
    rows = np.arange(len(texts), dtype=np.int32 if len(texts) <= 1 << 31 - BITS else np.int64) << BITS
    keys, held, at = [], 0, 0
    for part in chunks(b" ".join(data)):
        found = Words(part)
        row = np.repeat(rows, np.diff(np.searchsorted(found.start + at, begins)))
        at += len(part)
        buckets = _buckets(found)
        if place is not None:
            buckets = place[buckets]
        keys.append((row | buckets)[buckets >= 0] if place is not None else (row | buckets).ravel())
        held += len(keys[-1])
        if held > MOST_HELD:
            # a single long text: its distinct buckets are few
            keys, held = [_distinct(keys)], 0
    found = _distinct(keys)
    return found >> BITS, found & ((1 << BITS) - 1)


def features(text: str | None) -> np.ndarray:
    """The distinct buckets of a whole text."""
    return features_of([text])[1]


def places(kept: np.ndarray) -> np.ndarray:
    """For each bucket its place among ``kept``, or -1."""
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    return place


@dataclass(frozen=True)
class Model:
    bias: float
    buckets: np.ndarray
    weights: np.ndarray


def scores(texts: list[str | None], model: Model, place: np.ndarray) -> np.ndarray:
    """The texts' probabilities of toxic; ``place``: of the model's buckets."""
    row, at = features_of(texts, place)
    z = np.bincount(row, model.weights[at], len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def least_prior(among: np.ndarray, everywhere: np.ndarray, n: int, m: int) -> float:
    """The share of toxic texts that the features' counts in n toxic and in m
    unlabelled texts allow: that of the feature whose bound is the least
    with ``SURE`` standard deviations on top."""
    ratio = everywhere / m / (among / n)
    return float(ratio[np.argmin(ratio * (1 + SURE * np.sqrt(1 / among + 1 / everywhere)))])


def selected(among: np.ndarray, everywhere: np.ndarray, n: int, m: int) -> np.ndarray:
    """Features that toxic texts hold more often than chance would have it."""
    chance = everywhere * (n / m)
    return np.flatnonzero((among >= LEAST_TEXTS) & (among - chance >= LEAST_SIGMAS * np.sqrt(chance + 1)))


def partial_sums(at: np.ndarray, sizes: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    """Sums over texts, in whole numbers: of the probability of toxic by
    feature, of it, and of the loss as not toxic. ``at``: the features of all
    texts in turn, ``sizes``: how many each has."""
    held = np.flatnonzero(sizes)
    z = np.full(len(sizes), bias)
    if len(held):
        z[held] += np.add.reduceat(w[at], (np.cumsum(sizes) - sizes)[held])
    z = np.clip(z, -500, 500)
    probable = np.rint(SCALE / (1 + np.exp(-z)))
    loss = np.rint(SCALE * np.logaddexp(0, z))
    return np.concatenate((np.bincount(at, np.repeat(probable, sizes), len(w)), [probable.sum(), loss.sum()])).astype(np.int64)


def fit(sums, among: np.ndarray, n: int, m: int, prior: float) -> tuple[float, np.ndarray]:
    """(bias, weights) by full steps down the non-negative risk. ``sums(w,
    bias)`` gives ``partial_sums`` of the toxic and of the unlabelled texts;
    ``among``: how many toxic texts hold each feature."""
    bias = float(np.log(prior / (1 - prior)))
    w, first, second = np.zeros(len(among)), np.zeros(len(among) + 1), np.zeros(len(among) + 1)
    of_toxic = np.append(among, n) / n
    for step in range(1, EPOCHS + 1):
        toxic, unlabelled = (x / SCALE for x in sums(w, bias))
        # logistic losses: log(1 + e^-z) as toxic, log(1 + e^z) as not; they differ by z
        if unlabelled[-1] / m - prior * toxic[-1] / n >= 0:
            slope = unlabelled[:-1] / m - prior * of_toxic + DECAY * np.append(w, 0)
        else:
            slope = prior * toxic[:-1] / n - unlabelled[:-1] / m
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    return bias, w


def held_out(key: Column) -> Column:
    """True for the keys whose labels are never read; null keys among them."""
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == 0, F.lit(True))


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str | None]]]:
    """(whether toxic, texts) of slices."""
    for batch in batches:
        for part in slices(batch, "t", SLICE_BYTES):
            yield part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, toxic, texts): how many toxic texts and texts in all hold it; of
    the bucket that is none, how many there are."""
    counts = np.zeros((2, (1 << BITS) + 1), np.int64)
    for toxic, texts in _told(batches):
        row, at = features_of(texts)
        for kind, held in enumerate((at[toxic[row]], at)):
            counts[kind, :-1] += np.bincount(held, minlength=1 << BITS)
        counts[:, -1] += toxic.sum(), len(texts)
    at = np.flatnonzero(counts[1])
    for i in range(0, len(at), 10_000):
        some = at[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[0, some]), pa.array(counts[1, some])], names=["bucket", "toxic", "texts"])


def place_type(features: int) -> type:
    return np.uint16 if features <= 1 << 16 else np.int32


def _pack(kept: np.ndarray):
    """Arrow map from texts to rows of many texts' places among ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = places(kept)
        for toxic, texts in _told(batches):
            row, at = features_of(texts, place)
            sizes, at = np.bincount(row, minlength=len(texts)).astype(np.int32), at.astype(place_type(len(kept)))
            for kind, some, size in ((False, at, sizes), (True, at[toxic[row]], sizes[toxic])):
                if len(size):
                    yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([some.tobytes()]), pa.array([size.tobytes()])], names=["toxic", "places", "sizes"])

    return run


def _sum(w: np.ndarray, bias: float):
    """Arrow map from packed rows to (toxic, place, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, len(w) + 2), np.int64)
        for batch in batches:
            for toxic, places, sizes in zip(*(batch.column(i) for i in range(3))):
                at = np.frombuffer(places.as_buffer(), place_type(len(w)))
                totals[int(toxic.as_py())] += partial_sums(at, np.frombuffer(sizes.as_buffer(), np.int32), w, bias)
        for kind in np.flatnonzero(totals.any(axis=1)).tolist():
            names = pa.array(np.arange(len(w) + 2, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([bool(kind)] * len(names)), names, pa.array(totals[kind])], names=["toxic", "place", "total"])

    return run


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits the classifier from the keys outside the held-out fold."""
    spark = docs.sparkSession
    known = labels.where(F.col(quoted(key)).isNotNull() & (F.col(quoted(label)).cast("int") == 1) & ~held_out(F.col(quoted(key))))
    some = known.select(F.col(quoted(key)).alias("k")).distinct().orderBy(F.xxhash64("k"), "k").limit(MAX_TOXIC).withColumn("toxic", F.lit(True))
    open_docs = docs.select(F.col(quoted(key)).alias("k"), F.col(quoted(text)).alias("t")).where(~held_out(F.col("k")))
    told = open_docs.join(F.broadcast(some), "k", "left").select(F.coalesce("toxic", F.lit(False)).alias("toxic"), "t")
    # as many rows as buckets at most
    found = told.mapInArrow(_count, "bucket int, toxic long, texts long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts")).toArrow()
    counts = np.zeros((2, (1 << BITS) + 1))
    for row, name in enumerate(("toxic", "texts")):
        counts[row, found.column("bucket").to_numpy()] = found.column(name).to_numpy()
    (among, everywhere), (n, m) = counts[:, :-1], counts[:, -1].astype(int).tolist()
    none = np.empty(0, np.int64)
    kept = selected(among, everywhere, n, m) if n else none
    prior = float(np.clip(least_prior(among[kept], everywhere[kept], n, m) if len(kept) else 0.0, 1e-4, 0.9))
    if not len(kept):
        return Model(float(np.log(prior / (1 - prior))), none, np.empty(0))
    packed, path = written(told.mapInArrow(_pack(kept), "toxic boolean, places binary, sizes binary"), "toxicity-features")

    def sums(w: np.ndarray, bias: float) -> np.ndarray:
        made = packed.mapInArrow(_sum(w, bias), "toxic boolean, place int, total long").groupBy("toxic", "place").agg(F.sum("total").alias("total")).toArrow()
        out = np.zeros((2, len(w) + 2))
        out[made.column("toxic").to_numpy(zero_copy_only=False).astype(int), made.column("place").to_numpy()] = made.column("total").to_numpy()
        return out[::-1]

    bias, w = fit(sums, among[kept], n, m, prior)
    remove(spark, path)
    return Model(bias, kept, w)


def with_toxicity(df: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Adds ``out``, the probability that the whole text is toxic; an input
    column of that name is replaced."""

    def make():
        place = places(model.buckets)

        def work(texts: pa.Array):
            return [scores(texts.to_pylist(), model, place)]

        return work

    return map_columns(df, [text], [(out, DoubleType(), pa.float64())], make, weigh=text, most=SLICE_BYTES)
