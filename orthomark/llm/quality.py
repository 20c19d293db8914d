"""Quality by importance resampling of hashed n-grams.

Two generative models, bags of hashed n-grams, are counted: one on the documents labelled good (the
target), one on all documents (the raw text). The n-grams are runs of ``BYTES`` bytes and, for each
word, which of the last ``REPEATS`` words it repeats the word before, as loops of common words look
ordinary byte by byte. A document's log weight is the mean log ratio of both models over its
n-grams. Documents are sampled without replacement by Gumbel top-k: the ``k`` largest of
``SHARPNESS`` * log weight + Gumbel noise, the noise taken from a hash of the id. By default ``k`` is the
number of documents over the threshold that at most ``LOSS`` of the good labelled documents miss, each
of these judged by a target model without its half of the labels.

A model is ``BUCKETS`` counts whatever the input. The k-th largest key is found by counting keys in
ever finer bins; nothing is ranked as a whole.

Defined results: empty and null texts have no n-grams and the log weight of the threshold less one (or
-1 without labels); rows with one id and one text share their noise; keys equal to the k-th are all
taken; without labels all documents are kept; result columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthomark.llm import words as W
from orthomark.llm.labelled import with_marks
from orthomark.llm.own_columns import set_aside
from orthomark.session import cut_lineage

BYTES, REPEATS = 4, 4
BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
SHARPNESS = 100.0
LOSS = 0.001
#: Bins of the calibration, over mean log ratios from LOW to HIGH.
LOW, HIGH, BINS = -12.0, 4.0, 16_000
#: Bins of one step of the search for the k-th key.
STEP_BINS = 2048


def grams(raw: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text number) of every n-gram, a very long text in parts."""
    for at in range(0, len(raw), 2 * W.STEP):
        part = raw[at:at + 2 * W.STEP + BYTES - 1]
        n = max(len(part) - BYTES + 1, 0)
        code = np.zeros(n, np.uint64)
        for k in range(BYTES):
            code = (code << np.uint64(8)) | part[k:k + n]
        # Only a text of its own is longer than a part.
        owner = np.zeros(len(part), np.int64) if len(bounds) == 2 else np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[at:at + len(part)]
        inside = owner[:n] == owner[BYTES - 1:] if n else np.zeros(0, bool)
        yield _bucket(code[inside]), owner[:n][inside]
    words = W.Words(raw, bounds, W.SPACED)
    again = np.zeros(len(words.codes), np.uint64)
    if len(again):
        again[1:] = (words.codes[1:] == words.codes[:-1]) & (words.text[1:] == words.text[:-1])
    pattern = np.zeros(len(again), np.uint64)
    for k in range(REPEATS):
        pattern[k:] |= again[:len(again) - k] << np.uint64(k)
    yield _bucket(pattern | np.uint64(1 << 40)), words.text


def _bucket(code: np.ndarray) -> np.ndarray:
    return (W.mix(code) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def means(raw: np.ndarray, bounds: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of n-grams of every text, and the mean table value for each table."""
    count, sums = np.zeros(len(bounds) - 1, np.int64), [np.zeros(len(bounds) - 1) for _ in tables]
    for place, owner in grams(raw, bounds):
        count += np.bincount(owner, minlength=len(count))
        for total, table in zip(sums, tables):
            total += np.bincount(owner, table[place], minlength=len(count))
    return count, [total / np.maximum(count, 1) for total in sums]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, half) to rows (bucket, raw, target0, target1); ``half`` marks good labelled documents."""
    counts = np.zeros((3, BUCKETS), np.int64)
    for batch in batches:
        halves = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
        for at, to, raw, bounds in W.steps(batch.column(0)):
            for place, owner in grams(raw, bounds):
                counts[0] += np.bincount(place, minlength=BUCKETS)
                half = halves[at:to][owner]
                for h in range(2):
                    counts[h + 1] += np.bincount(place[half == h], minlength=BUCKETS)
    some = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(c[some]) for c in counts]], names=["bucket", "raw", "target0", "target1"])


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log P(n-gram | target) - log P(n-gram | raw), half a count added to every bucket seen."""
    seen = raw > 0
    out = np.zeros(BUCKETS)
    if target.sum():
        out[seen] = np.log((target[seen] + 0.5) / (target.sum() + 0.5 * seen.sum())) - np.log((raw[seen] + 0.5) / (raw.sum() + 0.5 * seen.sum()))
    return out


def _bin(value: np.ndarray) -> np.ndarray:
    return np.clip((value - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The log ratio of every bucket and the threshold of the mean (-inf without labels)."""
    good = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.min("quality") > 0).alias("_good"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    half = F.when(F.col("_good"), F.pmod(F.xxhash64("_id"), F.lit(2)).cast("int"))
    marked = with_marks(rows, cut_lineage(good), "_id").select("text", half.alias("half"))
    summed = marked.mapInArrow(_count, "bucket long, raw long, target0 long, target1 long").groupBy("bucket").agg(
        *[F.sum(c).alias(c) for c in ("raw", "target0", "target1")]).toArrow()  # at most BUCKETS rows
    counts = np.zeros((3, BUCKETS))
    for c, name in enumerate(("raw", "target0", "target1")):
        counts[c, summed.column("bucket").to_numpy()] = summed.column(name).to_numpy()
    ratio = log_ratio(counts[1] + counts[2], counts[0])
    if not (counts[1].sum() and counts[2].sum()):
        return ratio, -np.inf
    shared = docs.sparkSession.sparkContext.broadcast([log_ratio(counts[2], counts[0]), log_ratio(counts[1], counts[0])])

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BINS, np.int64)
        for batch in batches:
            halves = batch.column(1).to_numpy()
            for at, to, raw, bounds in W.steps(batch.column(0)):
                count, values = means(raw, bounds, shared.value)
                for h in range(2):
                    found += np.bincount(_bin(values[h][(halves[at:to] == h) & (count > 0)]), minlength=BINS)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["bin", "n"])

    held = marked.filter("half is not null").mapInArrow(bins, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow().sort_by("bin")
    if not len(held):
        return ratio, -np.inf
    places, below = held.column("bin").to_numpy(), np.cumsum(held.column("n").to_numpy())
    first = places[np.flatnonzero(below > LOSS * below[-1])[0]]
    return ratio, LOW + (HIGH - LOW) * int(first) / BINS


def weighted(docs: DataFrame, ratio: np.ndarray, threshold: float) -> DataFrame:
    """``docs`` with n_grams, log_weight and sample_key."""
    from pyspark.sql.pandas.types import to_arrow_schema

    own = T.StructType([T.StructField("n_grams", T.LongType()), T.StructField("log_weight", T.DoubleType())])
    kept = [f for f in docs.schema if f.name not in ("n_grams", "log_weight", "sample_key")]
    names = to_arrow_schema(own).names
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    bare = threshold - 1 if np.isfinite(threshold) else -1.0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, raw, bounds in W.steps(batch.column("text")):
                count, (value,) = means(raw, bounds, [shared.value])
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(count.astype(np.int64)), pa.array(np.where(count > 0, value, bare))],
                                                 names=[*part.schema.names, *names])

    found = docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(task, T.StructType([*kept, *own]))
    chance = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return found.withColumn("sample_key", SHARPNESS * F.col("log_weight") - F.log(-F.log(chance)))


def kth_largest(keys: DataFrame, k: int, name: str = "sample_key") -> float:
    """The k-th largest of a column, by counts in ever finer bins."""
    bounds = keys.agg(F.min(name).alias("low"), F.max(name).alias("high"), F.count("*").alias("n")).first()
    if k >= bounds.n:
        return -np.inf
    low, high, left = bounds.low, bounds.high, k
    while True:
        width = (high - low) / STEP_BINS
        inside = keys.filter(F.col(name).between(low, high))
        if width <= 1e-13 * max(abs(low), abs(high), 1e-300):
            return low
        place = F.least(F.floor((F.col(name) - low) / width), F.lit(STEP_BINS - 1))
        counted = sorted(inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(name).alias("low"), F.max(name).alias("high")).collect(), reverse=True)
        for row in counted:
            if row.n >= left:
                break
            left -= row.n
        if row.n == left or row.low == row.high:
            return row.low
        low, high = row.low, row.high


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The sampled rows of ``docs`` (doc_id, text, ...) with n_grams, log_weight and sample_key."""
    ratio, threshold = fit(docs, labels)
    keys = cut_lineage(weighted(docs, ratio, threshold).select("log_weight", "sample_key"))
    wanted = keys.filter(F.col("log_weight") >= float(threshold)).count() if k is None else k
    if wanted <= 0:
        return weighted(docs, ratio, threshold).filter("false")
    return weighted(docs, ratio, threshold).filter(F.col("sample_key") >= float(kth_largest(keys, wanted)))


def keep_sampled(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The sampled rows of ``docs``, as they are."""
    return set_aside(docs, ("n_grams", "log_weight", "sample_key"), lambda d: resample(d, labels, k))

