"""Label edits, map evidence and reused responses as streams.

Each gives, on the same rows, what the batch operator gives.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from orthomark.operators import evidence, lookups, ordering


def _append_batches(path: str, checkpoint: str):
    """Idempotent sink: a micro-batch of a stream, told by its checkpoint, owns one folder, so a repeated
    batch replaces itself and a new stream on an old path replaces nothing."""
    stream = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/stream={stream}/batch_id={batch_id}")
    return write


def stream_label_edits(edits: DataFrame, path: str, checkpoint: str, key: tuple[str, ...] = ("object_id",), trigger: dict | None = None) -> StreamingQuery:
    """Keep a change log of the latest edits: every micro-batch is reduced to its last edit per
    object and appended. Edits that arrive late lose to newer ones when the log is read."""
    def write(batch: DataFrame, batch_id: int) -> None:
        _append_batches(path, checkpoint)(ordering.latest_edits(batch, key), batch_id)

    return edits.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_edits(spark: SparkSession, path: str, key: tuple[str, ...] = ("object_id",)) -> DataFrame:
    return ordering.latest_edits(spark.read.parquet(path).drop("batch_id", "stream"), key)


def compact_edits(spark: SparkSession, path: str, target: str, key: tuple[str, ...] = ("object_id",)) -> None:
    """Rewrite a grown change log as one row per object in a new folder."""
    current_edits(spark, path, key).write.mode("errorifexists").parquet(f"{target.rstrip('/')}/stream=compacted/batch_id=0")


def stream_match_evidence(detections: DataFrame, records: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("scene_id", "object_id"),
                          cell: float = 64, levels: int = 3, trigger: dict | None = None) -> StreamingQuery:
    """Detections matched against static records as they arrive; each micro-batch writes them
    with status and tentative identity. A detection belongs to one micro-batch, so its
    evidence is complete there."""
    def write(batch: DataFrame, batch_id: int) -> None:
        found = evidence.match_evidence(batch, records, keys, cell, levels)
        _append_batches(path, checkpoint)(evidence.candidate_identity(batch, found, keys), batch_id)

    return detections.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


RESPONSE_TYPE = "request_id bigint, request_key string, age_us bigint"
# Fixed value: buckets of request keys. Every call for a state takes milliseconds, so keys share states; a stream keeps its number.
KEY_BUCKETS = 512


class FreshResponses(StatefulProcessor):
    """Per bucket of request keys, the times of the fetches of each key that may still answer something. Holds
    the rows of a bucket in one micro-batch."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fetches = handle.getListState("fetches", "request_key string, at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A request is answered by an earlier fetch or is one itself, also where it arrives after later ones.
        known: dict[str | None, list[int]] = {}
        for own, at in sorted(self.fetches.get(), key=lambda row: row[1]):
            known.setdefault(own, []).append(at)
        # The rows of a key may lie in several batches.
        batch = pd.concat(rows, ignore_index=True).sort_values(["t", "request_id"])
        ages = []
        for own, t in zip(batch["request_key"].tolist(), batch["t"].tolist()):
            fetches = known.setdefault(own, [])
            place = bisect_right(fetches, t)
            if place and t - fetches[place - 1] < self.ttl_us:
                ages.append(t - fetches[place - 1])
            else:
                fetches.insert(place, t)
                ages.append(0)
        yield pd.DataFrame({"request_id": batch["request_id"], "request_key": batch["request_key"], "age_us": np.array(ages, np.int64)})
        # Rows older than the watermark never come; a fetch a lifetime before it answers nothing any more.
        oldest = timerValues.getCurrentWatermarkInMs() * 1000 - self.ttl_us
        kept = [(own, int(t)) for own, fetches in known.items() for t in fetches if t > oldest]
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if kept:
            self.fetches.put(kept)
            self.handle.registerTimer((max(t for _own, t in kept) + self.ttl_us) // 1000 + 1)
        else:
            self.fetches.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.fetches.clear()
        yield pd.DataFrame({"request_id": pd.Series(dtype="int64"), "request_key": pd.Series(dtype=str), "age_us": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def stream_fresh_responses(log: DataFrame, ttl_seconds: float = lookups.RESPONSE_TTL_SECONDS, key: str = "request_text",
                           time: str = "requested_at", tie: str = "request_id", buckets: int = KEY_BUCKETS) -> DataFrame:
    """Streaming form of ``fresh_responses``; the session needs the RocksDB state store. The
    watermark equals the lifetime, so a state is dropped once it can answer nothing more. States are kept by
    bucket of keys, ``buckets`` of them, which must stay the same for all of a stream's life."""
    micros = lookups.micros(log, time)
    rows = log.select(F.col(tie).cast("long").alias("request_id"), F.col(key).alias("request_key"), micros.alias("t"),
                      F.timestamp_micros(micros).alias("event_time")).withWatermark("event_time", f"{int(ttl_seconds)} seconds")
    return rows.withColumn("bucket", F.pmod(F.xxhash64("request_key"), F.lit(buckets)).cast("int")).groupBy("bucket").transformWithStateInPandas(
        FreshResponses(int(ttl_seconds * 1_000_000)), RESPONSE_TYPE, "append", "EventTime")
