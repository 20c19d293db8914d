"""Best-fit packing planned on a length histogram.

1. A task encodes its documents, cuts those that are too long, and numbers its pieces within their
   length. Nothing but lengths, checksums and these numbers goes on (the ids too, if asked for).
2. The counts per length, at most ``size`` numbers whatever the input, are packed best fit
   decreasing on the driver: a step places many pieces of one length into many equally filled
   sequences at once. The plan maps runs of ranks within a length to runs of sequences.
3. A piece's rank is its number in the task plus the pieces of that length in tasks before it;
   pieces meet the plan on (length, block of ranks), so that a frequent length is spread.

Defined results: a null or empty text is the end id alone; repeated rows are packed one by one.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orthomark.llm.tokens import Encoder, batches_of, some_at_a_time, tokenizer_path
from orthomark.session import cut_lineage

SIZE = 2048
TOKENIZER, END_ID = "byte_bpe_50k.json", 0
#: Ranks of one join key.
BLOCK = 4096


def plan(counts: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit decreasing on counts: rows (length, first rank, how many, first sequence, offset) and
    the number of sequences. Rank first + i of the length goes to sequence first + i at the offset."""
    rows: list[tuple[int, int, int, int, int]] = []
    # Runs (first sequence, how many) of sequences by free room.
    room: list[deque[tuple[int, int]]] = [deque() for _ in range(size + 1)]
    made = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        free = length
        while left:
            while free < size and not room[free]:
                free += 1
            per = free // length
            if free == size:  # none fits: new sequences
                first, run = made, max(left // per, 1)
                made += run
            else:
                first, run = room[free].popleft()
                use = min(run, max(left // per, 1))
                if use < run:
                    room[free].appendleft((first + use, run - use))
                run = use
            # One sequence may take only the rest of the pieces.
            per = min(per, left)
            for k in range(per):
                rows.append((length, rank, run, first, size - free + k * length))
                rank += run
            left -= per * run
            room[free - per * length].append((first, run))
    return rows, made


def pieces(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth[, ids]): pieces of all documents; ``nth``
    counts the pieces of one length in the task ``part``."""
    path = tokenizer or tokenizer_path(TOKENIZER)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *(["ids"] if with_ids else [])]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = Encoder(path, blanks_kept=True), TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            doc_ids, at = batch.column(0), 0
            for texts in batches_of(some_at_a_time(batch.column(1))):
                doc, rows = [], []
                for k, ids in enumerate(encoder.encode(texts)):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    start, number = 0, 0
                    while start < len(ids):
                        length = (len(ids) - start - 1) % size + 1 if number == 0 else size
                        own = ids[start:start + length].tobytes()
                        doc.append(at + k)
                        rows.append((number, start, length, zlib.crc32(own), part, seen[length], own))
                        seen[length] += 1
                        start, number = start + length, number + 1
                at += len(texts)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(doc)), *columns][:len(names)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, schema)


def pack(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and its offset there: (doc_id, piece, start, length, ids_crc32,
    sequence_id, offset[, ids]). A sequence is filled from 0 without gaps, to at most ``size``."""
    cut = cut_lineage(pieces(docs, size, tokenizer, with_ids))
    per_task = cut_lineage(cut.groupBy("length", "part").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = counts.pop(size, 0)
    rows, made = plan(counts, size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    kept = [c for c in cut.columns if c not in ("part", "nth")]
    ranked = cut.join(bases, ["length", "part"]).select(*kept, (F.col("nth") + F.col("base")).alias("rank"))
    whole = ranked.filter(F.col("length") == size).select(*kept, (F.col("rank") + made).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not counts:
        return whole if full else ranked.filter("false").select(*kept, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    spark = docs.sparkSession
    table = pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], names=["length", "first", "n", "sequence", "offset"])
    blocks = F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("n") - 1) / BLOCK))).alias("block")
    slots = spark.createDataFrame(table).select("*", blocks)
    placed = (ranked.filter(F.col("length") < size).withColumn("block", F.floor(F.col("rank") / BLOCK))
              .join(slots, ["length", "block"]).filter("rank >= first and rank < first + n")
              .select(*kept, (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset"))
    return placed.unionByName(whole)
