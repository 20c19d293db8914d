"""Token ids in files of shards compressed by Re-Pair.

A shard holds the ids of consecutive documents, in ascending order of their ids: about
``SHARD_TOKENS`` of them, always whole documents. All pairs of neighbouring symbols are counted,
frequent ones are replaced by new symbols, and this is repeated until no pair occurs ``LEAST``
times; a round replaces all pairs at least a quarter as frequent as the most frequent one, of
overlapping places every second one. Stored are the rules, the expanded length of every rule, the
remaining sequence and the token position at every ``STRIDE``-th symbol, so that any token range is
decoded from the symbols that cover it.

A file is a Parquet file with one row per shard, written and committed by Spark:
part, shard (order), n_tokens, doc_ids, doc_ends (token position after each document), data.
``data``: magic "RPR2", the first symbol of a rule (one above the largest id of the shard), counts of
rules and symbols, bytes of a rule length (uint32 each, little endian), pairs (2 symbols a rule),
rule lengths, sequence, positions (uint64). Symbols take as many bytes as the largest one needs.

Defined results: a null or empty text is the end id alone; repeated rows are stored one by one, rows
without an id come first; documents with one id are ordered by their text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orthomark.llm.tokens import Encoder, batches_of, some_at_a_time, tokenizer_path

TOKENIZER, END_ID = "word_bpe_49k.json", 2
SHARD_TOKENS = 1_000_000
LEAST, STRIDE = 16, 64
SHARDS = "part int, shard int, n_tokens long, doc_ids array<long>, doc_ends array<long>, data binary"


def compress(ids: np.ndarray, first_symbol: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, rule lengths, sequence): symbols below ``first_symbol`` are ids, the others rules in order."""
    sequence = ids.astype(np.uint32)
    pairs, lengths = [np.zeros((0, 2), np.uint32)], np.zeros(0, np.uint32)
    # Places whose pair may be frequent: a pair that was rare stays so, as new pairs have a new symbol.
    active = np.arange(max(len(sequence) - 1, 0))
    while len(active) >= LEAST:
        wide = sequence.astype(np.uint64)
        codes = ((wide[:-1] << np.uint64(32)) | wide[1:])[active]
        ordered = np.sort(codes)
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(starts, len(ordered)))
        often = counts >= LEAST
        if not often.any():
            break
        known, counts = ordered[starts[often]], counts[often]
        number = numbers_of(codes, known)
        own = number >= 0
        active, number = active[own], number[own]
        chosen = counts >= max(LEAST, int(counts.max()) // 4)
        rule = (first_symbol + len(lengths) - 1 + np.cumsum(chosen)).astype(np.uint32)
        best = known[chosen]
        fresh = np.stack([best >> np.uint64(32), best & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        hit = chosen[number]
        place, rules = active[hit], rule[number[hit]]
        # Of places that overlap, the first, third, ... of each run are replaced.
        start = np.concatenate([[True], np.diff(place) > 1])
        run = place[start][np.cumsum(start) - 1]
        odd = (place - run) % 2 == 0
        place, rules = place[odd], rules[odd]
        sizes = symbol_lengths(lengths, fresh.ravel(), first_symbol).reshape(-1, 2).sum(axis=1)
        pairs.append(fresh)
        lengths = np.concatenate([lengths, sizes.astype(np.uint32)])
        sequence[place] = rules
        keep = np.ones(len(sequence), bool)
        keep[place + 1] = False
        again = np.zeros(len(sequence), bool)
        again[active] = True
        again[place] = True
        again[place[place > 0] - 1] = True
        sequence = sequence[keep]
        active = np.flatnonzero(again[keep])
        active = active[active < len(sequence) - 1]
    return np.concatenate(pairs), lengths, sequence


def numbers_of(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of every code in the sorted ``known`` ones, -1 if it is not there. Slots by a hash take one look a code where
    a binary search takes many; codes of a slot that several known ones share are searched for."""
    bits = max(12, int(len(known)).bit_length() + 4)
    slot_of = lambda c: ((c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)
    slots = slot_of(known)
    table = np.full(1 << bits, -1, np.int32)
    table[slots] = np.arange(len(known), dtype=np.int32)
    beaten = table[slots] != np.arange(len(known))
    number = table[slot_of(codes)]
    number[known[number] != codes] = -1
    if beaten.any():
        shared = np.zeros(1 << bits, bool)
        shared[slots[beaten]] = True
        again = np.flatnonzero((number < 0) & shared[slot_of(codes)])
        place = np.minimum(np.searchsorted(known, codes[again]), len(known) - 1)
        number[again] = np.where(known[place] == codes[again], place, -1)
    return number


def width(largest: int) -> int:
    """Bytes that numbers up to ``largest`` need."""
    return max(1, (int(largest).bit_length() + 7) // 8)


def narrow(numbers: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4)[:, :size].tobytes()


def widen(data: bytes, at: int, count: int, size: int) -> np.ndarray:
    out = np.zeros((count, 4), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, count * size, at).reshape(-1, size)
    return out.view("<u4").ravel()


def pack_shard(ids: np.ndarray) -> bytes:
    first = int(ids.max()) + 1 if len(ids) else 0
    pairs, lengths, sequence = compress(ids, first)
    ends = np.cumsum(symbol_lengths(lengths, sequence, first))
    positions = np.concatenate([[0], ends])[:-1][::STRIDE] if len(ends) else np.zeros(0, np.int64)
    symbol, length = width(first + len(lengths)), width(lengths.max() if len(lengths) else 0)
    head = b"RPR2" + np.array([first, len(lengths), len(sequence), length], "<u4").tobytes()
    return head + narrow(pairs.ravel(), symbol) + narrow(lengths, length) + narrow(sequence, symbol) + positions.astype("<u8").tobytes()


def symbol_lengths(lengths: np.ndarray, symbols: np.ndarray, first_symbol: int) -> np.ndarray:
    out = np.ones(len(symbols), np.int64)
    rules = symbols >= first_symbol
    out[rules] = lengths[symbols[rules] - first_symbol]
    return out


class Shard:
    """A packed shard: any range of its tokens."""

    def __init__(self, data: bytes):
        if data[:4] != b"RPR2":
            raise ValueError("not a shard of token ids")
        self.first, rules, symbols, length = np.frombuffer(data, "<u4", 4, 4).tolist()
        symbol, at = width(self.first + rules), 20
        self.pairs = widen(data, at, 2 * rules, symbol).reshape(-1, 2)
        self.lengths = widen(data, at := at + 2 * rules * symbol, rules, length)
        self.sequence = widen(data, at := at + rules * length, symbols, symbol)
        self.positions = np.frombuffer(data, "<u8", -1, at + symbols * symbol)
        self.table = None

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of some symbols, from a table of all ids and of all rules written out once."""
        if self.table is None:
            lengths = self.lengths.astype(np.int64)
            places = self.first + np.cumsum(lengths) - lengths
            self.table = np.concatenate([np.arange(self.first, dtype=np.uint32), np.zeros(int(lengths.sum()), np.uint32)])
            all_sizes, all_places = np.concatenate([np.ones(self.first, np.int64), lengths]), np.concatenate([np.arange(self.first), places])
            # Rules are written out when both of their symbols are.
            done = np.concatenate([np.ones(self.first, bool), np.zeros(len(lengths), bool)])
            left = np.arange(len(lengths))
            while len(left):
                ready = done[self.pairs[left]].all(axis=1)
                now, left = left[ready], left[~ready]
                begin = places[now]
                for part in self.pairs[now].T:
                    sizes = all_sizes[part]
                    offset = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    self.table[np.repeat(begin, sizes) + offset] = self.table[np.repeat(all_places[part], sizes) + offset]
                    begin = begin + sizes
                done[self.first + now] = True
            self.sizes, self.places = all_sizes, all_places
        sizes = self.sizes[symbols]
        ends = np.cumsum(sizes)
        return self.table[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.places[symbols] - (ends - sizes), sizes)]

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids at the positions start to stop of the shard, from the symbols that cover them."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        first = (int(np.searchsorted(self.positions, start, side="right")) - 1)
        last = int(np.searchsorted(self.positions, stop, side="left"))
        symbols = self.sequence[first * STRIDE:last * STRIDE]
        begin = int(self.positions[first])
        ends = begin + np.cumsum(symbol_lengths(self.lengths, symbols, self.first))
        low, high = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
        offset = start - (int(ends[low - 1]) if low else begin)
        return self.expand(symbols[low:high])[offset:offset + stop - start]


def _write(path: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = Encoder(path, blanks_kept=False), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        held: list[np.ndarray] = []
        total = 0

        def packed() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in held]).tolist()
            row = {"part": part, "shard": shard, "n_tokens": ends[-1], "doc_ids": doc_ids, "doc_ends": ends, "data": pack_shard(np.concatenate(held))}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([
                ("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                ("doc_ends", pa.list_(pa.int64())), ("data", pa.binary())]))

        for batch in batches:
            ids_of, at = batch.column(0).to_pylist(), 0
            for texts in batches_of(some_at_a_time(batch.column(1))):
                for ids in encoder.encode(texts):
                    held.append(np.append(ids, np.uint32(END_ID)))
                    doc_ids.append(ids_of[at])
                    total, at = total + len(held[-1]), at + 1
                    if total >= SHARD_TOKENS:
                        yield packed()
                        doc_ids, held, total, shard = [], [], 0, shard + 1
        if held:
            yield packed()

    return task


def write(docs: DataFrame, folder: str, tokenizer: str | None = None) -> None:
    """Token files of all documents under ``folder`` (a path that Spark can write)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The second key spreads an id that very many rows share.
    ordered = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(_write(tokenizer or tokenizer_path(TOKENIZER)), SHARDS).write.mode("overwrite").parquet(folder)


def _documents(spark: SparkSession, folder: str, name: str, kind: str, value) -> DataFrame:
    """(doc_id, start, n_tokens, name): ``value(bytes of ids)`` of every document in the files."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["data"])
                raw = memoryview(shard.expand(shard.sequence).astype("<u4").tobytes())
                ends = row["doc_ends"]
                starts = [0, *ends[:-1]]
                columns = ([row["part"]] * len(ends), [row["shard"]] * len(ends), row["doc_ids"], starts, [e - s for s, e in zip(starts, ends)],
                           [value(raw[4 * s:4 * e]) for s, e in zip(starts, ends)])
                found = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
                for at in range(0, len(ends), 2000):  # a batch of decoded documents stays small
                    yield found.slice(at, 2000)

    longs = [pa.field(n, pa.int64()) for n in ("doc_id", "local", "n_tokens")]
    schema = pa.schema([pa.field("part", pa.int32()), pa.field("shard", pa.int32()), *longs, pa.field(name, pa.int64() if kind == "long" else pa.binary())])
    stored = spark.read.schema(SHARDS).parquet(folder)
    docs = stored.mapInArrow(task, f"part int, shard int, doc_id long, local long, n_tokens long, {name} {kind}")
    return docs.join(shard_starts(stored), ["part", "shard"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", name)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ids as little-endian uint32."""
    return _documents(spark, folder, "ids", "binary", bytes)


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    return _documents(spark, folder, "ids_crc32", "long", zlib.crc32)


def shard_starts(stored: DataFrame) -> DataFrame:
    """(part, shard, base): ids before each shard. Sums per part first, so that only one row per part is
    ordered as a whole."""
    shards = stored.select("part", "shard", "n_tokens")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("within"))
            .join(parts, "part").select("part", "shard", (F.col("before") + F.col("within")).alias("base")))
