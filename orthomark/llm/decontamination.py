"""Benchmark decontamination by a broadcast hash set of test windows.

A window is a run of ``size`` words of a benchmark item (all words of a shorter item). The
windows are hashed and broadcast in blocks of at most ``MAX_WINDOWS``; every task slides over the
word codes of its documents, asks the set, compares the words of each hit, and marks them.
Documents are never shuffled. A benchmark of several blocks takes one scan each, with the
documents written between two scans, so that memory stays that of one block.

Defined results: a null or wordless text has no words and no hits; an item without an id or
without words is left out; repeated documents are judged one by one; result columns replace
input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthomark.llm import words as W
from orthomark.llm.own_columns import set_aside
from orthomark.session import cut_lineage

WINDOW = 13
#: Windows of one broadcast: about 150 bytes each, 300 MB at most.
MAX_WINDOWS = 500_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BITS = 20

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.LongType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, window): the distinct windows of every item, words joined by a space."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    words = (benchmark.filter("item_id is not null")
             .select(F.col("item_id").cast("long"), F.regexp_extract_all(F.translate("text", upper, lower), F.lit(WORD), F.lit(0)).alias("words"))
             .filter(F.size("words") > 0))
    first = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))).alias("first")
    return words.select("item_id", "words", first).select("item_id", F.array_join(F.slice("words", F.col("first"), size), " ").alias("window")).distinct()


class WindowSet:
    """Sorted window codes of each length, a bit map before them, and the words behind each code."""

    def __init__(self, rows):
        self.items: dict[bytes, list[int]] = {}
        for item, window in rows:
            self.items.setdefault(window.encode(), []).append(item)
        by_length: dict[int, dict[int, list[bytes]]] = {}
        for window in self.items:
            raw = np.frombuffer(window, np.uint8)
            found = W.Words(raw, np.array([0, len(raw)]), W.ALNUM)
            length = len(found.codes)
            code = int(W.windows(found.codes, found.text, length)[0][0])
            by_length.setdefault(length, {}).setdefault(code, []).append(window)
        self.lengths = {}
        for length, table in by_length.items():
            codes = np.array(sorted(table), np.uint64)
            bits = np.zeros(1 << BITS, bool)
            bits[(codes >> np.uint64(64 - BITS)).astype(np.int64)] = True
            self.lengths[length] = (codes, bits, table)

    def hits(self, words: W.Words) -> Iterator[tuple[int, int, bytes]]:
        """(first word, length, window) of every verified occurrence."""
        for length, (codes, bits, table) in self.lengths.items():
            found, first = W.windows(words.codes, words.text, length)
            maybe = np.flatnonzero(bits[(found >> np.uint64(64 - BITS)).astype(np.int64)])
            place = np.minimum(np.searchsorted(codes, found[maybe]), len(codes) - 1)
            for i in maybe[codes[place] == found[maybe]]:
                at = int(first[i])
                run = words.data[words.starts[at]:words.ends[at + length - 1]].tobytes()
                text = b" ".join(w for w in run.split(b"\0") if w)
                for window in table[int(found[i])]:
                    if window == text:
                        yield at, length, window


def _scan_texts(texts: pa.Array, earlier: list | None, windows: WindowSet) -> Iterator[dict]:
    for at, to, words in W.word_steps(texts, W.ALNUM):
        change = np.zeros(len(words.codes) + 1, np.int32)
        items: dict[int, set[int]] = {}
        for first, length, window in windows.hits(words):
            change[first] += 1
            change[first + length] -= 1
            items.setdefault(int(words.text[first]), set()).update(windows.items[window])
        hit = np.cumsum(change[:-1]) > 0
        firsts = np.concatenate([[0], np.cumsum(words.counts)])
        for k in range(to - at):
            own = slice(firsts[k], firsts[k + 1])
            before = earlier[at + k] if earlier is not None else None
            found = {"n_words": int(words.counts[k]), "n_hit": 0, "items": sorted(items.get(k, ())), "spans": []}
            if k in items or before and before["spans"]:
                base, end = int(words.bounds[k]), int(words.bounds[k + 1])
                point = np.concatenate([[0], np.cumsum((words.data[base:end] & 0xC0) != 0x80)])
                starts, ends = point[words.starts[own] - base], point[words.ends[own] - base]
                marked = hit[own].copy()
                if before:
                    found["items"] = sorted({*found["items"], *before["items"]})
                    for s in before["spans"]:
                        marked |= (starts >= s["start"]) & (ends <= s["end"])
                edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
                found["n_hit"] = int(marked.sum())
                found["spans"] = [{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in zip(edge[0::2], edge[1::2])]
            yield found


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids found, ascending) and spans (runs of hit words, in
    code points, end exclusive)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    table = cut_lineage(benchmark_windows(benchmark, size))
    blocks = max(1, -(-table.count() // max_windows))
    names = {f.name for f in RESULT}
    kept = [f for f in docs.schema if f.name not in names]
    result = to_arrow_schema(RESULT)
    out = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    spark = docs.sparkSession
    for block in range(blocks):
        rows = table.filter(F.pmod(F.hash("window", "item_id"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(WindowSet([(r.item_id, r.window) for r in rows]))
        again = block > 0
        if again:
            out = cut_lineage(out)

        def task(batches: Iterator[pa.RecordBatch], shared=shared, again=again) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                earlier = batch.select(["items", "spans"]).to_pylist() if again else None
                found = pa.RecordBatch.from_pylist(list(_scan_texts(batch.column("text"), earlier, shared.value)), schema=result)
                own = [n for n in batch.schema.names if n not in names]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in own], *found.columns], names=[*own, *result.names])

        out = out.mapInArrow(task, T.StructType([*kept, *RESULT]))
    return out


def contaminated(n_hit="n_hit", n_words="n_words"):
    """At least one hit word and at least one in twenty."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents that are not contaminated, as they are."""
    return set_aside(docs, [f.name for f in RESULT], lambda d: scan(d, benchmark, **options).filter(~contaminated()))


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """All documents, hit spans cut out of their texts."""
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.char_length("text").cast("long")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    cut = F.when(F.size("spans") > 0, F.array_join(pieces, "")).otherwise(F.col("text"))
    return set_aside(docs, [f.name for f in RESULT], lambda d: scan(d, benchmark, **options).withColumn("text", cut))
