"""Near-duplicates by b-bit MinHash.

1. Every text becomes the set of its 5-word shingles (a shorter text: its whole word sequence).
   ``HASHES`` minima are taken; ``BANDS`` hashes of ``ROWS`` minima each are the band keys, and the
   lowest ``BITS`` bits of every minimum are packed into a short signature.
2. Copies with equal sets become one representative (partial aggregation by a 128-bit digest).
3. Each band bucket ties its representatives to its smallest one, so that candidates form
   clusters; no pair inside a bucket is written. A pair at the threshold .85 shares no bucket
   with a chance of (1 - .85^5)^36 < 1e-9 (at .8: < 1e-6).
4. Clusters are compared inside tasks: in tiles of at most ``TILE`` x ``TILE`` representatives, a large
   cluster in as many tiles as it needs. Bit counts of the packed signatures estimate the
   similarity, corrected for chance agreement; pairs that are not yet connected and whose
   estimate is within five standard errors of the threshold are confirmed on the full sets, and
   a spanning forest of the confirmed links is returned: at most one row per representative.
5. Components of the forest carry their smallest document id back to all copies.

Defined results: empty, null or wordless texts have no shingles and are linked with nothing;
rows without an id are returned unlinked and kept; rows repeated with one id are kept alike;
result columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthomark.llm import words as W
from orthomark.operators.components import connected_components
from orthomark.operators.walk import arranged, whole_groups
from orthomark.session import cut_lineage

SHINGLE, ROWS, BANDS, BITS = 5, 5, 36, 2
HASHES = ROWS * BANDS
LINK = (85, 100)
TILE = 1536
SALTS = 32
#: Estimates this much under the threshold are still confirmed: five standard errors of the estimator.
MARGIN = 0.16

SKETCH = "doc_id long, n_shingles long, digest binary, bands array<long>, signature binary"


def _hash_family() -> tuple[np.ndarray, np.ndarray]:
    seeds = W.mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    low = (seeds & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return low[:HASHES], low[HASHES:] | np.uint32(1)


def shingle_sets(words: W.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle codes of all texts, ascending inside a text, and the bounds of the texts."""
    codes, first = W.windows(words.codes, words.text, size)
    owner = words.text[first]
    for k in np.flatnonzero((words.counts > 0) & (words.counts < size)):
        own = words.text == k
        code, _ = W.windows(words.codes[own], words.text[own], int(words.counts[k]))
        codes, owner = np.append(codes, code), np.append(owner, k)
    order = np.lexsort((codes, owner))
    codes, owner = codes[order], owner[order]
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    codes, owner = codes[fresh], owner[fresh]
    return codes, np.searchsorted(owner, np.arange(len(words.counts) + 1))


def minima(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(HASHES, texts) minima; texts without shingles are not asked for."""
    shifts, factors = _hash_family()
    folded = (codes >> np.uint64(32)).astype(np.uint32)
    out = np.full((HASHES, len(bounds) - 1), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    at = 0
    while at < len(some):  # pieces that stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(bounds[some], bounds[some[at]] + 32_768, side="right")) - 1)
        to = min(to, len(some))
        own = some[at:to]
        piece = folded[bounds[own[0]]:bounds[own[-1] + 1]]
        cuts = bounds[own] - bounds[own[0]]
        for h in range(HASHES):
            out[h, own] = np.minimum.reduceat((piece ^ shifts[h]) * factors[h], cuts)
        at = to
    return out


def _pack(values: np.ndarray) -> np.ndarray:
    """(texts, words64): the lowest BITS bits of every minimum."""
    low = (values.T & ((1 << BITS) - 1)).astype(np.uint64)
    per = 64 // BITS
    padded = np.zeros((low.shape[0], -(-HASHES // per) * per), np.uint64)
    padded[:, :HASHES] = low
    shift = (np.arange(per, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(padded.reshape(low.shape[0], -1, per) << shift, axis=2)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity from agreeing minima, corrected for minima that agree by chance."""
    apart = one ^ many
    pairs = apart | (apart >> np.uint64(1))
    pairs &= np.uint64(0x5555555555555555)
    agree = 1 - np.bitwise_count(pairs).sum(axis=-1) / HASHES
    chance = 2.0 ** -BITS
    return (agree - chance) / (1 - chance)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for at, to, words in W.word_steps(batch.column(1), W.SPACED):
            codes, bounds = shingle_sets(words)
            sizes = np.diff(bounds)
            values = minima(codes, bounds)
            # Each band key also carries the number of the band.
            keys = np.zeros((BANDS, to - at), np.uint64)
            for r in range(ROWS):
                keys = W.mix(keys + values[r::ROWS].astype(np.uint64) + np.uint64(1))
            keys = W.mix(keys + np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15))
            packed = _pack(values)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(codes ^ np.uint64(s)))]) for s in (0x5BD1E995, 0xC2B2AE35)]
            digests = np.stack([s[bounds[1:]] - s[bounds[:-1]] for s in sums] + [sizes.astype(np.uint64)], axis=1)
            full = sizes > 0
            yield pa.RecordBatch.from_arrays([
                ids.slice(at, to - at), pa.array(sizes.astype(np.int64)),
                pa.array([d.tobytes() if f else None for d, f in zip(digests, full)], pa.binary()),
                pa.ListArray.from_arrays(np.arange(to - at + 1, dtype=np.int32) * BANDS, keys.T.astype(np.int64).ravel()),
                pa.array([p.tobytes() for p in packed], pa.binary())],
                names=["doc_id", "n_shingles", "digest", "bands", "signature"])


def confirm(codes: np.ndarray, bounds: np.ndarray, packed: np.ndarray, left: np.ndarray, right: np.ndarray,
            link: tuple[int, int] = LINK) -> list[tuple[int, int]]:
    """A spanning forest of the links between members of ``left`` and ``right`` (positions)."""
    parent = np.arange(len(bounds) - 1)
    cut = link[0] / link[1] - MARGIN
    sizes = np.diff(bounds)
    _, local = np.unique(codes, return_inverse=True)
    mark = np.zeros(int(local.max()) + 1 if len(local) else 1, bool)
    found = []
    same = left is right
    for k, i in enumerate(left):
        others = right[k + 1:] if same else right
        # Sizes alone rule out a link where the smaller set is under the threshold of the larger.
        fits = np.minimum(sizes[i], sizes[others]) * link[1] >= np.maximum(sizes[i], sizes[others]) * link[0]
        others = others[fits & (parent[others] != parent[i])]
        if len(others):
            others = others[estimate(packed[i], packed[others]) >= cut]
        if not len(others):
            continue
        own = local[bounds[i]:bounds[i + 1]]
        mark[own] = True
        lengths = sizes[others]
        cuts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        where = np.repeat(bounds[others] - cuts, lengths) + np.arange(lengths.sum())
        common = np.add.reduceat(mark[local[where]].astype(np.int64), cuts)
        mark[own] = False
        for j in others[common * link[1] >= link[0] * (lengths + sizes[i] - common)]:
            if parent[j] != parent[i]:
                parent[parent == max(parent[i], parent[j])] = min(parent[i], parent[j])
                found.append((int(i), int(j)))
    return found


def _compare(link: tuple[int, int]):
    """Rows of whole tiles (cluster, i, j, part, node, signature, text) to confirmed links (a, b)."""
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(batches, ["cluster", "i", "j"]):
            sets, at, total = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
            for _, _, words in W.word_steps(pa.array(frame["text"], pa.large_string()), W.SPACED):
                codes, bounds = shingle_sets(words)
                sets.append(codes)
                at.append(bounds[1:] + total)
                total += int(bounds[-1])
            codes, bounds = np.concatenate(sets), np.concatenate(at)
            packed = np.frombuffer(b"".join(frame["signature"]), np.uint64).reshape(len(frame), -1)
            nodes, parts, ones, others = (frame[c].to_numpy() for c in ("node", "part", "i", "j"))
            out = []
            for s, e in zip(starts[:-1], starts[1:]):
                if ones[s] == others[s]:
                    left = right = np.arange(e - s)
                else:
                    left, right = np.flatnonzero(parts[s:e] == ones[s]), np.flatnonzero(parts[s:e] == others[s])
                forest = confirm(codes[bounds[s]:bounds[e]], bounds[s:e + 1] - bounds[s], packed[s:e], left, right, link)
                out.extend((nodes[s + x], nodes[s + y]) for x, y in forest)
            if out:
                yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return task


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest, band keys and packed signature of every document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sketch, SKETCH)


def links(docs: DataFrame, classes: DataFrame, link: tuple[int, int] = LINK) -> DataFrame:
    """Confirmed links (a, b) between class representatives: a spanning forest of each tile."""
    rows = classes.select(F.col("rep").alias("node"), F.explode("bands").alias("key"))
    hubs = rows.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("key", "hub")
    edges = rows.join(hubs, "key").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = cut_lineage(connected_components(edges, []).withColumnRenamed("component", "cluster"))
    # Members of a large cluster meet its size in SALTS places, so that none of them gets all.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")).filter("parts > 1").select("cluster", "parts", salts)
    place = F.xxhash64("node")
    placed = (clusters.withColumn("salt", F.pmod(place, F.lit(SALTS)).cast("int")).join(sizes, ["cluster", "salt"], "left")
              .withColumn("parts", F.coalesce("parts", F.lit(1)))
              .withColumn("part", F.pmod(F.shiftright(place, 8), F.col("parts")).cast("int")).drop("salt")
              .join(classes.select(F.col("rep").alias("node"), "signature", "digest"), "node"))
    # A member meets its own part once and every other part in one tile; i <= j.
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).filter("node is not null")
    tiles = (placed.join(texts, "node").dropDuplicates(["node"]).select("cluster", "part", "node", "signature", "text", other)
             .select("cluster", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "signature", "text"))
    return cut_lineage(arranged(tiles, ["cluster", "i", "j"], [F.col("node")]).mapInPandas(_compare(link), "a long, b long"))


def near_duplicates(docs: DataFrame, link: tuple[int, int] = LINK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text). Documents are linked
    with link[1] * intersection >= link[0] * union, a share of .8 or more (the bands are made for that)."""
    sketched = cut_lineage(sketches(docs))
    classes = cut_lineage(
        sketched.filter("digest is not null and doc_id is not null").groupBy("digest")
        .agg(F.min(F.struct("doc_id", "bands", "signature")).alias("s"))
        .select("digest", F.col("s.doc_id").alias("rep"), "s.bands", "s.signature"))
    forest = links(docs, classes, link)
    components = connected_components(forest, []).select(F.col("node").alias("rep"), F.col("component"))
    member = (classes.select("digest", "rep").join(components, "rep", "left")
              .select("digest", F.coalesce("component", "rep").alias("component")))
    found = sketched.select("doc_id", "n_shingles", "digest").join(member, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, link: tuple[int, int] = LINK) -> DataFrame:
    """One document of every group of near-duplicates, as it is: the one with the smallest id."""
    gone = near_duplicates(docs, link).filter("not kept").select("doc_id")
    return docs.hint("merge").join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

