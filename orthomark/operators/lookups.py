"""Place search and reuse of earlier responses, as jobs over tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthomark.functions import geo, labels
from orthomark.session import cut_lineage

# Candidates per search and lifetime of a response.
TOP_PLACES = 6
RESPONSE_TTL_SECONDS = 86400
# A word of more places is compared in tiles; so many of them at most, and the sides of a tile.
HOT_WORD, HOT_WORDS = 1000, 512
TILE_SEARCHES, TILE_PLACES, TILE_CHUNKS = 65_536, 262_144, 16
PLACE_SOURCE = "OpenStreetMap via Photon"


def tokens_of(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.filter(F.split(F.lower(t), r"(?U)[^\w]+"), lambda w: w != ""))


def top_places(searches: DataFrame, places: DataFrame, k: int = TOP_PLACES, hot: int = HOT_WORD) -> DataFrame:
    """The best ``k`` places per search: most shared words, then nearest to the view centre, then smallest id.

    ``searches``: search_id, text, cx, cy. ``places``: place_id, text, x, y. Pairs are formed at their
    first shared word that at most ``hot`` places have. Words of more places (the HOT_WORDS most
    frequent ones; the rest stays with the pairs) would bring every search to every place: for these,
    tiles of searches and places are compared by bit masks, and only the best ``k`` of a tile are written.
    A place left out of them has ``k`` others before it whatever else it shares, so the result is exact.
    """
    s = searches.select("search_id", "cx", "cy", tokens_of("text").alias("_qt"))
    p = places.select("place_id", "x", "y", tokens_of("text").alias("_pt"))
    counted = p.select(F.explode("_pt").alias("_w")).groupBy("_w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot)
    frequent = [r["_w"] for r in counted.orderBy(F.col("n").desc(), "_w").limit(HOT_WORDS).collect()]
    known = F.array(*[F.lit(w) for w in frequent]).cast("array<string>")
    s = s.withColumn("_qr", F.array_except("_qt", known)).withColumn("_w", F.explode("_qr"))
    p = p.withColumn("_pr", F.array_except("_pt", known)).withColumn("_w", F.explode("_pr"))
    pairs = s.hint("merge").join(p, "_w").filter(F.array_min(F.array_intersect("_qr", "_pr")) == F.col("_w"))
    distance = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    found = pairs.select("search_id", "place_id", F.size(F.array_intersect("_qt", "_pt")).cast("long").alias("shared_words"), distance.cast("double").alias("distance2"))
    if frequent:
        # Moved once, for the pairs told twice and for the ranks.
        both = found.unionByName(_hot_places(searches, places, known, k)).repartition("search_id")
        found = both.groupBy("search_id", "place_id").agg(F.max("shared_words").alias("shared_words"), F.min("distance2").alias("distance2"))
    order = Window.partitionBy("search_id").orderBy(F.col("shared_words").desc(), "distance2", "place_id")
    return found.withColumn("place_rank", F.row_number().over(order)).filter(F.col("place_rank") <= k)


def _hot_places(searches: DataFrame, places: DataFrame, known: Column, k: int) -> DataFrame:
    """The best k places of every tile for every search, by frequent words alone."""
    numbers = lambda text: F.transform(F.array_intersect(tokens_of(text), known), lambda w: F.array_position(known, w).cast("int") - 1)
    s = searches.select("search_id", F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"), numbers("text").alias("hot")).filter(F.size("hot") > 0)
    p = places.select("place_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), numbers("text").alias("hot")).filter(F.size("hot") > 0)
    groups, chunks = (max(least, -(-side.count() // most)) for side, least, most in ((s, 1, TILE_SEARCHES), (p, TILE_CHUNKS, TILE_PLACES)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = s.select(place("search_id", groups).alias("g"), every(chunks).alias("c"), "search_id", "x", "y", "hot")
    right = p.select(every(groups).alias("g"), place("place_id", chunks).alias("c"), "place_id", "x", "y", "hot")

    def masks(hot: pd.Series) -> np.ndarray:
        out = np.zeros((len(hot), HOT_WORDS // 64), np.uint64)
        rows, bits = np.repeat(np.arange(len(hot)), [len(h) for h in hot]), np.concatenate([np.asarray(h, np.int64) for h in hot])
        np.bitwise_or.at(out, (rows, bits // 64), np.uint64(1) << (bits % 64).astype(np.uint64))
        return out

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows, ids, levels, aways = [], [], [], []
        if len(a) and len(b):
            mine, theirs = masks(a["hot"]), masks(b["hot"])
            b_ids, x, y, cx, cy = b["place_id"].to_numpy(), b["x"].to_numpy(), b["y"].to_numpy(), a["x"].to_numpy(), a["y"].to_numpy()
            kinds, kind_of = np.unique(theirs, axis=0, return_inverse=True)
            along = np.argsort(x, kind="stable")
            x, y, b_ids, kind_of = x[along], y[along], b_ids[along], kind_of.ravel()[along]
            sought, sought_by = np.unique(mine, axis=0, return_inverse=True)
            order = np.argsort(sought_by.ravel(), kind="stable")
            ends = np.append(np.flatnonzero(np.diff(sought_by.ravel()[order])) + 1, len(order))
            # Searches for the same words meet the same places, level by level, sorted along x.
            for words, searches in zip(sought, np.split(order, ends[:-1])):
                shared = np.bitwise_count(kinds & words).sum(axis=1).astype(np.int64)
                wanted, left_over = [], k
                for level in np.unique(shared[shared > 0])[::-1]:
                    at = np.flatnonzero((shared == level)[kind_of])
                    wanted.append((int(level), at, x[at], y[at], left_over))
                    left_over -= min(left_over, len(at))
                    if not left_over:
                        break
                for row in searches:
                    for level, at, xs, ys, most in wanted:
                        near, away = nearest(xs, ys, b_ids[at], cx[row], cy[row], most)
                        rows.append(np.full(len(near), row)), ids.append(b_ids[at[near]]), levels.append(np.full(len(near), level)), aways.append(away)
        whole = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        found = a["search_id"].to_numpy()[whole(rows, np.int64)]
        return pd.DataFrame({"search_id": found, "place_id": whole(ids, np.int64), "shared_words": whole(levels, np.int64), "distance2": whole(aways, float)})

    kinds = [df.schema[c].dataType.simpleString() for df, c in ((searches, "search_id"), (places, "place_id"))]
    return left.groupBy("g", "c").cogroup(right.groupBy("g", "c")).applyInPandas(
        best, f"search_id {kinds[0]}, place_id {kinds[1]}, shared_words bigint, distance2 double")


def nearest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, cx: float, cy: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k places nearest to a point, ties by id, and their squared distances; ``x`` ascends."""
    first, last = 0, len(x)
    away = lambda: (x[first:last] - cx) ** 2 + (y[first:last] - cy) ** 2
    if len(x) > 256 and np.isfinite(cx) and np.isfinite(cy):
        # The k-th of some neighbours along x bounds how far the others can be.
        reach, at = max(64, k, 2 * int(len(x) ** 0.5)), int(np.searchsorted(x, cx))
        first, last = max(0, min(at, len(x) - k) - reach), min(len(x), at + reach)
        bound = np.partition(away(), k - 1)[k - 1]
        first, last = 0, len(x)
        if np.isfinite(bound) and np.isfinite(x[-1]):
            far = np.sqrt(bound) * (1 + 1e-9) + 1e-14 * abs(cx)
            first, last = int(np.searchsorted(x, cx - far)), int(np.searchsorted(x, cx + far, "right"))
    distance = away()
    found = np.arange(len(distance))
    if len(x) > k:
        found = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
    found = found[np.lexsort((ids[first:last][found], distance[found]))][:k]
    return found + first, distance[found]


def normalise_place_records(raw: DataFrame, fetched_at=None) -> DataFrame:
    """Geocoder rows (name, address parts, lon, lat) as search candidates."""
    columns = {c: F.col(c) for c in labels.PLACE_ADDRESS_PARTS if c in raw.columns}
    return (raw.withColumn("address", labels.address_from_place(columns)).withColumn("source", F.lit(PLACE_SOURCE))
            .withColumn("fetched_at", F.lit(fetched_at).cast("string") if fetched_at is not None else F.lit(None).cast("string"))
            .withColumn("match_status", F.lit(labels.SEARCH_CANDIDATE)).withColumn("geohash", geo.geohash_encode("lat", "lon")))


def micros(df: DataFrame, time: str) -> Column:
    """Microseconds since the epoch, free of the session time zone for local timestamps."""
    if isinstance(df.schema[time].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {time})")
    return F.unix_micros(F.col(time).cast("timestamp"))


def answer_in_order(times: np.ndarray, ttl: int, last_fetch: int | None) -> np.ndarray:
    """For requests in time order, the fetch each is answered from (its own time if fetched)."""
    source, at = np.empty(len(times), np.int64), 0
    if last_fetch is not None:
        at = int(np.searchsorted(times, last_fetch + ttl, "left"))
        source[:at] = last_fetch
    while at < len(times):
        until = int(np.searchsorted(times, times[at] + ttl, "left"))
        source[at:until] = times[at]
        at = until
    return source


def chain_steps(times: np.ndarray, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """What a stretch of requests in time order makes of the fetch before it, as steps: if the first
    request that fetches comes at or before ``until[i]`` (and after ``until[i - 1]``), the last fetch of the stretch is ``last[i]``.

    Fetches follow each other like links: the next one after t is the first request at t + ttl or later. Links never
    overtake each other, so those from many entries soon run together and the steps are few."""
    following = np.searchsorted(times, times + ttl, "left")
    ends = following == len(times)
    jump = np.where(ends, np.arange(len(times)), np.minimum(following, len(times) - 1))
    while not ends[jump].all():
        jump = jump[jump]
    # The stretch is entered before a lifetime after its first request is over.
    entries = int(np.searchsorted(times, times[0] + ttl, "left")) + 1
    until, last = times[:entries], times[jump[:entries]]
    final = np.append(last[1:] != last[:-1], True)
    return until[final], last[final]


def fresh_responses(log: DataFrame, ttl_seconds: float = RESPONSE_TTL_SECONDS, key: str = "request_text",
                    time: str = "requested_at", tie: str = "request_id") -> DataFrame:
    """Every request with the fetch that answers it: an earlier one of the same key younger
    than the lifetime (counted from the fetch, not from its last use), else its own.

    Requests are range-partitioned by key and time, so a busy key without any pause is cut into stretches. Only the
    first key of a partition can go on from the one before; what its stretch makes of any fetch before it is
    a small table of steps. Tables are run through in order, a row or two per partition, which tells the fetch that
    enters each partition, and all partitions are then walked at once in constant memory.
    """
    ttl = int(ttl_seconds * 1_000_000)
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = log.select(F.col(tie).alias("_id"), F.col(key).alias("_key"), micros(log, time).alias("_t"))
    # The pieces are used twice and must not move in between.
    rows = cut_lineage(rows.repartitionByRange(parts, "_key", "_t", "_id").sortWithinPartitions("_key", "_t", "_id").withColumn("_piece", F.spark_partition_id()))
    id_type, key_type = (log.schema[c].dataType.simpleString() for c in (tie, key))

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The first and the last key of the partition with the steps of their stretches."""
        held: list[list] = []  # [key, piece, time arrays]
        for batch in batches:
            if batch.empty:
                continue
            keys, times = batch["_key"], batch["_t"].to_numpy()
            starts = np.flatnonzero((keys != keys.shift()).to_numpy() & ~(keys.isna() & keys.shift().isna()).to_numpy() | (np.arange(len(batch)) == 0))
            for at, until in zip(starts, [*starts[1:], len(batch)]):
                own = None if pd.isna(keys.iat[at]) else keys.iat[at]
                if held and held[-1][0] == own:
                    held[-1][2].append(times[at:until])
                else:
                    del held[1:]
                    held.append([own, int(batch["_piece"].iat[0]), [times[at:until]]])
        out = []
        for order, (own, piece, arrays) in enumerate(held):
            until, last = chain_steps(np.unique(np.concatenate(arrays)), ttl)
            out.append((own, piece, order, until, last))
        yield pd.DataFrame(out, columns=["_key", "piece", "place", "until", "last"])

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The fetch before each partition that its first key goes on from."""
        current, fetch, found = (), None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                goes_on = current == (row[0],)
                if row.place == 0 and goes_on:
                    found.append((row.piece, fetch))
                at = int(np.searchsorted(row.until, fetch + ttl, "left")) if goes_on else 0
                # Beyond the last step nothing of this stretch fetches.
                fetch = int(row.last[at]) if at < len(row.last) else fetch
                current = (row[0],)
        yield pd.DataFrame(found, columns=["piece", "fetch"])

    tables = rows.mapInPandas(steps, f"_key {key_type}, piece int, place int, until array<bigint>, last array<bigint>")
    entering = tables.repartition(1).sortWithinPartitions("piece", "place").mapInPandas(compose, "piece int, fetch bigint").collect()  # one row a partition at most
    known = {r["piece"]: r["fetch"] for r in entering}

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        for batch in batches:
            if batch.empty:
                continue
            keys = batch["_key"].astype(object).where(batch["_key"].notna(), None)
            change = np.array([True, *(a != b for a, b in zip(keys.iloc[1:], keys.iloc[:-1]))])
            starts = np.flatnonzero(change)
            times, source = batch["_t"].to_numpy(), np.empty(len(batch), np.int64)
            for at, until in zip(starts, [*starts[1:], len(batch)]):
                owner = (keys.iat[at],)
                if owner != current:
                    last = known.get(int(batch["_piece"].iat[0])) if current is None else None
                    current = owner
                source[at:until] = answer_in_order(times[at:until], ttl, last)
                last = int(source[until - 1])
            yield pd.DataFrame({"request_id": batch["_id"], "request_key": batch["_key"], "age_us": times - source})

    answered = rows.mapInPandas(fold, f"request_id {id_type}, request_key {key_type}, age_us bigint")
    # The earliest request of a fetch instant fetches; one at the same instant is served by it.
    return answered.withColumn("age_seconds", F.col("age_us") / F.lit(1e6)).withColumn("fetched", F.col("age_us") == 0)
