"""Nearest-neighbour matching of image descriptors within scene pairs.

Every pair is cut into blocks of at most about ``block`` descriptors on each side; a task sees
one block against one block and returns the two best per descriptor, so no pair table is ever
written and a huge scene pair spreads over many tasks. The two best of all blocks follow by
one small aggregation. Exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomark.session import spread


def sign_code(vector) -> Column:
    """64-bit words with a bit per positive element, one word for every 64 elements begun."""
    v = F.col(vector) if isinstance(vector, str) else vector
    firsts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(64))
    return F.transform(firsts, lambda first: F.aggregate(F.slice(v, first, F.lit(64)), F.lit(0).cast("long"),
                                                         lambda word, x: F.shiftleft(word, 1).bitwiseOR((x > 0).cast("long"))))


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "hamming":
        return sum(np.bitwise_count(a[:, None, w] ^ b[None, :, w]).astype(np.int64) for w in range(a.shape[1]))
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def match_descriptors(before: DataFrame, after: DataFrame, ratio: float = 0.72, metric: str = "hamming",
                      pair: str = "pair_id", block: int = 4096) -> DataFrame:
    """Matches whose best distance is below ``ratio`` times the second best.

    Both sides: pair, id and ``code`` (array of 64-bit words) or ``vector`` (array of numbers).
    """
    payload = "code" if metric == "hamming" else "vector"
    dtype = np.uint64 if metric == "hamming" else np.float64

    def blocks(side, name):
        return side.groupBy(pair).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    counts = blocks(before, "_na").join(blocks(after, "_nb"), pair)
    home = F.pmod(F.xxhash64("id"), F.lit(2147483647))
    a = (before.select(pair, "id", payload).hint("merge").join(counts, pair)
         .withColumn("_ca", F.pmod(home, F.col("_na")).cast("int")).withColumn("_cb", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))))
    b = (after.select(pair, "id", payload).hint("merge").join(counts, pair)
         .withColumn("_cb", F.pmod(home, F.col("_nb")).cast("int")).withColumn("_ca", F.explode(F.sequence(F.lit(0), F.col("_na") - 1))))
    keys = [pair, "_ca", "_cb"]
    kind = before.schema[pair].dataType.simpleString()

    def two_best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = [pair, "id_a", "id_b", "d"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        right = right.sort_values("id")
        x = np.array(left[payload].tolist()).astype(np.int64 if metric == "hamming" else dtype).view(dtype)
        y = np.array(right[payload].tolist()).astype(np.int64 if metric == "hamming" else dtype).view(dtype)
        ids, take, found = right["id"].to_numpy(), min(2, len(right)), []
        for at in range(0, len(left), 256):
            d = _distances(x[at:at + 256], y, metric)
            best = np.argsort(d, axis=1, kind="stable")[:, :take]
            found.append(pd.DataFrame({"id_a": np.repeat(left["id"].to_numpy()[at:at + 256], take), "id_b": ids[best].ravel(),
                                       "d": np.take_along_axis(d, best, 1).ravel().astype(float)}))
        out = pd.concat(found)
        out[pair] = left[pair].iloc[0]
        return out[columns]

    a = a.select(*keys, "id", payload)
    b = b.select(*keys, "id", payload).toDF(*keys, "id", payload)
    near = spread(a, *keys).groupBy(*keys).cogroup(spread(b, *keys).groupBy(*keys)).applyInPandas(two_best, f"{pair} {kind}, id_a bigint, id_b bigint, d double")
    best = near.groupBy(pair, "id_a").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id_b"))), 1, 2).alias("n"))
    first, second = F.get("n", F.lit(0)), F.get("n", F.lit(1))
    return best.filter(F.size("n") == 2).select(pair, "id_a", first["id_b"].alias("id_b"), first["d"].alias("d1"), second["d"].alias("d2")).filter(
        F.col("d1") < F.lit(float(ratio)) * F.col("d2"))
