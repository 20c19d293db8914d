"""Connected components of an edge table, by alternating large-star and small-star steps.

Edges are contracted inside their partitions first (any subset of edges may be replaced by a
star over its own components), which settles every component that lies in one partition; the
star steps connect what is left. Each round is checkpointed to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthomark.session import cut_lineage, spread

CHUNK_EDGES = 500_000


def roots_of(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """Smallest node code of the component of every node."""
    parent = np.arange(count)
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        moving = low != high
        if not moving.any():
            return parent
        np.minimum.at(parent, high[moving], low[moving])
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped


def _star(edges: pd.DataFrame, group: list[str]) -> pd.DataFrame:
    """The same connectivity as a star: every node tied to the smallest node it reaches."""
    nodes = pd.concat([edges[[*group, "a"]].rename(columns={"a": "n"}), edges[[*group, "b"]].rename(columns={"b": "n"})])
    codes, unique = nodes.groupby([*group, "n"], sort=True).ngroup().to_numpy(), nodes.drop_duplicates().sort_values([*group, "n"])
    half = len(edges)
    root = roots_of(codes[:half], codes[half:], len(unique))
    star = unique.rename(columns={"n": "a"}).reset_index(drop=True)
    star["b"] = star["a"].to_numpy()[root]
    return star[star["a"] != star["b"]]


def connected_components(edges: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, node, component) for every node with an edge; component = smallest node id.

    ``edges`` has the group columns and two long node ids ``a``, ``b``, unique within a group.
    """
    group = list(group)
    base = edges.select(*group, F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    schema = base.schema

    def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= CHUNK_EDGES:
                star = _star(pd.concat(held), group)
                if len(star) >= CHUNK_EDGES // 2:  # hardly shrinks: pass it on, memory stays bounded
                    yield star
                    held, size = [], 0
                else:
                    held, size = [star], len(star)
        if held and size:
            yield _star(pd.concat(held), group)

    # Blocks of the group's node range keep a huge group spread over many tasks. Ids hold a row or window
    # in their high half and a column or instance in the low one; both are cut.
    blocks = (F.shiftright("a", 40), F.shiftright(F.col("a").bitwiseAND(0xFFFFFFFF), 12))
    current = cut_lineage(spread(base, *group, *blocks).mapInPandas(contract, schema))
    while True:
        # Settled once it is a star forest: no node hangs on two roots, no root hangs on another.
        roots = current.select(*group, F.col("b").alias("a")).distinct()
        twice = current.groupBy(*group, "a").count().filter("count > 1").select(*group, "a")
        if twice.unionByName(current.select(*group, "a").hint("merge").join(roots, [*group, "a"], "left_semi")).isEmpty():
            break
        both = current.select(*group, "a", "b").unionByName(current.select(*group, F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy(*group, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.filter("b > a").hint("merge").join(smallest, [*group, "a"])
                 .select(*group, F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        down = large.groupBy(*group, "a").agg(F.min("b").alias("m"))
        small = (large.hint("merge").join(down, [*group, "a"]).select(*group, F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select(*group, "e.a", "e.b").filter("a <> b").distinct())
        current = cut_lineage(small)
    members = current.select(*group, F.col("a").alias("node"), F.col("b").alias("component"))
    heads = current.select(*group, F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(heads)
