"""Merkle manifest of a dataset: a digest of every row, one tree per group, one root, and proofs.

Every row is a leaf. The leaves of a group stand in a given order; every ``FANOUT`` consecutive
nodes become the digest of their hex texts until one is left, the group's subroot, and the
subroots in the order of their groups become the root likewise. A node alone in its level is kept
as it is; a last run may have fewer nodes, even one.

``LEVELS`` levels above the leaves make a superblock, ``FANOUT ** LEVELS`` leaves of one group.
Leaves are numbered over range partitions, so a group of any size is cut into superblocks. Each
superblock is reduced to one node; the few nodes above are reduced and handed down level by level
by joins of a parent with its at most ``FANOUT`` children, which no group can make hot. The outer
nodes that a superblock requires then meet its leaves in a cogroup, where the local levels are
reduced, proofs are completed and leaves are folded up to the root. Only digests are moved.

Null groups come first, null order values too. Rows that repeat are leaves of their own, side by
side. Rows of equal order values stand by their digest. No rows give no result. Columns other
than those named are not read; names that begin with an underscore are the operator's own.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthomark.operators.ordering import running_totals
from orthomark.session import cut_lineage, scratch_folder

FANOUT = 16
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(fields: Sequence[str | Column] = FIELDS) -> Column:
    """Hex sha256 of the fields one after the other: ``-`` if null, else byte count, colon, value."""
    parts = []
    for field in fields:
        value = (F.col(field) if isinstance(field, str) else field).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def parent(nodes: Sequence[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def levels_above(nodes: Sequence[str], most: int, whole: bool) -> list[list[str]]:
    """The levels over consecutive nodes, themselves included: ``most`` more of them, or up to a
    single node where they are the whole of their group."""
    levels = [list(nodes)]
    while len(levels) <= most and not (whole and len(levels[-1]) == 1):
        last = levels[-1]
        levels.append([parent(last[k:k + FANOUT]) for k in range(0, len(last), FANOUT)])
    return levels


def local_levels(leaves: pd.DataFrame, block: int, levels: int) -> list[list[str]]:
    """Levels of one superblock; only the first, if it is not full, can be the whole of its group."""
    return levels_above([digest.hex() for digest in leaves["_leaf"]], levels, block == 0 and len(leaves) < FANOUT ** levels)


def superblocks(frame: pd.DataFrame):
    """(group, leaves in order) for every superblock of a bin."""
    return frame.sort_values(["_group", "_at"], kind="stable").groupby("_group", sort=False)


def _binned(df: DataFrame, bins: int, block) -> DataFrame:
    """Superblocks of one number share a bin if their groups' hashes do, which spares small groups a call each."""
    return df.withColumn("_bin", F.pmod(F.xxhash64("_group"), F.lit(bins))).withColumn("_block", block)


def _levels_over(count: int) -> int:
    levels = 0
    while count > 1:
        count, levels = -(-count // FANOUT), levels + 1
    return levels


def climb(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Runs of every level over (_group, _pos, _node), lowest first, and the nodes on top."""
    runs = []
    for _ in range(levels):
        grouped = nodes.groupBy("_group", F.floor(F.col("_pos") / FANOUT).cast("long").alias("_run")).agg(
            F.sort_array(F.collect_list(F.struct("_pos", "_node"))).alias("_children"))  # at most FANOUT
        grouped = cut_lineage(grouped.withColumn("_made", (F.col("_run") > 0) | (F.size("_children") > 1)))
        runs.append(grouped)
        made = F.sha2(F.array_join("_children._node", ""), 256)
        nodes = grouped.select("_group", F.col("_run").alias("_pos"), F.when(F.col("_made"), made).otherwise(F.col("_children")[0]["_node"]).alias("_node"))
    return runs, nodes


def descend(runs: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Siblings from each lowest node to the top; ``paths`` holds (_group, _pos, _path, ...) of the nodes on top."""
    carried = [c for c in paths.columns if c not in ("_group", "_pos", "_path")]
    for level in reversed(runs):
        met = level.join(paths.withColumnRenamed("_pos", "_run"), ["_group", "_run"])
        each = met.select("_group", "_path", "_made", "_children", *carried, F.posexplode("_children").alias("_k", "_child"))
        nodes = F.col("_children._node")
        own = F.struct(F.array_join(F.slice(nodes, F.lit(1), F.col("_k")), "").alias("left"),
                       F.array_join(F.slice(nodes, F.col("_k") + 2, F.lit(FANOUT)), "").alias("right"))
        path = F.when(F.col("_made"), F.concat(F.array(own), "_path")).otherwise(F.col("_path"))
        paths = each.select("_group", F.col("_child._pos").alias("_pos"), path.alias("_path"), *carried)
    return paths


PATH = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def _reduce(levels: int):
    def task(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = [(group, int(key[1]), local_levels(leaves, int(key[1]), levels)[-1][0]) for group, leaves in superblocks(frame)]
        return pd.DataFrame(rows, columns=["_group", "_pos", "_node"])

    return task


def _finish(levels: int, order: Sequence[str], with_proofs: bool):
    columns = [*order, "leaf", "subroot", "root", "proof_sha256", "folded_root", *(["proof"] if with_proofs else [])]

    def task(key: tuple, frame: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        required = {group: found for group, *found in zip(outer["_group"], outer["_path"], outer["subroot"], outer["root"])}
        out: list[pd.DataFrame] = []
        for group, leaves in superblocks(frame):
            path, subroot, root = required[group]
            above = [(step["left"], step["right"]) for step in path]
            tail = "".join(left + right for left, right in above).encode()
            local = local_levels(leaves, int(key[1]), levels)
            proofs, folded, listed = [], [], []
            for at, (digest, presented) in enumerate(zip(leaves["_leaf"], leaves["_presented"])):
                steps, siblings, place = [], [], at
                for nodes in local[:-1]:
                    first = place - place % FANOUT
                    left, right = "".join(nodes[first:place]), "".join(nodes[place + 1:first + FANOUT])
                    steps.append((left, right))
                    siblings += (left, right)
                    place //= FANOUT
                proof = sha256("".join(siblings).encode())
                proof.update(tail)
                proofs.append(proof.hexdigest())
                current = (digest if presented is None else presented).hex()
                for left, right in steps:
                    current = sha256((left + current + right).encode()).hexdigest()
                for left, right in above:
                    current = sha256((left + current + right).encode()).hexdigest()
                folded.append(current)
                if with_proofs:
                    listed.append([{"left": left, "right": right} for left, right in (*steps, *above)])
            found = leaves[list(order)].copy()
            found["leaf"], found["subroot"], found["root"] = local[0], subroot, root
            found["proof_sha256"], found["folded_root"] = proofs, folded
            if with_proofs:
                found["proof"] = listed
            out.append(found)
        return pd.concat(out, ignore_index=True)[columns] if out else pd.DataFrame({c: [] for c in columns})

    return task


def _numbered(rows: DataFrame, group: str, order: Sequence[str], leaf: Column, presented: Column | None) -> DataFrame:
    """Leaves as bytes with their place in their group; written, as all else is derived from them."""
    spark = rows.sparkSession
    own = F.unhex(leaf)
    other = F.lit(None).cast("binary") if presented is None else F.unhex(presented)
    chosen = rows.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("_group"),
                         *[F.col(c) for c in order], own.alias("_leaf"), other.alias("_presented"))
    folder = scratch_folder(spark, "leaves")
    # The number of a written row tells rows apart that are the same in everything, so that they spread over partitions.
    chosen.withColumn("_row", F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")
    written = spark.read.parquet(f"{folder}/rows")
    placed = running_totals(written, ["_group"], [*[F.col(c).asc_nulls_first() for c in order], F.col("_leaf"), F.col("_row")], {"_n": F.lit(1).cast("long")})
    # Order values travel as text through pandas, which has no whole numbers with nulls.
    placed.select("_group", *[F.col(c).cast("string").alias(c) for c in order], "_leaf", "_presented", (F.col("_n") - 1).alias("_at")).write.parquet(f"{folder}/placed")
    return spark.read.parquet(f"{folder}/placed")


def _forest(leaves: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame, DataFrame, int]:
    """Runs above the superblocks; (_group, subroot, root, _path from subroot to root) of every group; the leaves in bins; the number of bins."""
    size = FANOUT ** levels
    count, last = leaves.agg(F.count("*"), F.max("_at")).first()
    bins = max(1, -(-count // size))
    binned = _binned(leaves, bins, F.floor(F.col("_at") / size).cast("long"))
    nodes = binned.select("_bin", "_block", "_group", "_at", "_leaf").groupBy("_bin", "_block").applyInPandas(
        _reduce(levels), "_group string, _pos long, _node string")
    runs, tops = climb(cut_lineage(nodes), _levels_over((last or 0) // size + 1))
    placed = cut_lineage(running_totals(tops.select(F.col("_group").alias("_name"), "_node"), [], [F.col("_name")], {"_n": F.lit(1).cast("long")})
                         .select("_name", F.col("_node").alias("subroot"), (F.col("_n") - 1).alias("_pos")))
    top_runs, root = climb(placed.select(F.lit("").alias("_group"), "_pos", F.col("subroot").alias("_node")), _levels_over(placed.count()))
    paths = descend(top_runs, root.select("_group", "_pos", F.array().cast(PATH).alias("_path"), F.col("_node").alias("root")))
    groups = paths.drop("_group").join(placed, "_pos").select(F.col("_name").alias("_group"), "subroot", "root", "_path")
    return runs, groups, binned, bins


def proofs(rows: DataFrame, group: str, order: Sequence[str], leaf: Column | None = None, presented: Column | None = None,
           with_proofs: bool = False, levels: int | None = None) -> DataFrame:
    """One row per row of ``rows``: its order columns, leaf, subroot, root, proof_sha256 (digest of the siblings,
    left to right, level by level), folded_root, and with ``with_proofs`` the siblings themselves.

    ``leaf`` is the hex digest of a row. Where ``presented`` is not null, that digest is folded with
    the siblings in place of the leaf, as a verifier would who was handed an altered row."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    levels = LEVELS if levels is None else levels
    runs, groups, leaves, bins = _forest(_numbered(rows, group, order, leaf_digest() if leaf is None else leaf, presented), levels)
    outer = descend(runs, groups.withColumn("_pos", F.lit(0).cast("long")))
    outer = _binned(outer, bins, F.col("_pos"))
    schema = ", ".join([*[f"`{c}` string" for c in order], "leaf string, subroot string, root string, proof_sha256 string, folded_root string",
                        *(["proof array<struct<left string, right string>>"] if with_proofs else [])])
    found = leaves.groupBy("_bin", "_block").cogroup(outer.groupBy("_bin", "_block")).applyInPandas(_finish(levels, order, with_proofs), schema)
    return found.select(*[F.col(c).cast(kinds[c]).alias(c) for c in order], *[c for c in found.columns if c not in order])


def roots(rows: DataFrame, group: str, order: Sequence[str], leaf: Column | None = None, levels: int | None = None) -> DataFrame:
    """The manifest itself: one row per group with its name, number of leaves, subroot and the root."""
    leaves = _numbered(rows, group, order, leaf_digest() if leaf is None else leaf, None)
    _, groups, _, _ = _forest(leaves, LEVELS if levels is None else levels)
    sizes = leaves.groupBy("_group").agg(F.count("*").alias("n_leaves"))
    return groups.join(sizes, "_group").select(F.when(F.col("_group") != "", F.substring("_group", 2, 1 << 30)).alias(group), "n_leaves", "subroot", "root")
