"""Prefix trie of conversations by collapse of whole sequences.

A sequence is the turns of a conversation in order. Identical conversations are grouped into one
weighted sequence, represented by its smallest conversation, with the list of those that end
there. A sequence that is no proper prefix of another, found by an anti-join, is a leaf. All other
figures are aggregates over the prefixes of the distinct sequences, each counted with its weight.

A prefix is told by its length and by the sums, over its turns, of six words of the sha256 of
(position, turn). Sums can be taken over range partitions in order, so that a conversation of any
length is spread like one of many; partial aggregation meets hot prefixes. Joins along a
conversation are on (conversation, chunk of ``CHUNK`` turns). Children find their parent in a
table that is broadcast for parents of very many children, of which there are at most ``HOT``.

Rows without a conversation take no part. Null roles and texts are empty ones. Turns of equal
number are ordered by role, then by the first 64 characters of their text, then by digest; rows
that repeat are turns of their own. No rows give no nodes. Columns other than the four named are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomark.operators.ordering import running_totals
from orthomark.session import cut_lineage, spread

CHUNK = 4096
WORDS = 6
#: Parents with more children than their number over this, and than LEAST_HOT, are broadcast; so there are at most HOT.
HOT, LEAST_HOT = 50_000, 1_000
#: Conversations in one piece of an end list.
LISTED = 50_000
#: Conversations that may share a base are numbered within one hundred.
GROUP, MOST_SHARED = 100, 6


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, idx from 1, turn's digest, its number of code points) of all turns, in order."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), role.alias("_role"), F.substring(text, 1, 64).alias("_start"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("chars"))
    order = [F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_start"), F.col("digest")]
    return running_totals(turns, ["conv_id"], order, {"idx": F.lit(1).cast("long")}).select("conv_id", "idx", "digest", "chars")


def share_openings(turns: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, digest, chars) of rebuilt conversations, and a row of position 0 for each.

    Conversation c takes the first h = crc32(c) % 6 turns of the first conversation of its hundred,
    then its own after its first h."""
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).cast("long")
    turns = turns.withColumn("_h", shared)
    each = turns.groupBy("conv_id").agg(F.max("idx").alias("_n")).withColumn("_base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("_h", shared)
    opening = turns.where(F.col("idx") < MOST_SHARED).select(F.col("conv_id").alias("_base"), "idx", "digest", "chars")
    # At most 199 conversations share a base, and at most five turns of it are used.
    taken = each.join(opening, "_base").where(F.col("idx") <= F.col("_h")).select("conv_id", F.col("idx").alias("pos"), "digest", "chars")
    lengths = each.select(F.col("conv_id").alias("_base"), F.col("_n").alias("_base_n"))
    late = (each.where(F.col("_n") > F.col("_h")).join(lengths, "_base", "left")
            .withColumn("_late", F.col("_h") - F.least(F.col("_h"), F.coalesce(F.col("_base_n"), F.lit(0)))).where(F.col("_late") > 0)
            .select("conv_id", "_late", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_n") / CHUNK).cast("long"))).alias("_chunk")))
    own = (turns.where(F.col("idx") > F.col("_h")).withColumn("_chunk", F.floor(F.col("idx") / CHUNK).cast("long"))
           .join(late, ["conv_id", "_chunk"], "left")
           .select("conv_id", (F.col("idx") - F.coalesce("_late", F.lit(0))).alias("pos"), "digest", "chars"))
    empty = each.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    return taken.unionByName(own).unionByName(empty)


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat_ws(",", depth, *sums), 256))


def with_keys(rebuilt: DataFrame) -> DataFrame:
    """Rebuilt turns with the keys of the prefix that ends with them and of the one before."""
    hashed = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.hex("digest")), 256)
    rows = rebuilt.withColumn("_hash", hashed)  # null at position 0
    words = {f"_s{k}": F.coalesce(F.conv(F.substring("_hash", 8 * k + 1, 8), 16, 10).cast("long"), F.lit(0)) for k in range(WORDS)}
    rows = rows.select("conv_id", "pos", "chars", *[w.alias(n.replace("_s", "_w")) for n, w in words.items()])
    summed = running_totals(rows, ["conv_id"], [F.col("pos")], {f"_s{k}": F.col(f"_w{k}") for k in range(WORDS)})
    before = [F.col(f"_s{k}") - F.col(f"_w{k}") for k in range(WORDS)]
    return summed.select("conv_id", "pos", "chars", _key(F.col("pos"), [F.col(f"_s{k}") for k in range(WORDS)]).alias("key"),
                         F.when(F.col("pos") > 0, _key(F.col("pos") - 1, before)).alias("parent_key"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one key in order as comma-joined text, LISTED numbers or a batch at most each."""
    schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    for batch in batches:
        keys, ids = batch.column(0), batch.column(1)
        changes = pc.indices_nonzero(pc.not_equal(keys[1:], keys[:-1])).to_pylist() if len(keys) else []
        bounds = [0, *[c + 1 for c in changes], len(keys)] if len(keys) else [0]
        rows = []
        for start, stop in zip(bounds[:-1], bounds[1:]):
            for at in range(start, stop, LISTED):
                own = ids[at:min(at + LISTED, stop)].to_pylist()
                rows.append({"key": keys[at].as_py(), "first": own[0], "ids": ",".join(map(str, own))})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of the pieces of every key, which stand side by side in order; one digest is open at a time."""
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    open_key, state = None, None
    for batch in batches:
        done = []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if key != open_key:
                if state is not None:
                    done.append({"key": open_key, "ends_sha256": state.hexdigest()})
                open_key, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"key": open_key, "ends_sha256": state.hexdigest()}], schema=schema)


def end_lists(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): digest of the ascending comma-joined conversations of every key.

    A list of any length is written piece by piece over range partitions; one task then reads
    the pieces of a key, not its rows."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ends.select("key", "conv_id").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = ordered.mapInArrow(_pieces, "key binary, first long, ids string")
    return spread(pieces, "key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key binary, ends_sha256 string")


def trie(rebuilt: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations given as (conv_id, pos, digest, chars), a row of position 0 for each:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    prefixes = cut_lineage(with_keys(rebuilt))
    ends = prefixes.groupBy("conv_id").agg(F.max(F.struct("pos", "key")).alias("_last")).select("conv_id", F.col("_last.pos").alias("len"), F.col("_last.key").alias("key"))
    ends = cut_lineage(ends)
    sequences = ends.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("len").alias("len"), F.count("*").alias("weight"))

    # Prefixes of the distinct sequences, each with its sequence's weight.
    chunks = sequences.select("conv_id", "len", "weight", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("len") / CHUNK).cast("long"))).alias("_chunk"))
    weighted = cut_lineage(prefixes.withColumn("_chunk", F.floor(F.col("pos") / CHUNK).cast("long")).join(chunks, ["conv_id", "_chunk"]).drop("_chunk"))
    proper = weighted.where(F.col("pos") < F.col("len")).select("key").distinct()
    leaves = sequences.select("key").join(proper, "key", "left_anti").withColumn("_leaf", F.lit(1).cast("long"))

    nodes = weighted.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("pos").alias("depth"), F.sum("weight").alias("n_convs"),
                                        F.max("chars").alias("chars"), F.max("parent_key").alias("parent_key"))
    nodes = cut_lineage(nodes.join(leaves, "key", "left").join(end_lists(ends), "key", "left"))

    # Every node is counted once, along the sequence of its smallest member, for all prefixes of that sequence.
    owned = nodes.select("conv_id", F.col("depth").alias("pos"), ((F.col("n_convs") - 1) * F.col("chars")).alias("_saves"), F.coalesce("_leaf", F.lit(0)).alias("_leaf"))
    along = weighted.select("conv_id", "pos", "key").join(owned, ["conv_id", "pos"], "left").na.fill(0, ["_saves", "_leaf"])
    below = running_totals(along, ["conv_id"], [F.col("pos").desc()], {"_saved": F.col("_saves"), "_leaves": F.col("_leaf")})
    subtrees = below.groupBy("key").agg(F.sum("_saved").alias("saved_tokens"), F.sum("_leaves").alias("n_leaves"))
    children = nodes.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("n_children"))
    whole = cut_lineage(nodes.join(subtrees, "key").join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))

    limit = max(LEAST_HOT, -(-whole.count() // HOT))
    parents = whole.where(F.col("n_children") > 0).select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.broadcast(parents.where(F.col("n_children") > limit).drop("n_children"))
    rows = whole.join(hot, "parent_key", "left")
    found = rows.where(F.col("parent_conv_id").isNotNull() | F.col("parent_key").isNull())
    others = rows.where(F.col("parent_conv_id").isNull() & F.col("parent_key").isNotNull()).drop("parent_conv_id")
    others = others.join(parents.where(F.col("n_children") <= limit).drop("n_children"), "parent_key")
    return found.unionByName(others).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
