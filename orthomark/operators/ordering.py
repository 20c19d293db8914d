"""Ordered numbering, running totals and latest-row selection that survive one huge group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthomark.session import cut_lineage


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[Column], totals: dict[str, Column]) -> DataFrame:
    """Running sums per group in a given (total) order, spread over range partitions.

    Rows are range-partitioned by group and order, so a group of any size is cut into pieces
    in order. Each piece is summed on its own and lifted by the total of the pieces before it,
    a table with one row per piece. The partitioned rows are checkpointed, as the pieces must
    not move between the two passes.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = cut_lineage(df.repartitionByRange(parts, *[F.col(g) for g in group], *order)
                         .withColumn("_piece", F.spark_partition_id()))
    ahead = (Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    lifts = pieces.groupBy(*group, "_piece").agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in totals.items()])
    lifts = lifts.select(*group, "_piece", *[
        F.coalesce(F.sum(f"_sum_{n}").over(ahead), F.lit(0)).alias(f"_lift_{n}") for n in totals])
    inside = Window.partitionBy("_piece", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = pieces.select("*", *[F.sum(v).over(inside).alias(f"_part_{n}") for n, v in totals.items()])
    joined = summed.hint("merge").join(lifts, [*group, "_piece"])
    return joined.select(*df.columns, *[(F.col(f"_part_{n}") + F.col(f"_lift_{n}")).alias(n) for n in totals])


def number_objects(df: DataFrame, group: Sequence[str] = ("scene_id",), order: Sequence[Column] | None = None,
                   name: str = "object_number") -> DataFrame:
    """1-based running id per run: best score first, ties by window and instance."""
    if order is None:
        order = [F.col("score").desc(), F.col("window_id"), F.col("instance_id")]
    return running_totals(df, group, order, {name: F.lit(1).cast("long")})


def latest_edits(edits: DataFrame, key: Sequence[str] = ("object_id",)) -> DataFrame:
    """The last edit of every object: greatest edited_at, then greatest edit_id."""
    rest = [c for c in edits.columns if c not in key]
    first = ["edited_at", "edit_id"]
    packed = F.max(F.struct(*first, *[c for c in rest if c not in first]))
    return edits.groupBy(*key).agg(packed.alias("_e")).select(*key, *[F.col(f"_e.{c}").alias(c) for c in rest])


def apply_label_edits(features: DataFrame, edits: DataFrame, key: Sequence[str] = ("object_id",)) -> DataFrame:
    """Features with reviewed_label and rejected of their last edit; both may hold earlier
    values, which an object without a new edit keeps."""
    last = latest_edits(edits, key).select(*key, F.col("reviewed_label").alias("_label"), F.col("rejected").alias("_rejected"),
                                           F.lit(True).alias("_edited"))
    joined = features.join(last, list(key), "left")

    def kept(name, kind):
        return F.col(name) if name in features.columns else F.lit(None).cast(kind)

    edited = F.col("_edited").isNotNull()
    return (joined.withColumn("reviewed_label", F.when(edited, F.col("_label")).otherwise(kept("reviewed_label", "string")))
            .withColumn("rejected", F.when(edited, F.col("_rejected")).otherwise(kept("rejected", "boolean")))
            .drop("_label", "_rejected", "_edited"))


def best_epoch(history: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """The first epoch with the strictly smallest validation loss of every run."""
    best = F.min(F.struct("val_loss", "epoch"))
    return history.groupBy(*run).agg(best.alias("b")).select(*run, "b.epoch", "b.val_loss")


def retain_within_budget(files: DataFrame, budget, group: Sequence[str], time: str = "stored_at", size: str = "size_kb",
                         tie: str = "file_id", now=None, ttl_seconds: float | None = None) -> DataFrame:
    """Keep the newest files while their running size stays within the budget.

    Every file is marked ``kept``; with ``now`` and ``ttl_seconds`` also ``served`` (kept and
    not expired)."""
    order = [F.col(time).desc(), F.col(tie).desc()]
    out = running_totals(files, group, order, {"running_size": F.col(size)})
    out = out.withColumn("kept", F.col("running_size") <= F.lit(budget))
    if ttl_seconds is not None:
        age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))
        out = out.withColumn("served", F.col("kept") & (age < F.lit(int(ttl_seconds * 1_000_000))))
    return out
