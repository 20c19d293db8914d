"""Mask algebra on run-length rows: group columns, prow, c0, c1 (c1 exclusive)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthomark.operators.components import connected_components
from orthomark.session import cut_lineage, spread, stored

RUN_BLOCK = 256
SCENE = ("scene_id",)


def _long(value) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("long")


def runs_of(pixels: DataFrame, group: Sequence[str] = SCENE) -> DataFrame:
    """Foreground pixels (prow, pcol) -> maximal runs. One image row is one window group."""
    row = Window.partitionBy(*group, "prow").orderBy("pcol")
    start = _long("pcol") - F.row_number().over(row)
    return (pixels.select(*group, "prow", "pcol", start.alias("_s")).groupBy(*group, "prow", "_s")
            .agg(_long(F.min("pcol")).alias("c0"), (_long(F.max("pcol")) + 1).alias("c1"))
            .select(*group, _long("prow").alias("prow"), "c0", "c1"))


def pixels_of(runs: DataFrame, group: Sequence[str] = SCENE) -> DataFrame:
    """Runs that do not overlap -> one row per pixel."""
    return runs.select(*group, "prow", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)).alias("pcol"))


def pieces(layers: dict[str, DataFrame], value, group: Sequence[str] = SCENE) -> DataFrame:
    """Several run tables laid over each other, in one shuffle: group, prow, c0, c1, value.

    Every run opens and closes at its ends; a running sum along the image row tells how many
    runs of each layer are open between two ends. ``value`` maps those counts (a dict of
    columns) to a column; neighbouring pieces of equal value are joined, NULL is left out.
    Layers may overlap themselves.
    """
    group = list(group)
    names = list(layers)
    events = None
    for name, runs in layers.items():
        ends = F.explode(F.array(F.struct(F.col("c0").alias("at"), F.lit(1).alias("d")),
                                 F.struct(F.col("c1").alias("at"), F.lit(-1).alias("d"))))
        part = runs.select(*group, "prow", ends.alias("e")).select(
            *group, "prow", _long("e.at").alias("at"), *[(F.col("e.d") if n == name else F.lit(0)).cast("long").alias(f"_d_{n}") for n in names])
        events = part if events is None else events.unionByName(part)
    # Brought together by image row once; everything below keeps that partitioning.
    events = events.repartition(*group, "prow").groupBy(*group, "prow", "at").agg(*[F.sum(f"_d_{n}").alias(f"_d_{n}") for n in names])
    line = Window.partitionBy(*group, "prow").orderBy("at")
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = events.select(*group, "prow", F.col("at").alias("c0"), F.lead("at").over(line).alias("c1"),
                            *[F.sum(f"_d_{n}").over(upto).alias(n) for n in names])
    counted = counted.withColumn("value", F.when(F.col("c1").isNotNull(), value({n: F.col(n) for n in names}))).drop(*names)
    # A piece goes on from the one before it when both have the same value.
    line = Window.partitionBy(*group, "prow").orderBy("c0")
    fresh = ~F.col("value").eqNullSafe(F.lag("value").over(line))
    numbered = counted.withColumn("_new", fresh.cast("long")).withColumn("_run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return (numbered.filter("value IS NOT NULL").groupBy(*group, "prow", "_run", "value").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1"))
            .select(*group, "prow", "c0", "c1", "value"))


def combine(layers: dict[str, DataFrame], keep, group: Sequence[str] = SCENE) -> DataFrame:
    """Boolean algebra of run tables: the runs where ``keep`` of the layer counts holds."""
    return pieces(layers, lambda n: F.when(keep(n), True), group).drop("value")


def union_masks(runs: DataFrame, group: Sequence[str] = SCENE) -> DataFrame:
    """OR over overlapping runs of several instances or windows.

    The runs of an image row are sorted once. One that starts beyond all before it opens a piece, which ends
    where the runs before the next opening end. Runs that are in place by ``group`` already, or by a part of it, are not moved."""
    group = list(group)
    line = Window.partitionBy(*group, "prow").orderBy("c0", "c1")
    upto = F.max("c1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    whole = F.max("c1").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    known = runs.select(*group, "prow", _long("c0").alias("c0"), _long("c1").alias("c1")).filter("c0 < c1")
    opening = known.withColumns({"_before": upto, "_last": whole}).filter("_before IS NULL OR c0 > _before")
    ends = F.coalesce(F.lead("_before").over(line), F.col("_last"))
    return opening.select(*group, "prow", "c0", ends.alias("c1"))


def difference_masks(a: DataFrame, b: DataFrame, valid: DataFrame, group: Sequence[str] = SCENE) -> DataFrame:
    """a and not b, within the valid runs."""
    return combine({"a": a, "b": b, "valid": valid}, lambda n: (n["a"] > 0) & (n["b"] == 0) & (n["valid"] > 0), group)


def run_overlap(a: DataFrame, b: DataFrame, group: Sequence[str] = SCENE) -> DataFrame:
    """Shared pixels and both areas per group, of two masks without self-overlap."""
    both = combine({"a": a, "b": b}, lambda n: (n["a"] > 0) & (n["b"] > 0), group)
    length = F.col("c1") - F.col("c0")
    zero = F.lit(0).cast("long")
    rows = (both.select(*group, length.alias("shared"), zero.alias("area_a"), zero.alias("area_b"))
            .unionByName(a.select(*group, zero.alias("shared"), length.alias("area_a"), zero.alias("area_b")))
            .unionByName(b.select(*group, zero.alias("shared"), zero.alias("area_a"), length.alias("area_b"))))
    return rows.groupBy(*group).agg(*[F.sum(c).alias(c) for c in ("shared", "area_a", "area_b")])


def dilate(runs: DataFrame, tolerance: int, width, height, group: Sequence[str] = SCENE, merge: bool = True) -> DataFrame:
    """Square (2*tolerance+1) dilation, clipped to the image."""
    if tolerance < 0:
        raise ValueError("edge tolerance must not be negative")
    w, h = (v if isinstance(v, Column) else F.lit(v) for v in (width, height))
    rows = F.sequence(F.greatest(F.col("prow") - tolerance, F.lit(0)), F.least(F.col("prow") + tolerance, h.cast("long") - 1))
    grown = runs.select(*group, F.explode(rows).alias("prow"), F.greatest(F.col("c0") - tolerance, F.lit(0)).cast("long").alias("c0"),
                        F.least(F.col("c1") + tolerance, w.cast("long")).alias("c1"))
    return union_masks(grown, group) if merge and tolerance else grown


def _node() -> Column:
    return F.shiftleft(F.col("prow"), 32) + F.col("c0")


def label_regions(runs: DataFrame, group: Sequence[str] = SCENE, connectivity: int = 8) -> DataFrame:
    """Maximal runs with the region they belong to (its first pixel, row * 2^32 + column)."""
    group = list(group)
    runs = cut_lineage(runs.select(*group, "prow", "c0", "c1"))  # read for the edges and for the result
    reach = 1 if connectivity == 8 else 0
    blocks = F.sequence(F.floor((F.col("c0") - reach) / RUN_BLOCK), F.floor((F.col("c1") - 1 + reach) / RUN_BLOCK))
    keyed = runs.select(*group, "prow", "c0", "c1", _node().alias("node"), F.explode(blocks).alias("_b"))
    above = keyed.select(*group, (F.col("prow") + 1).alias("prow"), F.col("c0").alias("u0"), F.col("c1").alias("u1"),
                         F.col("node").alias("up"), "_b")
    meet = (F.col("c0") < F.col("u1") + reach) & (F.col("u0") < F.col("c1") + reach)
    once = F.floor(F.greatest("c0", "u0") / RUN_BLOCK) == F.col("_b")
    edges = keyed.hint("merge").join(above, [*group, "prow", "_b"]).filter(meet & (once | F.lit(reach == 1))).select(
        *group, F.col("node").alias("a"), F.col("up").alias("b"))
    component = connected_components(edges, group)
    labelled = runs.withColumn("node", _node()).hint("merge").join(component, [*group, "node"], "left")
    return labelled.select(*group, "prow", "c0", "c1", F.coalesce("component", "node").alias("region"))


def remove_small(runs: DataFrame, minimum: int, group: Sequence[str] = SCENE) -> DataFrame:
    """Runs of the 8-connected regions with at least ``minimum`` pixels."""
    group = list(group)
    labelled = label_regions(runs, group, 8)
    large = labelled.groupBy(*group, "region").agg(F.sum(F.col("c1") - F.col("c0")).alias("n")).filter(F.col("n") >= minimum)
    return labelled.hint("merge").join(large.select(*group, "region"), [*group, "region"], "left_semi").select(*group, "prow", "c0", "c1")


def detect_changes(before: DataFrame, after: DataFrame, valid: DataFrame, width, height, tolerance: int = 1,
                   min_pixels: int = 25, group: Sequence[str] = SCENE) -> DataFrame:
    """Runs of candidate changes with their kind: in one mask, away from the other's dilated
    outline, on valid pixels, in regions that are not small."""
    group = list(group)
    grown = lambda runs: dilate(runs, tolerance, width, height, group, merge=False)
    # Both kinds in one pass; a mask lies within its grown form, so a pixel is of one kind at most.
    kinds = pieces({"before": before, "after": after, "near_before": grown(before), "near_after": grown(after), "valid": valid},
                   lambda n: F.when((n["valid"] > 0) & (n["after"] > 0) & (n["near_before"] == 0), "added candidate")
                   .when((n["valid"] > 0) & (n["before"] > 0) & (n["near_after"] == 0), "removed candidate"), group)
    both = kinds.select(*group, F.col("value").alias("change"), "prow", "c0", "c1")
    return remove_small(both, min_pixels, [*group, "change"])


def change_regions(changes: DataFrame, group: Sequence[str] = SCENE) -> DataFrame:
    """One row per 4-connected changed region: the pixel features of a comparison."""
    keys = [*group, "change"]
    return mask_measures(label_regions(changes, keys, 4), [*keys, "region"]).drop("region")


def change_stats(changes: DataFrame, scenes: DataFrame, group: Sequence[str] = SCENE) -> DataFrame:
    """added_pixels and removed_pixels of every scene, 0 where nothing changed."""
    length = F.col("c1") - F.col("c0")
    sums = changes.groupBy(*group).agg(
        F.sum(F.when(F.col("change") == "added candidate", length)).alias("added_pixels"),
        F.sum(F.when(F.col("change") == "removed candidate", length)).alias("removed_pixels"))
    zero = F.lit(0).cast("long")
    return scenes.select(*group).distinct().join(sums, list(group), "left").select(
        *group, F.coalesce("added_pixels", zero).alias("added_pixels"), F.coalesce("removed_pixels", zero).alias("removed_pixels"))


def mask_measures(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels and pixel box (exclusive upper ends) per object."""
    return runs.groupBy(*keys).agg(
        F.sum(F.col("c1") - F.col("c0")).alias("area_pixels"), F.min("c0").alias("xmin"), F.min("prow").alias("ymin"),
        F.max("c1").alias("xmax"), (F.max("prow") + 1).alias("ymax"))


def extent(features: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    return features.groupBy(*keys).agg(F.min("x0").alias("xmin"), F.min("y0").alias("ymin"),
                                       F.max("x1").alias("xmax"), F.max("y1").alias("ymax"))


def join_dates(before: DataFrame, after: DataFrame, group: Sequence[str] = SCENE) -> DataFrame:
    """Two pixel tables (hit, valid) on one grid; valid only where both are."""
    keys = [*group, "prow", "pcol"]
    b = before.select(*keys, F.col("hit").alias("before_hit"), F.col("valid").alias("_vb"))
    a = after.select(*keys, F.col("hit").alias("after_hit"), F.col("valid").alias("_va"))
    no = F.lit(False)
    # Pixels of a grid are made per scene, and estimates from before that would have them broadcast.
    return b.hint("merge").join(a, keys, "full").select(
        *keys, F.coalesce("before_hit", no).alias("before_hit"), F.coalesce("after_hit", no).alias("after_hit"),
        (F.coalesce("_vb", no) & F.coalesce("_va", no)).alias("valid"))


def partial_runs(pixels: DataFrame, group: Sequence[str] = SCENE) -> DataFrame:
    """group, prow, c0, c1, kind: pixel rows (prow, pcol, kind) put together to runs where neighbours lie in one batch of rows, before
    anything is moved. A run need not be maximal, and a pixel that comes twice is in two runs. Rows without a place are left out."""
    keys = [*group, "prow", "kind"]
    rows = pixels.dropna(subset=[*group, "prow", "pcol"]).select(*group, _long("prow").alias("prow"), F.col("kind").cast("int").alias("kind"), _long("pcol").alias("pcol"))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [pd.factorize(batch.column(k).to_pandas())[0] for k in range(len(group))]
            prow, kind, pcol = (batch.column(len(group) + k).to_numpy() for k in range(3))
            # Rows that lie image row by image row already need no sorting.
            line = np.logical_or.reduce([np.diff(v) != 0 for v in (*codes, prow)])
            ready = (line | (np.diff(pcol) >= 0)).all()
            order = np.arange(len(pcol)) if ready else np.lexsort((pcol, prow, *codes[::-1]))
            fresh = np.ones(len(order), bool)
            fresh[1:] = np.diff(pcol[order]) != 1
            for values in (*codes, prow, kind):
                fresh[1:] |= np.diff(values[order]) != 0
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(order)) - 1
            heads = batch.select(range(len(keys))).take(pa.array(order[first]))
            yield pa.RecordBatch.from_arrays([*heads.columns, pa.array(pcol[order[first]]), pa.array(pcol[order[last]] + 1)], names=[*keys, "c0", "c1"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return rows.mapInArrow(put_together, f"{kinds}, c0 bigint, c1 bigint").select(*group, "prow", "c0", "c1", "kind")


def join_date_runs(before: DataFrame, after: DataFrame, group: Sequence[str] = SCENE) -> DataFrame:
    """The rows of :func:`join_dates` as pieces of image rows: group, prow, c0, c1, and for each of their pixels n_rows (rows of the
    join), n_valid (those valid), n_before and n_after (those valid with a hit before and after)."""
    seen, unplaced = {}, None
    for name, pixels in (("b", before), ("a", after)):
        flag = lambda c, bit: F.when(F.col(c), bit).otherwise(0)
        marked = pixels.select(*group, "prow", "pcol", (flag("hit", 1) + flag("valid", 2)).alias("kind"))
        runs = stored(partial_runs(marked, group))
        seen |= {name: runs, f"{name}_valid": runs.where("kind >= 2"), f"{name}_hit": runs.where("kind = 3")}
        lost = marked.where("prow IS NULL OR pcol IS NULL").dropna(subset=list(group)).groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
        unplaced = lost if unplaced is None else unplaced.unionByName(lost)

    def value(n):
        both = (n["b"] > 0) & (n["a"] > 0)
        rows = F.when(both, n["b"] * n["a"]).otherwise(n["b"] + n["a"])
        return F.when(rows > 0, F.struct(rows.alias("n_rows"), (n["b_valid"] * n["a_valid"]).alias("n_valid"), (n["b_hit"] * n["a_valid"]).alias("n_before"),
                                         (n["a_hit"] * n["b_valid"]).alias("n_after")))

    placed = pieces(seen, value, group).select(*group, "prow", "c0", "c1", "value.*")
    # Pixels without a place meet none and are rows of their own.
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    alone = unplaced.select(*group, none.alias("prow"), zero.alias("c0"), F.col("n").alias("c1"), F.lit(1).cast("long").alias("n_rows"), zero.alias("n_valid"),
                            zero.alias("n_before"), zero.alias("n_after"))
    return placed.unionByName(alone)


def runs_of_pieces(joined: DataFrame, count: str, group: Sequence[str] = SCENE) -> DataFrame:
    """Runs of pieces whose pixels have rows by the column ``count``. Image rows with pixels that come several times are those
    that :func:`runs_of` makes of them."""
    at = [*group, "prow"]
    found = joined.where(F.col(count) > 0).select(*at, "c0", "c1", F.col(count).cast("int").alias("_n"))
    repeated = found.where("_n > 1").select(*at).distinct()
    if repeated.isEmpty():
        return found.drop("_n")
    pixels = found.hint("merge").join(repeated, at, "left_semi").select(*at, F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)).alias("pcol"), "_n")
    pixels = pixels.select(*at, "pcol", F.explode(F.array_repeat(F.lit(1), F.col("_n"))))
    return found.hint("merge").join(repeated, at, "left_anti").drop("_n").unionByName(runs_of(pixels, group))


def coverage(pixels: DataFrame, minimum: float = 0.1, group: Sequence[str] = SCENE) -> DataFrame:
    """Share of valid pixels; too little is a reason, not full a warning."""
    from orthomark.functions.labels import coverage_warning

    share = pixels.groupBy(*group).agg(F.avg(F.col("valid").cast("double")).alias("coverage_fraction"))
    return share.withColumn("reason", F.when(F.col("coverage_fraction") < minimum, "no usable coverage")).withColumn(
        "warning", coverage_warning("coverage_fraction"))


def overlap_stats(pixels: DataFrame, warped: bool, group: Sequence[str] = SCENE) -> DataFrame:
    """Valid overlap of a pair; none is always rejected, under 15 % after warping."""
    stats = pixels.groupBy(*group).agg(F.count_if("valid").alias("valid_overlap_pixels"), F.avg(F.col("valid").cast("double")).alias("_f"))
    return _judged_overlap(stats, warped, group)


def run_overlap_stats(joined: DataFrame, warped: bool, group: Sequence[str] = SCENE) -> DataFrame:
    """The same from the pieces of :func:`join_date_runs`."""
    length = F.col("c1") - F.col("c0")
    stats = joined.groupBy(*group).agg(F.sum(F.col("n_valid") * length).alias("valid_overlap_pixels"), F.sum(F.col("n_rows") * length).alias("_all"))
    return _judged_overlap(stats.withColumn("_f", F.col("valid_overlap_pixels") / F.col("_all")), warped, group)


def _judged_overlap(stats: DataFrame, warped: bool, group: Sequence[str]) -> DataFrame:
    reason = F.when(F.col("valid_overlap_pixels") == 0, "no valid overlap")
    if warped:
        reason = reason.when(F.col("_f") < 0.15, "less than 15% usable overlap")
    return stats.select(*group, "valid_overlap_pixels", F.round("_f", 4).alias("overlap_fraction"), reason.alias("reason"))


def rasterise_boxes(objects: DataFrame, keys: Sequence[str], width, height, band: int | None = None) -> DataFrame:
    """Runs covered by boxes, clipped to the grid.

    With ``band`` the rows come with a column ``band``, their row over that number, and are in place by keys and
    band: the boxes are moved, cut at the bands, before they become rows, so that the runs need not be."""
    w, h = (v if isinstance(v, Column) else F.lit(v) for v in (width, height))
    clipped = objects.select(*keys, F.greatest("x0", F.lit(0)).cast("long").alias("c0"), F.least(F.col("x1"), w).cast("long").alias("c1"),
                             F.greatest("y0", F.lit(0)).cast("long").alias("_r0"), F.least(F.col("y1"), h).cast("long").alias("_r1"))
    clipped = clipped.filter("c0 < c1 AND _r0 < _r1")
    if band is None:
        return clipped.select(*keys, F.explode(F.sequence(F.col("_r0"), F.col("_r1") - 1)).alias("prow"), "c0", "c1")
    over = F.sequence(F.floor(F.col("_r0") / band).cast("long"), F.floor((F.col("_r1") - 1) / band).cast("long"))
    cut = spread(clipped.select(*keys, F.explode(over).alias("band"), "_r0", "_r1", "c0", "c1"), *keys, "band")
    rows = F.sequence(F.greatest(F.col("_r0"), F.col("band") * band), F.least(F.col("_r1"), (F.col("band") + 1) * band) - 1)
    return cut.select(*keys, "band", F.explode(rows).alias("prow"), "c0", "c1")


def rasterise_geometry(objects: DataFrame, keys: Sequence[str], width, height, geom: str = "geom") -> DataFrame:
    """Runs of the pixels whose centre lies inside polygons given in pixel coordinates."""
    from orthomark.functions import geometry
    from orthomark.functions.geo import let

    w, h = (v if isinstance(v, Column) else F.lit(v) for v in (width, height))
    box = geometry.geom_bbox(geom)
    # Every object becomes many rows; a small file of objects is not left to one task.
    rows = spread(objects).select(*keys, geometry._edges(geom).alias("_edges"), box.alias("_b"), w.cast("long").alias("_w"), h.cast("long").alias("_h"))
    first = F.greatest(F.floor("_b.ymin"), F.lit(0)).cast("long")
    last = F.least(F.ceil("_b.ymax"), F.col("_h")).cast("long") - 1
    rows = rows.filter(first <= last).select(*keys, "_edges", "_w", F.explode(F.sequence(first, last)).alias("prow"))
    level = F.col("prow") + F.lit(0.5)
    crossing = F.filter("_edges", lambda e: ((e["ay"] <= level) & (level < e["by"])) | ((e["by"] <= level) & (level < e["ay"])))
    xs = F.array_sort(F.transform(crossing, lambda e: e["ax"] + (level - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"])))
    pairs = let(xs, lambda s: F.when(F.size(s) >= 2, F.transform(F.sequence(F.lit(0), F.size(s) - 2, F.lit(2)), lambda i: F.struct(
        F.get(s, i).alias("a"), F.get(s, i + 1).alias("b")))))
    spans = rows.select(*keys, "prow", "_w", F.explode(pairs).alias("p")).select(
        *keys, "prow", F.greatest(F.ceil(F.col("p.a") - 0.5).cast("long"), F.lit(0)).cast("long").alias("c0"),
        F.least(F.ceil(F.col("p.b") - 0.5).cast("long"), F.col("_w")).alias("c1"))
    return spans.filter("c0 < c1")


def foreground_mask(pixels: DataFrame, runs: DataFrame, group: Sequence[str] = SCENE) -> DataFrame:
    """1 detected, 0 background, 255 no data, for every pixel of the grid."""
    found = pixels_of(union_masks(runs, group), group).withColumn("_hit", F.lit(True))
    value = F.when(~F.col("valid"), 255).when(F.col("_hit"), 1).otherwise(0)
    return pixels.hint("merge").join(found, [*group, "prow", "pcol"], "left").select(*group, "prow", "pcol", value.alias("value"))
