"""Map evidence for detections: spatial candidates, never identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthomark.functions import geometry, labels
from orthomark.functions.numbers import round_exact
from orthomark.functions.ring_overlap import local_iou
from orthomark.operators.filters import in_category
from orthomark.operators.grid_join import box_iou, overlapping_pairs
from orthomark.operators.ordering import running_totals

# Smallest overlap that counts as evidence, and as a tentative identity.
MIN_EVIDENCE_IOU = 0.05
MIN_IDENTITY_IOU = 0.5
EVIDENCE_COLUMNS = ("osm_type", "osm_id", "name", "address", "spatial_relation", "intersection_over_union")
AREAL = ("Polygon", "MultiPolygon")


def _evidence(pairs: DataFrame, overlap, is_area, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    relation = F.when(is_area, labels.OVERLAPPING).otherwise(labels.CONTAINED_POINT)
    return pairs.select(*keys, F.col("r_osm_type").alias("osm_type"), F.col("r_osm_id").alias("osm_id"),
                        F.col("r_name").alias("name"), F.col("r_address").alias("address"),
                        relation.alias("spatial_relation"),
                        F.when(is_area, round_exact(overlap, 4)).alias("intersection_over_union"),
                        *[F.col(f"r_{c}").alias(c) for c in keep])


def match_evidence(detections: DataFrame, records: DataFrame, keys: Sequence[str] = ("scene_id", "object_id"),
                   cell: float = 64, levels: int | None = None, salt: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """One row per detection and map record that supports it, for axis-aligned boxes.

    Detections: keys, x0..y1. Records: scene_id, osm_type, osm_id, kind, name, address, x0..y1
    (a point has x0 = x1), and the columns ``keep`` that the evidence is to carry as well (tags, source,
    source_url, geohash, ...). Polygons count from an unrounded IoU of .05, points when covered;
    other kinds never match.
    """
    left = detections.select(*keys, "x0", "y0", "x1", "y1")
    right = records.filter(F.col("kind").isin(*AREAL, "Point")).select(
        "scene_id", "osm_type", "osm_id", "kind", "name", "address", "x0", "y0", "x1", "y1", *keep)
    is_area = F.col("r_kind") != "Point"
    covered = ((F.col("r_x0") >= F.col("x0")) & (F.col("r_x0") <= F.col("x1"))
               & (F.col("r_y0") >= F.col("y0")) & (F.col("r_y0") <= F.col("y1")))
    pairs = overlapping_pairs(left, right, cell=cell, levels=levels, salt=salt,
                              condition=F.when(is_area, box_iou() >= MIN_EVIDENCE_IOU).otherwise(covered))
    return _evidence(pairs, box_iou(), is_area, keys, keep)


def match_evidence_geometry(detections: DataFrame, records: DataFrame, keys: Sequence[str] = ("scene_id", "object_id"),
                            group: Sequence[str] = ("scene_id",), cell: float = 0.002,
                            levels: int | None = None, salt: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """The same for WGS84 geometry: boxes prune, then the overlap is measured in a local
    equal-area projection about the detection's own interior point."""
    def boxed(df, columns):
        return df.select(*columns, geometry.geom_bbox("geom").alias("_b")).select(
            *columns, F.col("_b.xmin").alias("x0"), F.col("_b.ymin").alias("y0"), F.col("_b.xmax").alias("x1"), F.col("_b.ymax").alias("y1"))

    left = detections.withColumn("at", geometry.representative_point("geom"))
    left = boxed(left, [*dict.fromkeys([*group, *keys]), "geom", "at"])
    right = boxed(records.filter(F.col("geom.kind").isin(*AREAL, "Point")), [*group, "osm_type", "osm_id", "name", "address", "geom", *keep])
    # Detections are many and carry their outlines; they move once, for areas and points alike.
    pairs = overlapping_pairs(left, right, group=group, cell=cell, levels=levels, salt=salt, anchored=True)
    is_area = F.col("r_geom.kind") != "Point"
    found = pairs.withColumn("_iou", local_iou(F.when(is_area, F.col("geom")), F.when(is_area, F.col("r_geom")), F.col("at.x"), F.col("at.y")))
    # One condition, so that what is asked of points stays out of the join, where it would be asked of every two rows of a cell.
    found = found.filter(F.when(is_area, F.col("_iou") >= MIN_EVIDENCE_IOU).otherwise(geometry.covers_point("geom", "r_x0", "r_y0")))
    return _evidence(found, F.col("_iou"), is_area, keys, keep)


def collect_evidence(detections: DataFrame, evidence: DataFrame, keys: Sequence[str] = ("scene_id", "object_id")) -> DataFrame:
    """Detections with their evidence array (best overlap first, points last), status and
    tentative identity. Further columns of the evidence rows go into the array as well. ``name`` and
    ``address`` stay NULL. The evidence rows themselves are the form to use where one detection may
    cover very many records."""
    iou = F.coalesce(F.col("intersection_over_union"), F.lit(0.0))
    more = [c for c in evidence.columns if c not in (*keys, *EVIDENCE_COLUMNS)]
    fields = [*EVIDENCE_COLUMNS, *more]
    # Maps cannot be compared, so further columns do not take part in the order.
    ordered = F.struct((-iou).alias("order"), "osm_type", "osm_id", "name", "address", "spatial_relation", "intersection_over_union")
    entry = F.struct(ordered.alias("o"), *more)
    by_order = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    sorted_entries = F.transform(F.array_sort(F.collect_list(entry), by_order), lambda e: F.struct(
        *[e["o"][f].alias(f) for f in EVIDENCE_COLUMNS], *[e[f].alias(f) for f in more]))
    grouped = evidence.groupBy(*keys).agg(sorted_entries.alias("_sorted"), *_identity(iou))
    evidence_array = F.transform("_sorted", lambda e: F.struct(*[e[f].alias(f) for f in fields]))
    joined = detections.drop("name", "address").join(grouped, list(keys), "left")
    return (joined.withColumn("map_evidence", F.coalesce(evidence_array, F.expr("filter(array(named_struct("
            + ", ".join(f"'{f}', CAST(NULL AS {evidence.schema[f].dataType.simpleString()})" for f in fields)
            + ")), x -> false)"))).drop("_sorted")
            .transform(_finish))


def evidence_pages(evidence: DataFrame, keys: Sequence[str] = ("scene_id", "object_id"), page: int = 1000) -> DataFrame:
    """keys, page (from 0), first (rank of its first entry, from 1), entries: the evidence of a detection in pages of at most ``page``
    entries, in the order of ``collect_evidence``; all pages one after the other are its array.

    Ranks come from range partitions, so a detection over any number of records is spread and no row grows with it."""
    keys = list(keys)
    rows = evidence.withColumn("_order", -F.coalesce(F.col("intersection_over_union"), F.lit(0.0)))
    order = [F.col(c) for c in ("_order", "osm_type", "osm_id", "name", "address", "spatial_relation")]
    ranked = running_totals(rows, keys, order, {"_rank": F.lit(1).cast("long")})
    entry = F.struct("_rank", *[c for c in evidence.columns if c not in keys])
    paged = ranked.withColumn("page", F.floor((F.col("_rank") - 1) / page).cast("long")).groupBy(*keys, "page").agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    fields = [c for c in evidence.columns if c not in keys]
    return paged.select(*keys, "page", F.col("_e")[0]["_rank"].alias("first"), F.transform("_e", lambda e: F.struct(*[e[f].alias(f) for f in fields])).alias("entries"))


def candidate_identity(detections: DataFrame, evidence: DataFrame, keys: Sequence[str] = ("scene_id", "object_id")) -> DataFrame:
    """Status, evidence count and tentative identity without building arrays: partial
    aggregation only, whatever the number of records per detection."""
    iou = F.coalesce(F.col("intersection_over_union"), F.lit(0.0))
    grouped = evidence.groupBy(*keys).agg(F.count(F.lit(1)).alias("evidence_count"), *_identity(iou))
    joined = detections.drop("name", "address").join(grouped, list(keys), "left")
    return _finish(joined.withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0).cast("long"))))


def _identity(iou):
    strong = iou >= MIN_IDENTITY_IOU
    pick = F.max(F.when(strong, F.struct(iou, "osm_type", "osm_id", "name", "address")))
    return [F.count(F.when(strong, 1)).alias("_strong"), pick.alias("_pick"),
            F.count(F.when(labels.filled("address").isNotNull(), 1)).alias("evidence_addresses")]


def _finish(df: DataFrame) -> DataFrame:
    matched, single = F.col("_strong").isNotNull(), F.col("_strong") == 1
    return (df.withColumn("match_status", F.when(matched, labels.CANDIDATES).otherwise(labels.UNMATCHED))
            .withColumn("name", F.lit(None).cast("string")).withColumn("address", F.lit(None).cast("string"))
            .withColumn("candidate_name", F.when(single, F.col("_pick.name")))
            .withColumn("candidate_address", F.when(single, F.col("_pick.address")))
            .withColumn("evidence_addresses", F.coalesce("evidence_addresses", F.lit(0).cast("long")))
            .withColumn("label_note", F.lit(labels.LABEL_NOTE))
            .drop("_strong", "_pick"))


def map_records(polygons: DataFrame, points: DataFrame) -> DataFrame:
    """Box polygons (x0..y1) and points (x, y) as one record table."""
    point_rows = points.withColumnsRenamed({"x": "x0", "y": "y0"}).withColumn("x1", F.col("x0")).withColumn("y1", F.col("y0"))
    columns = ["scene_id", "osm_type", "osm_id", "kind", "name", "address", "x0", "y0", "x1", "y1"]
    return (polygons.withColumn("kind", F.lit("Polygon")).select(*columns)
            .unionByName(point_rows.withColumn("kind", F.lit("Point")).select(*columns)))


def match_summary(matched: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Detections, matched detections and detections with a candidate name per run or scene."""
    return matched.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("detections"),
        F.count_if(F.col("match_status") != labels.UNMATCHED).alias("matched"),
        F.count_if(F.col("candidate_name").isNotNull()).alias("with_candidate_name"))


def detections_at_sites(detections: DataFrame, sites: DataFrame, keys: Sequence[str] = ("scene_id", "object_id"),
                        cell: float = 64, levels: int | None = None) -> DataFrame:
    """Detections touching at least one site of their scene."""
    left = detections.select(*keys, "x0", "y0", "x1", "y1")
    right = sites.select("scene_id", "x0", "y0", "x1", "y1")
    hits = overlapping_pairs(left, right, cell=cell, levels=levels).select(*keys).distinct()
    return detections.join(hits, list(keys), "left_semi")


def scenes_without_sites(detections: DataFrame, sites: DataFrame) -> DataFrame:
    """Scenes whose site search would be refused because no site was found."""
    return detections.select("scene_id").distinct().join(sites, "scene_id", "left_anti")


def containing_buildings(selected: DataFrame, buildings: DataFrame, cell: float = 64, levels: int | None = None) -> DataFrame:
    """Building polygons covering a selected point record.

    ``selected``: lookup_id, scene_id, kind, x0, y0, name, address. Only lookups that resolve
    to exactly one point are used. Of the records in ``buildings`` (with ``tags``) only those of the
    category buildings count.
    """
    single = selected.groupBy("lookup_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    points = (selected.filter(F.col("kind") == "Point").join(single, "lookup_id", "left_semi")
              .withColumn("x1", F.col("x0")).withColumn("y1", F.col("y0")))
    pairs = overlapping_pairs(points.select("scene_id", "lookup_id", "name", "address", "x0", "y0", "x1", "y1"),
                              buildings.filter(in_category("tags", "buildings")).select("scene_id", "osm_type", "osm_id", "name", "x0", "y0", "x1", "y1"),
                              cell=cell, levels=levels)
    return pairs.select("lookup_id", F.col("r_osm_type").alias("osm_type"), F.col("r_osm_id").alias("osm_id"),
                        F.col("r_name").alias("name"), F.lit(labels.CONTAINS_SELECTED).alias("match_status"),
                        F.struct(F.col("name"), F.col("address")).alias("selected_point"))


def resolve_features(ids: DataFrame, records: DataFrame) -> DataFrame:
    """(osm_type, osm_id) lookups; N, W and R are accepted, unknown types and ids < 1 dropped."""
    kind = (F.when(F.col("osm_type") == "N", "node").when(F.col("osm_type") == "W", "way")
            .when(F.col("osm_type") == "R", "relation").otherwise(F.col("osm_type")))
    wanted = ids.withColumn("osm_type", kind).filter(
        F.col("osm_type").isin("node", "way", "relation") & (F.col("osm_id") >= 1))
    return wanted.join(records, ["osm_type", "osm_id"])

