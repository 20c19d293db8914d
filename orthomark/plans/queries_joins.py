"""Registered queries: joins, evidence aggregates and label edits."""

from pyspark.sql import functions as F

from orthomark.functions import geometry, labels
from orthomark.operators import descriptors, evidence, masks, merging, ordering
from orthomark.operators.grid_join import (box_area, box_iou, box_overlap, overlap_over_smaller, overlapping_pairs,
                                           with_corners)
from orthomark.plans.registry import query


def _detections(t):
    return with_corners(t.detections)


def _polygons(t):
    return with_corners(t.map_polygons).withColumn("address", F.lit(None).cast("string"))


def _points(t):
    address = labels.address_from_place({"housenumber": F.col("housenumber"), "street": F.col("street"), "city": F.col("city")})
    return t.map_points.withColumn("address", address)


def _records(t):
    return evidence.map_records(_polygons(t), _points(t))


def _evidence(t):
    # Boxes of these views are at most 90 units wide: one grid level is enough.
    return evidence.match_evidence(_detections(t), _records(t), levels=1)


EVIDENCE = f"""
, pairs AS (SELECT d.scene_id, d.object_id, p.osm_type, p.osm_id, p.name, CAST(NULL AS VARCHAR) AS address, d.w * d.h + p.w * p.h AS areas,
   greatest(least(d.x0 + d.w, p.x0 + p.w) - greatest(d.x0, p.x0), 0) * greatest(least(d.y0 + d.h, p.y0 + p.h) - greatest(d.y0, p.y0), 0) AS shared
  FROM detections d JOIN map_polygons p ON d.scene_id = p.scene_id AND d.x0 <= p.x0 + p.w AND p.x0 <= d.x0 + d.w AND d.y0 <= p.y0 + p.h AND p.y0 <= d.y0 + d.h),
ious AS (SELECT *, CAST(shared AS DOUBLE) / (areas - shared) AS x FROM pairs WHERE CAST(shared AS DOUBLE) / (areas - shared) >= 0.05),
-- The overlap is rounded by its exact binary value: both halves of the number times 10000 are exact.
spread AS (SELECT *, x * 134217729 AS wide, floor(x * 10000) AS base FROM ious),
halves AS (SELECT *, wide - (wide - x) AS high FROM spread),
beyond AS (SELECT *, (high * 10000 - (base + 0.5::DOUBLE)) + (x - high) * 10000 AS past FROM halves),
evidence AS (SELECT scene_id, object_id, osm_type, osm_id, name, address, '{labels.OVERLAPPING}' AS spatial_relation,
   (base + CASE WHEN past > 0 OR (past = 0 AND base % 2 = 1) THEN 1 ELSE 0 END) / 10000 AS intersection_over_union FROM beyond
  UNION ALL SELECT d.scene_id, d.object_id, p.osm_type, p.osm_id, p.name, nullif(concat_ws(', ', housenumber, street, city), ''), '{labels.CONTAINED_POINT}', CAST(NULL AS DOUBLE)
  FROM detections d JOIN map_points p ON d.scene_id = p.scene_id AND p.x BETWEEN d.x0 AND d.x0 + d.w AND p.y BETWEEN d.y0 AND d.y0 + d.h)
"""

IDENTITY = EVIDENCE + f"""
, strong AS (SELECT scene_id, object_id, count(*) AS n, count(*) FILTER (intersection_over_union >= 0.5) AS strong,
  max(name) FILTER (intersection_over_union >= 0.5) AS name, max(address) FILTER (intersection_over_union >= 0.5) AS address,
  count(*) FILTER (address IS NOT NULL) AS addresses FROM evidence GROUP BY scene_id, object_id),
identified AS (SELECT d.scene_id, d.object_id, d.concept, d.score, coalesce(n, 0) AS evidence_count,
  CASE WHEN n > 0 THEN '{labels.CANDIDATES}' ELSE 'unmatched' END AS match_status, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS address,
  CASE WHEN strong = 1 THEN s.name END AS candidate_name, CASE WHEN strong = 1 THEN s.address END AS candidate_address,
  coalesce(addresses, 0) AS evidence_addresses
  FROM detections d LEFT JOIN strong s ON d.scene_id = s.scene_id AND d.object_id = s.object_id)
"""


@query("j1_match_evidence", "detections map_polygons map_points", EVIDENCE + "SELECT * FROM evidence")
def _(t):
    return _evidence(t)


@query("j1_evidence_properties", "detections map_polygons map_points", EVIDENCE + """
, source AS (SELECT osm_type, osm_id, tag_key, tag_value FROM map_polygons)
SELECT object_id, count(*) AS records, string_agg(e.osm_type || ' ' || CAST(e.osm_id AS VARCHAR) || ' ' || coalesce(tag_key || '=' || tag_value, '-'), ', '
   ORDER BY coalesce(intersection_over_union, 0) DESC, e.osm_type, e.osm_id) AS listed
FROM evidence e LEFT JOIN source s ON s.osm_type = e.osm_type AND s.osm_id = e.osm_id GROUP BY object_id""")
def _(t):
    """The evidence array with the tags of the records carried along."""
    records = evidence.map_records(_polygons(t), _points(t)).join(t.map_polygons.select("osm_type", "osm_id", F.create_map("tag_key", "tag_value").alias("tags")), ["osm_type", "osm_id"], "left")
    d = _detections(t)
    found = evidence.collect_evidence(d, evidence.match_evidence(d, records, levels=1, keep=("tags",))).filter(F.size("map_evidence") > 0)
    tag = lambda e: F.coalesce(F.array_join(F.transform(F.map_entries(e["tags"]), lambda m: F.concat(m["key"], F.lit("="), m["value"])), ","), F.lit("-"))
    listed = F.array_join(F.transform("map_evidence", lambda e: F.concat_ws(" ", e["osm_type"], e["osm_id"].cast("string"), tag(e))), ", ")
    return found.select("object_id", F.size("map_evidence").cast("long").alias("records"), listed.alias("listed"))


@query("j1_match_evidence_geometry", "detections map_polygons map_points", """
, boxes AS (SELECT d.object_id, p.osm_type, p.osm_id, d.w AS wa, p.w AS wb, least(d.x0 + d.w, p.x0 + p.w) - greatest(d.x0, p.x0) AS across,
   radians(52 + d.y0 * 1e-5::DOUBLE) AS a0, radians(52 + (d.y0 + d.h) * 1e-5::DOUBLE) AS a1, radians(52 + p.y0 * 1e-5::DOUBLE) AS b0, radians(52 + (p.y0 + p.h) * 1e-5::DOUBLE) AS b1
   FROM detections d JOIN map_polygons p ON d.scene_id = p.scene_id AND d.x0 < p.x0 + p.w AND p.x0 < d.x0 + d.w AND d.y0 < p.y0 + p.h AND p.y0 < d.y0 + d.h),
-- Between two parallels the area of a strip is its width in longitude times the difference of the sines.
shares AS (SELECT *, across * 2 * cos((least(a1, b1) + greatest(a0, b0)) / 2) * sin((least(a1, b1) - greatest(a0, b0)) / 2) AS shared,
   wa * 2 * cos((a1 + a0) / 2) * sin((a1 - a0) / 2) + wb * 2 * cos((b1 + b0) / 2) * sin((b1 - b0) / 2) AS areas FROM boxes)
SELECT object_id, osm_type, osm_id, round(round(shared / (areas - shared), 4) + 0.00003, 2) AS iou FROM shares WHERE shared / (areas - shared) >= 0.05
UNION ALL SELECT d.object_id, p.osm_type, p.osm_id, CAST(NULL AS DOUBLE) FROM detections d
  JOIN map_points p ON d.scene_id = p.scene_id AND p.x BETWEEN d.x0 AND d.x0 + d.w AND p.y BETWEEN d.y0 AND d.y0 + d.h""")
def _(t):
    """The same scenes on the ground: overlap measured in the local equal-area projection."""
    def located(df, x0, y0, x1, y1):
        ground = geometry.map_vertices(geometry.box_geom(x0, y0, x1, y1), lambda x, y: 13 + x * F.lit(1e-5), lambda x, y: 52 + y * F.lit(1e-5))
        return df.withColumn("geom", ground)

    detections = located(_detections(t), "x0", "y0", "x1", "y1").select("scene_id", "object_id", "geom")
    columns = ("scene_id", "osm_type", "osm_id", "name", "address", "geom")
    points = _points(t).withColumn("geom", geometry.map_vertices(
        geometry.point_geom("x", "y"), lambda x, y: 13 + x * F.lit(1e-5), lambda x, y: 52 + y * F.lit(1e-5)))
    records = located(_polygons(t), "x0", "y0", "x1", "y1").select(*columns).unionByName(points.select(*columns))
    found = evidence.match_evidence_geometry(detections, records, cell=0.00064, levels=1)
    # Straight edges on the plane bend by a 1e-7th of the overlap on the ground; a hundredth is compared.
    return found.select("object_id", "osm_type", "osm_id", F.round(F.col("intersection_over_union") + 0.00003, 2).alias("iou"))


@query("j2_overlap_boxes", "detections map_polygons", """
, pairs AS (SELECT d.object_id, p.osm_id, d.w * d.h AS area_a, p.w * p.h AS area_b,
   (least(d.x0 + d.w, p.x0 + p.w) - greatest(d.x0, p.x0)) * (least(d.y0 + d.h, p.y0 + p.h) - greatest(d.y0, p.y0)) AS shared
  FROM detections d JOIN map_polygons p ON d.scene_id = p.scene_id AND d.x0 <= p.x0 + p.w AND p.x0 <= d.x0 + d.w AND d.y0 <= p.y0 + p.h AND p.y0 <= d.y0 + d.h)
SELECT object_id, osm_id, CAST(shared AS DOUBLE) AS shared, round(CAST(shared AS DOUBLE) / (area_a + area_b - shared), 6) AS iou,
  round(CAST(shared AS DOUBLE) / least(area_a, area_b), 6) AS over_smaller FROM pairs""")
def _(t):
    pairs = overlapping_pairs(_detections(t).select("scene_id", "object_id", "x0", "y0", "x1", "y1"),
                              _polygons(t).select("scene_id", "osm_id", "x0", "y0", "x1", "y1"), levels=1)
    return pairs.select("object_id", F.col("r_osm_id").alias("osm_id"), box_overlap().alias("shared"),
                        F.round(box_iou(), 6).alias("iou"), F.round(overlap_over_smaller(), 6).alias("over_smaller"))


@query("j2_overlap_mask_runs", "mask_pixels", """
, hits AS (SELECT scene_id, prow, pcol, before_hit, after_hit FROM mask_pixels)
SELECT scene_id, sum(CASE WHEN before_hit AND after_hit THEN 1 ELSE 0 END)::BIGINT AS shared,
  sum(before_hit::INT)::BIGINT AS area_a, sum(after_hit::INT)::BIGINT AS area_b FROM hits GROUP BY scene_id""")
def _(t):
    runs = masks.runs_of(t.mask_pixels.filter("before_hit"), ["scene_id"])
    other = masks.runs_of(t.mask_pixels.filter("after_hit"), ["scene_id"])
    return masks.run_overlap(runs, other, ["scene_id"])


PAIRS = """
, pairs AS (SELECT a.scene_id, a.concept, a.object_id AS a, b.object_id AS b, a.w * a.h AS area_a, b.w * b.h AS area_b,
   greatest(least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0), 0) * greatest(least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0), 0) AS shared
  FROM detections a JOIN detections b ON a.scene_id = b.scene_id AND a.concept = b.concept AND a.object_id < b.object_id)
"""


@query("j3_merge_candidates", "detections", PAIRS + """
SELECT a, b, round(CAST(shared AS DOUBLE) / least(area_a, area_b), 6) AS over_smaller FROM pairs WHERE CAST(shared AS DOUBLE) / least(area_a, area_b) >= 0.6""")
def _(t):
    side = _detections(t).select("scene_id", "concept", "object_id", "x0", "y0", "x1", "y1")
    pairs = overlapping_pairs(side, side, group=["scene_id", "concept"], levels=1,
                              condition=(F.col("object_id") < F.col("r_object_id")) & (overlap_over_smaller() >= 0.6))
    return pairs.select(F.col("object_id").alias("a"), F.col("r_object_id").alias("b"),
                        F.round(overlap_over_smaller(), 6).alias("over_smaller"))


def _instances(t):
    return _detections(t).select("scene_id", "concept", F.lit(0).cast("long").alias("window_id"),
                                 F.col("object_id").alias("instance_id"), F.col("score"), merging.box_rects().alias("rects"))


def _merged(t):
    return merging.merge_across_windows(_instances(t))


def merged_sql(instances: str, limit: str = "CAST(0.6 AS DOUBLE)") -> str:
    """Merging in rank order by recursion over the ranks of each component of touching boxes, objects as lists of
    pixels; window_id and instance_id come from the best member. ``instances``: scene_id, concept, score, window_id, instance_id, p (pixels as row * 100000 + column)."""
    return f"""
, listed AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM ({instances})),
boxed AS MATERIALIZED (SELECT *, list_min(list_transform(p, lambda q: q % 100000)) AS bx0, list_max(list_transform(p, lambda q: q % 100000)) AS bx1,
  list_min(p) // 100000 AS by0, list_max(p) // 100000 AS by1 FROM listed),
touching AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM boxed a JOIN boxed b ON a.scene_id = b.scene_id AND a.concept = b.concept AND a.id <> b.id
  AND a.bx0 <= b.bx1 AND b.bx0 <= a.bx1 AND a.by0 <= b.by1 AND b.by0 <= a.by1),
spreading AS (SELECT id, id AS root FROM listed UNION SELECT t.b, s.root FROM spreading s JOIN touching t ON t.a = s.id AND s.root < t.b),
inst AS MATERIALIZED (SELECT root, score, p, scene_id, concept, window_id, instance_id, row_number() OVER (PARTITION BY root ORDER BY score DESC, window_id, instance_id) AS r
  FROM listed JOIN (SELECT id, min(root) AS root FROM spreading GROUP BY id) USING (id)),
walk AS (SELECT root, r, [struct_pack(p := p, score := score, lead := r, members := CAST(1 AS BIGINT))] AS objs FROM inst WHERE r = 1
  UNION ALL
  SELECT root, r, list_append(list_transform(list_filter(met, lambda m: NOT m.hit), lambda m: m.o), struct_pack(
      p := list_distinct(flatten(list_append(list_transform(list_filter(met, lambda m: m.hit), lambda m: m.o.p), p))),
      score := greatest(score, coalesce(list_max(list_transform(list_filter(met, lambda m: m.hit), lambda m: m.o.score)), score)),
      lead := least(r, coalesce(list_min(list_transform(list_filter(met, lambda m: m.hit), lambda m: m.o.lead)), r)),
      members := CAST(1 + coalesce(list_sum(list_transform(list_filter(met, lambda m: m.hit), lambda m: m.o.members)), 0) AS BIGINT))) AS objs
  FROM (SELECT root, r, p, score, list_transform(shared, lambda s: struct_pack(o := s.o, hit := s.n > 0 AND CAST(s.n AS DOUBLE) / least(len(s.o.p), len(p)) >= {limit})) AS met
        FROM (SELECT w.root, i.r, i.p, i.score, list_transform(w.objs, lambda o: struct_pack(o := o, n := len(list_intersect(o.p, i.p)))) AS shared
              FROM walk w JOIN inst i ON i.root = w.root AND i.r = w.r + 1))),
standing AS (SELECT root, unnest(objs) AS o FROM walk JOIN (SELECT root, max(r) AS r FROM inst GROUP BY root) USING (root, r)),
merged AS (SELECT i.scene_id, i.concept, i.window_id, i.instance_id, o FROM standing s JOIN inst i ON i.root = s.root AND i.r = s.o.lead)
"""


@query("j3_merge_across_windows", "detections", merged_sql("""
  SELECT scene_id, concept, score, 0 AS window_id, object_id AS instance_id, flatten(list_transform(range(CAST(y0 AS BIGINT), CAST(y0 + h AS BIGINT)),
    lambda y: list_transform(range(CAST(x0 AS BIGINT), CAST(x0 + w AS BIGINT)), lambda x: y * 100000 + x))) AS p FROM detections""") + """
SELECT scene_id, concept, o.score AS score, len(o.p) AS area_pixels, o.members AS members, list_min(list_transform(o.p, lambda p: p % 100000)) AS xmin,
  list_min(o.p) // 100000 AS ymin, list_max(list_transform(o.p, lambda p: p % 100000)) + 1 AS xmax, list_max(o.p) // 100000 + 1 AS ymax FROM merged""", recursive=True)
def _(t):
    box = [fn(f"rects.{c}").alias(n) for n, fn, c in (("xmin", F.array_min, "x0"), ("ymin", F.array_min, "y0"), ("xmax", F.array_max, "x1"), ("ymax", F.array_max, "y1"))]
    return _merged(t).select("scene_id", "concept", (F.col("score") + F.lit(0.0)).alias("score"), "area_pixels", "members", *box)


@query("j4_detections_at_sites", "detections map_polygons", """
SELECT scene_id, object_id, concept FROM detections d WHERE EXISTS (SELECT 1 FROM map_polygons p WHERE p.tag_key = 'amenity' AND p.tag_value = 'hospital'
  AND d.scene_id = p.scene_id AND d.x0 <= p.x0 + p.w AND p.x0 <= d.x0 + d.w AND d.y0 <= p.y0 + p.h AND p.y0 <= d.y0 + d.h)""")
def _(t):
    sites = _polygons(t).filter("tag_key = 'amenity' AND tag_value = 'hospital'")
    return evidence.detections_at_sites(_detections(t), sites, levels=1).select("scene_id", "object_id", "concept")


@query("j5_containing_buildings", "map_points map_polygons", f"""
SELECT q.osm_id AS lookup_id, p.osm_type, p.osm_id, p.name, '{labels.CONTAINS_SELECTED}' AS match_status, q.name AS selected_name
FROM map_points q JOIN map_polygons p ON q.scene_id = p.scene_id AND q.x BETWEEN p.x0 AND p.x0 + p.w AND q.y BETWEEN p.y0 AND p.y0 + p.h AND p.tag_key = 'building'""")
def _(t):
    selected = _points(t).select(F.col("osm_id").alias("lookup_id"), "scene_id", F.lit("Point").alias("kind"),
                                 F.col("x").alias("x0"), F.col("y").alias("y0"), "name", "address")
    return evidence.containing_buildings(selected, _polygons(t).withColumn("tags", F.create_map("tag_key", "tag_value")), levels=1).select(
        "lookup_id", "osm_type", "osm_id", "name", "match_status", F.col("selected_point.name").alias("selected_name"))


@query("j6_resolve_features", "map_points map_polygons orders", """
, wanted AS (SELECT o_orderkey AS lookup_id, CASE o_orderkey % 4 WHEN 0 THEN 'node' WHEN 1 THEN 'way' WHEN 2 THEN 'relation' END AS osm_type,
   o_orderkey % 700 AS osm_id FROM orders),
records AS (SELECT osm_type, osm_id, name FROM map_points UNION ALL SELECT osm_type, osm_id, name FROM map_polygons)
SELECT lookup_id, r.osm_type, r.osm_id, name FROM wanted w JOIN records r ON w.osm_type = r.osm_type AND w.osm_id = r.osm_id WHERE w.osm_id >= 1""")
def _(t):
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "N").when(k % 4 == 1, "W").when(k % 4 == 2, "relation").otherwise("X")
    ids = t.orders.select(k.alias("lookup_id"), kind.alias("osm_type"), (k % 700).alias("osm_id"))
    return evidence.resolve_features(ids, _records(t)).select("lookup_id", "osm_type", "osm_id", "name")


EDITED = """
, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edit_object ORDER BY edited_at DESC, edit_id DESC) AS n FROM label_edits) WHERE n = 1)
"""


def _edits(t):
    return t.label_edits.withColumnRenamed("edit_object", "object_id")


@query("j7_apply_label_edits", "detections label_edits", EDITED + """
SELECT object_id, concept, l.reviewed_label, l.rejected FROM detections d LEFT JOIN last l ON d.object_id = l.edit_object""")
def _(t):
    return ordering.apply_label_edits(t.detections, _edits(t)).select("object_id", "concept", "reviewed_label", "rejected")


@query("j8_match_descriptors_l2", "", """
WITH d AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS pair_id, list_sum(list_transform(list_zip(a.embedding, b.embedding),
     lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) AS dist
   FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS n FROM d),
best AS (SELECT pair_id, a, max(CASE WHEN n = 1 THEN b END) AS b, sqrt(max(CASE WHEN n = 1 THEN dist END)) AS d1, sqrt(max(CASE WHEN n = 2 THEN dist END)) AS d2 FROM r WHERE n <= 2 GROUP BY pair_id, a)
SELECT pair_id, a, b, round(d1, 5) AS d1, round(d2, 5) AS d2 FROM best WHERE d1 < 0.95 * d2""")
def _(t):
    side = t.embeddings.select(F.col("label").alias("pair_id"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    # Vectors are far sparser than image key points, hence the looser ratio.
    m = descriptors.match_descriptors(side.filter("id % 2 = 0"), side.filter("id % 2 = 1"), ratio=0.95, metric="l2")
    return m.select("pair_id", F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.round("d1", 5).alias("d1"), F.round("d2", 5).alias("d2"))


@query("j8_match_descriptors_hamming", "", """
WITH c AS (SELECT vec_id, label, list_concat(list_transform(embedding, lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END), list_transform(embedding, lambda v: CASE WHEN v > CAST(0.1 AS FLOAT) THEN 1 ELSE 0 END)) AS bits FROM embeddings),
d AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS pair_id, CAST(list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: abs(z[1] - z[2]))) AS DOUBLE) AS dist
   FROM c a JOIN c b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS n FROM d),
best AS (SELECT pair_id, a, max(CASE WHEN n = 1 THEN b END) AS b, max(CASE WHEN n = 1 THEN dist END) AS d1, max(CASE WHEN n = 2 THEN dist END) AS d2 FROM r WHERE n <= 2 GROUP BY pair_id, a)
SELECT pair_id, a, b, d1, d2 FROM best WHERE d1 < 0.9 * d2""")
def _(t):
    # Two words a vector: the signs, and the signs above a tenth.
    both = F.concat("embedding", F.transform("embedding", lambda v: v - F.lit(0.1).cast("float")))
    side = t.embeddings.select(F.col("label").alias("pair_id"), F.col("vec_id").alias("id"), descriptors.sign_code(both).alias("code"))
    m = descriptors.match_descriptors(side.filter("id % 2 = 0"), side.filter("id % 2 = 1"), ratio=0.9, metric="hamming")
    return m.select("pair_id", F.col("id_a").alias("a"), F.col("id_b").alias("b"), "d1", "d2")


@query("j9_join_dates", "mask_pixels", """
SELECT scene_id, prow, pcol, pcol < 60 AND before_hit AS before_hit, pcol >= 4 AND after_hit AS after_hit, pcol BETWEEN 4 AND 59 AND valid AS valid FROM mask_pixels""")
def _(t):
    p = t.mask_pixels
    before = p.filter("pcol < 60").select("scene_id", "prow", "pcol", F.col("before_hit").alias("hit"), "valid")
    after = p.filter("pcol >= 4").select("scene_id", "prow", "pcol", F.col("after_hit").alias("hit"), "valid")
    return masks.join_dates(before, after)


@query("a1_extent", "detections", """
SELECT scene_id, min(x0) AS xmin, min(y0) AS ymin, max(x0 + w) AS xmax, max(y0 + h) AS ymax FROM detections GROUP BY scene_id""")
def _(t):
    return masks.extent(_detections(t))


@query("a2_collect_evidence", "detections map_polygons map_points", IDENTITY + """
, listed AS (SELECT scene_id, object_id, string_agg(concat(osm_type, ':', CAST(osm_id AS VARCHAR)), '|'
   ORDER BY coalesce(intersection_over_union, 0) DESC, osm_type, osm_id) AS evidence, max(intersection_over_union) AS best FROM evidence GROUP BY scene_id, object_id)
SELECT i.object_id, match_status, candidate_name, coalesce(evidence, '') AS evidence, best FROM identified i LEFT JOIN listed l ON i.scene_id = l.scene_id AND i.object_id = l.object_id""")
def _(t):
    full = evidence.collect_evidence(_detections(t), _evidence(t))
    ids = F.transform("map_evidence", lambda e: F.concat(e["osm_type"], F.lit(":"), e["osm_id"].cast("string")))
    best = F.array_max(F.transform("map_evidence", lambda e: e["intersection_over_union"]))
    return full.select("object_id", "match_status", "candidate_name", F.array_join(ids, "|").alias("evidence"), best.alias("best"))


@query("a2_evidence_pages", "detections map_polygons map_points", IDENTITY + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY scene_id, object_id ORDER BY coalesce(intersection_over_union, 0) DESC, osm_type, osm_id) AS n FROM evidence)
SELECT object_id, (n - 1) // 3 AS page, min(n) AS first, string_agg(concat(osm_type, ':', CAST(osm_id AS VARCHAR)), '|' ORDER BY n) AS entries FROM ranked GROUP BY object_id, scene_id, (n - 1) // 3""")
def _(t):
    paged = evidence.evidence_pages(_evidence(t), page=3)
    ids = F.transform("entries", lambda e: F.concat(e["osm_type"], F.lit(":"), e["osm_id"].cast("string")))
    return paged.select("object_id", "page", "first", F.array_join(ids, "|").alias("entries"))


def identified(t):
    return evidence.candidate_identity(_detections(t), _evidence(t))


@query("a3_candidate_identity", "detections map_polygons map_points", IDENTITY + """
SELECT scene_id, object_id, concept, score + CAST(0 AS DOUBLE) AS score, evidence_count, match_status, name, address, candidate_name, candidate_address FROM identified""")
def _(t):
    return identified(t).select("scene_id", "object_id", "concept", (F.col("score") + F.lit(0.0)).alias("score"), "evidence_count",
                                "match_status", "name", "address", "candidate_name", "candidate_address")


@query("a17_match_summary", "detections map_polygons map_points", IDENTITY + """
SELECT scene_id, count(*) AS detections, count(*) FILTER (evidence_count > 0) AS matched, count(*) FILTER (candidate_name IS NOT NULL) AS with_candidate_name
FROM identified GROUP BY scene_id""")
def _(t):
    return evidence.match_summary(identified(t))


@query("w1_number_objects", "detections", """
SELECT object_id, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, object_id) AS object_number,
  concat(upper(concept[1]), substr(concept, 2), ' ', CAST(row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, object_id) AS VARCHAR)) AS label FROM detections""")
def _(t):
    n = ordering.number_objects(t.detections, ["scene_id"], [F.col("score").desc(), F.col("object_id")])
    return n.select("object_id", "object_number", labels.default_label("concept", "object_number").alias("label"))


@query("w3_latest_edits", "label_edits", EDITED + "SELECT edit_object AS object_id, edit_id, reviewed_label, rejected FROM last")
def _(t):
    return ordering.latest_edits(_edits(t)).select("object_id", "edit_id", "reviewed_label", "rejected")
