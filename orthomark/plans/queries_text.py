"""Registered queries: text requests (Q1-Q7) and filters."""

from pyspark.sql import functions as F

from orthomark.functions import geometry, requests
from orthomark.operators import evidence, filters
from orthomark.operators.grid_join import overlapping_pairs, with_corners
from orthomark.plans.queries_joins import IDENTITY, EDITED, _detections, _edits, _polygons, identified
from orthomark.operators.ordering import apply_label_edits
from orthomark.plans.registry import query

# What each request template must lead to, written down from the request rules.
PLANS = """
, plans AS (SELECT query_id, text, CASE k WHEN 2 THEN 'address' WHEN 15 THEN 'address' WHEN 5 THEN 'coordinates' WHEN 6 THEN 'geohash'
     WHEN 4 THEN 'route' WHEN 7 THEN 'segment' WHEN 14 THEN 'segment' WHEN 8 THEN 'filter' WHEN 9 THEN 'enrich' WHEN 10 THEN 'compare' ELSE 'features' END AS intent,
   CASE k WHEN 2 THEN substr(text, 23) WHEN 6 THEN 'u33dc1' ELSE text END AS query,
   CASE k WHEN 0 THEN 'hospitals' WHEN 12 THEN 'hospitals' WHEN 1 THEN 'schools' WHEN 3 THEN 'hiking' WHEN 11 THEN 'all' WHEN 13 THEN 'parks' END AS category,
   CASE k WHEN 0 THEN substr(text, 23) WHEN 11 THEN 'Alexanderplatz' WHEN 13 THEN 'Lake Merritt' WHEN 14 THEN 'Berkeley' END AS area,
   CASE WHEN k = 11 THEN 'amenity=pharmacy' END AS tag,
   CASE k WHEN 12 THEN 'combined' WHEN 7 THEN 'imagery' WHEN 14 THEN 'imagery' ELSE 'auto' END AS source,
   CASE k WHEN 7 THEN 'building, tree' WHEN 12 THEN 'building' WHEN 14 THEN 'swimming pool' END AS prompt,
   CASE k WHEN 8 THEN 'missing_address' ELSE 'all' END AS result_filter, k
  FROM (SELECT *, query_id % 16 AS k FROM query_log))
"""
FIELDS = ("intent", "query", "category", "area", "tag", "source", "prompt")


def _plans(t):
    return requests.with_plan(t.query_log.select("query_id", "text"))


@query("q1_parse_requests", "query_log", PLANS + "SELECT query_id, intent, query, category, area, tag, source, prompt, result_filter FROM plans")
def _(t):
    return _plans(t).select("query_id", *[F.col(f"plan.{f}").alias(f) for f in FIELDS], F.col("plan.filter").alias("result_filter"))


def _word(text: str, pattern: str) -> str:
    """SQL of a pattern between word ends of any script."""
    return rf"regexp_matches({text}, '(?:^|[^\pL\pM\pN_])(?:{pattern})(?:$|[^\pL\pM\pN_])')"


# Of the grammar's words the invented turns hold only categories, "in" and "from ... to"; the SQL has the rules for these.
@query("q1_parse_conversations", "", rf"""
WITH c AS (SELECT conv_id, turn, regexp_replace(text, '^[\s\x0B\x{{85}}\p{{Z}}]+|[\s\x0B\x{{85}}\p{{Z}}]+$', '', 'g') AS q FROM conversations),
k AS (SELECT conv_id, turn, q, CASE {' '.join(f"WHEN {_word('lower(q)', p)} THEN '{c}'" for c, p in requests.CATEGORIES.items())} END AS cat FROM c WHERE q <> ''),
r AS (SELECT *, CASE WHEN {_word('lower(q)', 'from .+ to|directions|navigate')} THEN 'route'
  WHEN cat IS NOT NULL AND NOT {_word('lower(q)', '[0-9]+[a-z]?')} THEN 'features' ELSE 'address' END AS i FROM k)
SELECT c.conv_id, c.turn, i AS intent, CASE WHEN i = 'address' THEN regexp_replace(r.q, '^[ ?!]+|[ ?!]+$', '', 'g') ELSE r.q END AS query,
  CASE WHEN i = 'features' THEN cat END AS category,
  CASE WHEN i = 'features' THEN nullif(regexp_replace(regexp_extract(r.q, '(?i)(?:^|[^\pL\pM\pN_])(?:in|near|around)\s+([^\n]+?)[?.!]*$', 1), '^\s+|\s+$', '', 'g'), '') END AS area,
  CAST(NULL AS VARCHAR) AS tag, CASE WHEN i IS NOT NULL THEN 'auto' END AS source, CAST(NULL AS VARCHAR) AS prompt, CASE WHEN i IS NOT NULL THEN 'all' END AS result_filter
FROM c LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn""")
def _(t):
    plans = requests.with_plan(t.conversations.select("conv_id", "turn", "text"))
    return plans.select("conv_id", "turn", *[F.col(f"plan.{f}").alias(f) for f in FIELDS], F.col("plan.filter").alias("result_filter"))


@query("q2_category_of", "query_log", """
SELECT query_id, CASE query_id % 16 WHEN 0 THEN 'hospitals' WHEN 12 THEN 'hospitals' WHEN 1 THEN 'schools' WHEN 3 THEN 'hiking' WHEN 7 THEN 'buildings'
  WHEN 8 THEN 'buildings' WHEN 9 THEN 'buildings' WHEN 13 THEN 'parks' WHEN 2 THEN 'roads' END AS category FROM query_log""")
def _(t):
    return t.query_log.select("query_id", requests.category_of("text").alias("category"))


@query("q3_area_of", "query_log", r"""
SELECT query_id, CASE query_id % 16 WHEN 1 THEN NULL ELSE nullif(regexp_extract(text, '\b(?:in|near|around)\s+(.+?)[?.!]*$', 1), '') END AS area FROM query_log""")
def _(t):
    return t.query_log.select("query_id", requests.area_of("text").alias("area"))


@query("q4_concept_of", "query_log", """
SELECT query_id, CASE query_id % 16 WHEN 7 THEN 'building, tree' WHEN 8 THEN 'building' WHEN 9 THEN 'building' WHEN 2 THEN 'road' WHEN 13 THEN 'water' WHEN 14 THEN 'swimming pool'
  WHEN 0 THEN 'mark all hospitals' WHEN 1 THEN 'where are schools' WHEN 11 THEN 'find amenity=pharmacy' ELSE text END AS concept FROM query_log""")
def _(t):
    return t.query_log.select("query_id", requests.concept_of("text").alias("concept"))


@query("q5_route_request", "query_log", PLANS + """
, modes AS (SELECT *, CASE query_id % 5 WHEN 0 THEN 'maps' WHEN 1 THEN 'imagery' WHEN 2 THEN 'combined' ELSE 'auto' END AS mode FROM plans),
routed AS (SELECT query_id, query, area, result_filter, CASE WHEN mode = 'auto' THEN source ELSE mode END AS source,
  CASE WHEN mode = 'maps' AND intent = 'segment' THEN 'features' ELSE intent END AS intent,
  CASE WHEN mode = 'maps' AND intent = 'segment' THEN 'buildings' ELSE category END AS category, prompt FROM modes)
SELECT query_id, intent, category, source, prompt, CASE WHEN intent IN ('enrich', 'filter', 'compare', 'route') THEN intent
  WHEN intent = 'segment' THEN CASE WHEN area IS NULL THEN 'segment' ELSE 'segment_candidates' END
  WHEN intent = 'features' AND area IS NOT NULL THEN 'area_candidates' WHEN intent = 'address' THEN 'candidates' ELSE 'features' END AS kind FROM (
  SELECT query_id, area, source, category, CASE WHEN intent = 'features' AND source IN ('imagery', 'combined') AND category = 'buildings' THEN 'segment' ELSE intent END AS intent, prompt FROM routed)""")
def _(t):
    k = F.col("query_id") % 5
    mode = F.when(k == 0, "maps").when(k == 1, "imagery").when(k == 2, "combined").otherwise("auto")
    routed = _plans(t).withColumn("r", requests.route_request("plan", mode))
    return routed.select("query_id", *[F.col(f"r.{f}").alias(f) for f in ("intent", "category", "source", "prompt", "kind")])


@query("q6_validate_plans", "query_log", """
SELECT query_id, CASE query_id % 7 WHEN 1 THEN 'unknown intent' WHEN 2 THEN 'radius out of range' WHEN 3 THEN 'unknown source' WHEN 4 THEN 'prompt too long'
  WHEN 5 THEN 'unreadable plan' WHEN 6 THEN 'unknown filter' END AS reason FROM query_log""")
def _(t):
    k = F.col("query_id") % 7
    plan = F.struct(
        F.when(k == 1, "browse").otherwise("features").alias("intent"), F.col("text").alias("query"),
        F.when(k == 3, "radar").otherwise("maps").alias("source"), F.when(k == 4, F.repeat(F.lit("x"), 201)).otherwise("tree").alias("prompt"),
        F.when(k == 2, 10).otherwise(150).alias("radius_m"), F.when(k == 6, "some").otherwise("all").alias("filter"))
    text = F.when(k == 5, "{not json").otherwise(F.to_json(plan))
    return requests.validate_plans(t.query_log.withColumn("plan_json", text)).select("query_id", "reason")


@query("q7_parse_coordinates", "query_log", """
SELECT query_id, CAST(13.405 AS DOUBLE) AS lon, CAST(query_id % 80 + CAST(0.5 AS DOUBLE) AS DOUBLE) AS lat, length('u33dc1abc') AS n FROM query_log WHERE query_id % 16 = 5""")
def _(t):
    p = t.query_log.select("query_id", requests.parse_coordinates("text").alias("p")).filter("p IS NOT NULL")
    return p.select("query_id", "p.lon", "p.lat", F.length("p.geohash").cast("long").alias("n"))


def _tagged(t):
    return with_corners(t.map_polygons).withColumn("tags", F.create_map("tag_key", "tag_value"))


CATEGORY_SQL = """
SELECT osm_id, category FROM map_polygons, (VALUES ('buildings'), ('hospitals'), ('schools'), ('parks'), ('water'), ('shops'), ('all')) AS c(category)
WHERE CASE category WHEN 'buildings' THEN tag_key = 'building' WHEN 'hospitals' THEN tag_key = 'amenity' AND tag_value = 'hospital'
  WHEN 'schools' THEN tag_key = 'amenity' AND tag_value = 'school' WHEN 'parks' THEN tag_key = 'leisure' AND tag_value = 'park'
  WHEN 'water' THEN tag_key = 'natural' AND tag_value = 'water' WHEN 'shops' THEN tag_key = 'shop' ELSE true END"""


@query("p1_filter_category", "map_polygons", CATEGORY_SQL)
def _(t):
    return _tagged(t).select("osm_id", F.explode(filters.categories_of("tags")).alias("category"))


@query("p1_filter_category_hospitals", "map_polygons", "SELECT osm_id, name FROM map_polygons WHERE tag_key = 'amenity' AND tag_value = 'hospital'")
def _(t):
    return filters.filter_category(_tagged(t), "hospitals").select("osm_id", "name")


@query("p2_filter_tag", "map_polygons", "SELECT osm_id, name FROM map_polygons WHERE tag_key = 'leisure' AND tag_value = 'park'")
def _(t):
    return filters.filter_tag(_tagged(t), "leisure=park").select("osm_id", "name")


@query("p3_filter_bbox", "map_polygons", "SELECT scene_id, osm_id FROM map_polygons WHERE x0 <= 300 AND x0 + w >= 100 AND y0 <= 400 AND y0 + h >= 200")
def _(t):
    return filters.filter_bbox(with_corners(t.map_polygons), 100, 200, 300, 400).select("scene_id", "osm_id")


def _reviewed(t):
    return apply_label_edits(identified(t), _edits(t))


REVIEWED = IDENTITY + EDITED + """
, reviewed AS (SELECT i.*, l.rejected, l.reviewed_label, coalesce(evidence_addresses, 0) > 0 OR candidate_address IS NOT NULL AS addressed
  FROM identified i LEFT JOIN last l ON i.object_id = l.edit_object)
"""


@query("p4_filter_results", "detections map_polygons map_points label_edits", REVIEWED + """
SELECT mode, object_id FROM reviewed, (VALUES ('rejected'), ('all'), ('has_address'), ('missing_address')) AS m(mode)
WHERE CASE mode WHEN 'rejected' THEN coalesce(rejected, false) WHEN 'all' THEN NOT coalesce(rejected, false)
  WHEN 'has_address' THEN NOT coalesce(rejected, false) AND addressed ELSE NOT coalesce(rejected, false) AND NOT addressed END""")
def _(t):
    reviewed = _reviewed(t)
    addressed = filters.has_address(evidence=None) | (F.col("evidence_addresses") > 0)
    modes = F.array(*[F.when(filters.result_condition(m, addressed), m) for m in filters.RESULT_MODES])
    return reviewed.select(F.explode(modes).alias("mode"), "object_id").filter("mode IS NOT NULL")


@query("p5_has_address", "detections map_polygons map_points", IDENTITY + "SELECT object_id, evidence_addresses > 0 AS has_address FROM identified")
def _(t):
    from orthomark.plans.queries_joins import _evidence
    full = evidence.collect_evidence(_detections(t), _evidence(t))
    return full.select("object_id", filters.has_address().alias("has_address"))


@query("p6_filter_score", "detections", "SELECT object_id, score + CAST(0 AS DOUBLE) AS score FROM detections WHERE score >= 0.5")
def _(t):
    return filters.filter_score(t.detections, 0.5).select("object_id", (F.col("score") + F.lit(0.0)).alias("score"))


@query("p6_min_pixels", "mask_pixels", """
SELECT scene_id, sum(after_hit::INT)::BIGINT AS pixels FROM mask_pixels GROUP BY scene_id HAVING sum(after_hit::INT) >= 600""")
def _(t):
    from orthomark.operators import masks
    runs = masks.runs_of(t.mask_pixels.filter("after_hit"))
    kept = filters.min_pixels(runs, 600, ["scene_id"])
    return kept.groupBy("scene_id").agg(F.sum(F.col("c1") - F.col("c0")).alias("pixels"))


@query("p7_covers_point", "map_points map_polygons", """
SELECT p.osm_id AS polygon_id, q.osm_id AS point_id FROM map_points q JOIN map_polygons p ON q.scene_id = p.scene_id AND q.x BETWEEN p.x0 AND p.x0 + p.w AND q.y BETWEEN p.y0 AND p.y0 + p.h""")
def _(t):
    polygons = _polygons(t).select("scene_id", "osm_id", "x0", "y0", "x1", "y1", geometry.box_geom("x0", "y0", "x1", "y1").alias("geom"))
    points = t.map_points.select("scene_id", "osm_id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    pairs = overlapping_pairs(polygons, points, levels=1)
    return pairs.filter(geometry.covers_point("geom", "r_x0", "r_y0")).select(F.col("osm_id").alias("polygon_id"), F.col("r_osm_id").alias("point_id"))


@query("p8_valid_geometry", "detections", """
SELECT object_id, CASE object_id % 9 WHEN 0 THEN 'invalid geometry' WHEN 1 THEN 'empty geometry' END AS reason FROM detections""")
def _(t):
    k = F.col("object_id") % 9
    x1 = F.when(k == 0, F.col("x0")).otherwise(F.col("x0") + F.col("w"))  # no width: no area
    shape = geometry.box_geom("x0", "y0", x1, F.col("y0") + F.col("h"))
    d = t.detections.select("object_id", F.when(k != 1, shape).alias("geom"))
    return filters.check_geometry(d).select("object_id", "reason")


@query("p8_run_limits", "detections", """
SELECT concept AS run_id, count(*) AS features, CASE WHEN count(*) > 10000 THEN 'too many features' END AS reason FROM detections GROUP BY concept""")
def _(t):
    return filters.run_limits(t.detections.withColumnRenamed("concept", "run_id"), limit=10_000)
