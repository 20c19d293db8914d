"""Registered queries: sources, sinks, inference, jobs and streams."""

from pyspark.sql import functions as F

from orthomark.functions import geometry, labels
from orthomark.functions.sql import register_table_functions
from orthomark.operators import masks, ordering, tiles, training
from orthomark.operators.lookups import normalise_place_records
from orthomark.operators.segmentation import threshold_predictor
from orthomark.plans import jobs
from orthomark.plans.queries_joins import EDITED, IDENTITY, _detections, _edits, _polygons, _records, identified, merged_sql
from orthomark.plans.queries_raster import OBJECTS, SIDE, _object_runs, changes_sql, regions_sql, rows_sql
from orthomark.plans.registry import query
from orthomark.session import scratch_folder, stored
from orthomark.sources import readers, writers
from orthomark.streaming import jobs as streams

DEGREE = 1e-5
# Files of one micro-batch, at least, and the rows of a table that call for another one.
FILES, ROWS_A_FILE = 4, 500_000


def _located(df):
    ground = geometry.map_vertices(geometry.box_geom("x0", "y0", "x1", "y1"), lambda x, y: 13 + x * F.lit(DEGREE), lambda x, y: 52 + y * F.lit(DEGREE))
    return df.withColumn("geom", ground)


@query("s1_read_geojson", "detections", """
SELECT CAST(object_id AS VARCHAR) AS object_id, concept, round(13 + x0 * CAST(0.00001 AS DOUBLE), 6) AS west, round(52 + y0 * CAST(0.00001 AS DOUBLE), 6) AS south,
  round(13 + (x0 + w) * CAST(0.00001 AS DOUBLE), 6) AS east, round(52 + (y0 + h) * CAST(0.00001 AS DOUBLE), 6) AS north FROM detections""")
def _(t):
    """Written as feature collections first, then read back."""
    path = scratch_folder(t.spark, "geojson")
    writers.write_geojson(_located(_detections(t)).select("object_id", "concept", "geom"), path)
    features, _rejected = readers.read_geojson(t.spark, path)
    b = features.select(F.col("properties")["object_id"].alias("object_id"), F.col("properties")["concept"].alias("concept"), geometry.geom_bbox("geom").alias("b"))
    return b.select("object_id", "concept", F.round("b.xmin", 6).alias("west"), F.round("b.ymin", 6).alias("south"),
                    F.round("b.xmax", 6).alias("east"), F.round("b.ymax", 6).alias("north"))


@query("s3_read_manifest", "manifest", "SELECT path, label, split, grp FROM manifest")
def _(t):
    path = scratch_folder(t.spark, "manifest")
    t.manifest.select("path", "label", "split", F.col("grp").alias("group")).write.option("header", True).csv(path)
    rows = readers.read_manifest(t.spark, path)
    return rows.select(F.regexp_extract("path", r"(tiles/[^/]+)$", 1).alias("path"), "label", "split", "grp")


@query("s4_normalise_map_records", "map_polygons", """
SELECT osm_type, osm_id, name, 'OpenStreetMap via Overpass' AS source, concat('https://www.openstreetmap.org/way/', CAST(osm_id AS VARCHAR)) AS source_url, 'mapped feature' AS match_status,
  CASE WHEN osm_id % 4 = 0 THEN concat(CAST(osm_id % 90 AS VARCHAR), ', Example Road') END AS address FROM map_polygons WHERE osm_id % 7 <> 0""")
def _(t):
    i = F.col("osm_id")
    tags = F.map_filter(F.create_map(
        "tag_key", "tag_value", F.lit("name"), F.col("name"), F.lit("addr:housenumber"), F.when(i % 4 == 0, (i % 90).cast("string")),
        F.lit("addr:street"), F.when(i % 4 == 0, "Example Road")), lambda k, v: v.isNotNull())
    raw = _located(_polygons(t)).select(F.col("osm_type").alias("type"), i.alias("id"), tags.alias("tags"), F.lit("2024-01-01").alias("fetched_at"),
                                        F.when(i % 7 != 0, F.col("geom")).alias("geom"))
    return readers.normalise_map_records(raw).select("osm_type", "osm_id", "name", "source", "source_url", "match_status", "address")


@query("s5_normalise_place_records", "map_points", f"""
SELECT osm_id, nullif(concat_ws(', ', housenumber, street, city), '') AS address, 'OpenStreetMap via Photon' AS source, '{labels.SEARCH_CANDIDATE}' AS match_status, CAST(9 AS BIGINT) AS n, x, y FROM map_points""")
def _(t):
    raw = t.map_points.withColumn("lon", 13 + F.col("x") * F.lit(DEGREE)).withColumn("lat", 52 + F.col("y") * F.lit(DEGREE))
    return normalise_place_records(raw).select("osm_id", "address", "source", "match_status", F.length("geohash").cast("long").alias("n"), "x", "y")


@query("s6_write_geojson", "detections", """
SELECT CAST(object_id AS VARCHAR) AS object_id, concept, round(13 + x0 * CAST(0.00001 AS DOUBLE), 6) AS west, round(52 + y0 * CAST(0.00001 AS DOUBLE), 6) AS south, 'Polygon' AS kind FROM detections""")
def _(t):
    path = scratch_folder(t.spark, "features")
    writers.write_geojson(_located(_detections(t)).select("object_id", "concept", "geom"), path, metadata={"completeness": "test"})
    lines = t.spark.read.text(path).filter(F.col("value").contains('"type":"Feature"')).select(F.regexp_replace("value", "^,", "").alias("j"))
    value = lambda p: F.get_json_object("j", p)
    corner = lambda i: F.round(value(f"$.geometry.coordinates[0][0][{i}]").cast("double"), 6)
    return lines.select(value("$.properties.object_id").alias("object_id"), value("$.properties.concept").alias("concept"), corner(0).alias("west"),
                        corner(1).alias("south"), value("$.geometry.type").alias("kind"))


def _labelled(t):
    return ordering.apply_label_edits(identified(t), _edits(t)).withColumn("label", labels.default_label("concept", "object_id")).withColumn(
        "visual_class", F.col("concept")).withColumn("source", F.lit('local "model" prediction'))


@query("s7_write_labels_csv", "detections map_polygons map_points label_edits", IDENTITY + EDITED + """
SELECT CAST(object_id AS VARCHAR) AS object_id, coalesce(l.reviewed_label, candidate_name || ' (candidate)', concat(upper(concept[1]), substr(concept, 2), ' ', CAST(object_id AS VARCHAR))) AS label,
  concept AS visual_class, '' AS address, '' AS candidate_address, match_status, 'local "model" prediction' AS source FROM identified i LEFT JOIN last l ON i.object_id = l.edit_object""")
def _(t):
    path = scratch_folder(t.spark, "labels")
    writers.write_labels_csv(_labelled(t), path)
    back = t.spark.read.option("header", True).option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    return back.drop("score").select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns if c != "score"])


@query("s8_write_image_features", "detections", "SELECT concept AS run_id, 'image_pixels' AS coordinate_space, count(*) AS features FROM detections GROUP BY concept")
def _(t):
    path = scratch_folder(t.spark, "image-features")
    pixel = _detections(t).select(F.col("concept").alias("run_id"), "object_id", geometry.box_geom("x0", "y0", "x1", "y1").alias("geom"))
    writers.write_image_features(pixel, path)
    back = t.spark.read.json(path)
    return back.groupBy("run_id", "coordinate_space").agg(F.count(F.lit(1)).alias("features"))


@query("s9_write_run", "detections", "SELECT 'run_a' AS run_id, concept, count(*) AS objects, CAST(sum(object_id) AS BIGINT) AS ids, round(sum(score), 2) AS scores FROM detections GROUP BY concept")
def _(t):
    path = scratch_folder(t.spark, "runs")
    writers.write_run(t.detections, path, "run_a")
    return t.spark.read.parquet(path).groupBy("run_id", "concept").agg(
        F.count(F.lit(1)).alias("objects"), F.sum("object_id").alias("ids"), F.round(F.sum("score"), 2).alias("scores"))


@query("s10_write_masks", "mask_pixels", OBJECTS + """
SELECT CAST(scene_id AS VARCHAR) AS run_id, object_id, count(*) AS area_pixels, CAST(0.9 AS DOUBLE) AS score FROM px GROUP BY scene_id, object_id""")
def _(t):
    path = scratch_folder(t.spark, "masks")
    runs = stored(_object_runs(t).withColumn("run_id", F.col("scene_id").cast("string")))
    scores = runs.select("run_id", "object_id").distinct().withColumn("score", F.lit(0.9))
    writers.write_masks(runs.drop("scene_id"), scores, path)
    back = t.spark.read.parquet(f"{path}/mask_runs")
    areas = masks.mask_measures(back, ["run_id", "object_id"]).select("run_id", "object_id", "area_pixels")
    joined = areas.join(t.spark.read.parquet(f"{path}/scores"), ["run_id", "object_id"])
    return joined.select(F.col("run_id").cast("string").alias("run_id"), "object_id", "area_pixels", "score")


@query("s11_write_run_metadata", "detections", """
SELECT concept AS run_id, count(*) AS objects, min(score) + CAST(0 AS DOUBLE) AS min_score, max(score) + CAST(0 AS DOUBLE) AS max_score, concept AS prompt, CAST(0.5 AS DOUBLE) AS threshold FROM detections GROUP BY concept""")
def _(t):
    path = scratch_folder(t.spark, "metadata")
    d = t.detections.withColumn("run_id", F.col("concept")).withColumn("score", F.col("score") + F.lit(0.0))
    writers.write_run_metadata(d, path, {"prompt": F.col("run_id"), "threshold": 0.5})
    return t.spark.read.json(path).select("run_id", "objects", "min_score", "max_score", "prompt", "threshold")


@query("s12_write_training_record", "manifest", """
SELECT CAST(count(*) FILTER (split = 'train') AS BIGINT) AS train, CAST(count(*) FILTER (split = 'val') AS BIGINT) AS val, CAST(count(*) FILTER (split = 'test') AS BIGINT) AS test, CAST(42 AS BIGINT) AS seed FROM manifest""")
def _(t):
    path = scratch_folder(t.spark, "training")
    history = t.epoch_log.groupBy("epoch").agg(F.avg("val_loss").alias("val_loss"))
    report, _matrix = training.evaluate(t.predictions, 10)
    writers.write_training_record(path, t.manifest, history, report, training.split_counts(t.manifest), {"seed": training.SEED, "epochs": 10})
    return t.spark.read.json(f"{path}/training_config").select("split_counts.train", "split_counts.val", "split_counts.test", "config.seed")


# Fixed value: head of an uncompressed image of 64 x 64 pixels of three bytes. Bytes under 128 are text that any writer writes.
BITMAP_HEAD = [66, 77, 54, 48, 0, 0, 0, 0, 0, 0, 54, 0, 0, 0, 40, 0, 0, 0, 64, 0, 0, 0, 64, 0, 0, 0, 1, 0, 24, 0, 0, 0, 0, 0, 0, 48, *[0] * 18]


def _bitmaps(t):
    """Name and bytes of an image of every mask grid: blue, green, red from the bottom row up."""
    shade = F.concat(*[F.char(v) for v in (F.when(F.col("before_hit"), 100).otherwise(1), F.when(F.col("after_hit"), 120).otherwise(2), F.lit(3) + F.col("pcol"))])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("prow")).alias("r"), "pcol", shade.alias("v")))), lambda p: p["v"]), "")
    head = F.concat(*[F.char(F.lit(b)) for b in BITMAP_HEAD])
    name = F.concat(F.lit("scene_id="), F.coalesce(F.col("scene_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")), F.lit(".bmp"))
    return t.mask_pixels.groupBy("scene_id").agg(F.concat(head, body).alias("value")).select(name.alias("name"), F.encode("value", "UTF-8").alias("content"))


@query("s2_read_images", "mask_pixels", """
SELECT scene_id, prow, CAST(64 AS BIGINT) AS pixels, CAST(sum(3 + pcol) AS BIGINT) AS red, CAST(sum(CASE WHEN after_hit THEN 120 ELSE 2 END) AS BIGINT) AS green,
  CAST(sum(CASE WHEN before_hit THEN 100 ELSE 1 END) AS BIGINT) AS blue, CAST(sum(pcol * (CASE WHEN after_hit THEN 120 ELSE 2 END)) AS BIGINT) AS placed FROM mask_pixels GROUP BY scene_id, prow""")
def _(t):
    folder = scratch_folder(t.spark, "images")
    writers.write_files(_bitmaps(t), folder)
    images, carried = readers.read_image_tiles(t.spark, folder, size=48)
    pixels = tiles.pixels_of_tiles(carried, ["red", "green", "blue"], ("path", "file"), wide=True, kind="bigint")
    known = images.where("width = 64 AND height = 64 AND channels = 3").select("path", F.regexp_extract("path", r"scene_id=(\d+)", 1).cast("long").alias("scene_id"))
    sums = pixels.groupBy("path", "prow").agg(F.count(F.lit(1)).alias("pixels"), *[F.sum(b).alias(b) for b in ("red", "green", "blue")], F.sum(F.col("pcol") * F.col("green")).alias("placed"))
    return sums.join(known, "path").drop("path")


# Bright regions of every window as instances, merged across windows and numbered.
WINDOW_ROWS = rows_sql("SELECT scene_id, window_id, prow, pcol FROM mask_pixels JOIN (VALUES (0, 0, 0), (1, 24, 0), (2, 0, 24), (3, 24, 24)) AS v(window_id, x, y) "
                       "ON prow >= y AND prow < y + 40 AND pcol >= x AND pcol < x + 40 WHERE after_hit AND valid", "scene_id, window_id")
SEGMENTED = WINDOW_ROWS + regions_sql(1, "scene_id, window_id") + merged_sql("""
  SELECT scene_id, 'building' AS concept, CAST(0.9 AS DOUBLE) AS score, window_id, row_number() OVER (PARTITION BY scene_id, window_id ORDER BY region) - 1 AS instance_id, p
  FROM (SELECT scene_id, window_id, region, list(prow * 100000 + x) AS p FROM (SELECT *, unnest(range(c0, c1)) AS x FROM regions) GROUP BY scene_id, window_id, region HAVING count(*) >= 4)""") + """
, found AS (SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY o.score DESC, window_id, instance_id) AS object_id, o.p AS p, o.members AS members FROM merged)
"""


@query("r8_segment_windows", "mask_pixels", SEGMENTED + """
SELECT scene_id, object_id, 'Building ' || object_id AS label, len(p) AS area_pixels, members, list_min(list_transform(p, lambda q: q % 100000)) AS x0, list_min(p) // 100000 AS y0,
  list_max(list_transform(p, lambda q: q % 100000)) + 1 AS x1, list_max(p) // 100000 + 1 AS y1 FROM found""", recursive=True)
def _(t):
    """Windows, inference, merging and numbering end to end on the mask grids."""
    pixels = t.mask_pixels.select("scene_id", "prow", "pcol", "valid", F.when(F.col("after_hit"), 255.0).otherwise(0.0).alias("grey"))
    scenes = t.supplier.select(F.col("s_suppkey").alias("scene_id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"))
    found = jobs.segment_scenes(pixels, scenes, ["building"], threshold_predictor(), ["grey"], size=40, overlap=16, min_pixels=4)
    return found.select("scene_id", "object_id", "label", "area_pixels", "members", "x0", "y0", "x1", "y1")


@query("flow_answer_requests", "query_log map_polygons", """
, q AS (SELECT query_id, query_id % 150 AS scene_id, CASE query_id % 16 WHEN 1 THEN 'schools' WHEN 3 THEN 'hiking' ELSE 'hospitals' END AS category,
   CASE WHEN query_id % 16 = 11 THEN 'amenity=school' END AS tag FROM query_log WHERE query_id % 16 IN (1, 3, 11, 12))
SELECT query_id, category, tag, osm_type, osm_id, name FROM q JOIN map_polygons p ON p.scene_id = q.scene_id AND tag_key = 'amenity'
  AND concat(tag_value, 's') = CASE WHEN tag IS NULL THEN category ELSE 'schools' END AND x0 <= 400 AND y0 <= 400""")
def _(t):
    k = F.col("query_id")
    box = {"x0": 0, "y0": 0, "x1": 400, "y1": 400}
    # A tag stands above the category that is named beside it.
    text = F.when(k % 16 == 11, "find hospitals amenity=school").otherwise(F.col("text")).alias("text")
    asked = t.query_log.select("query_id", text, (k % 150).alias("scene_id"), *[F.lit(v).cast("long").alias(n) for n, v in box.items()])
    return jobs.answer_requests(asked, _polygons(t).withColumn("tags", F.create_map("tag_key", "tag_value")))


@query("flow_answer_all", "query_log map_polygons map_points", """
, q AS (SELECT query_id, query_id % 16 AS m, query_id % 150 AS scene_id FROM query_log),
kinds AS (SELECT *, CASE WHEN m IN (0, 11, 13) THEN 'area_candidates' WHEN m IN (2, 15) THEN 'candidates' WHEN m = 14 THEN 'segment_candidates' WHEN m = 4 THEN 'route' WHEN m = 7 THEN 'segment'
  WHEN m = 8 THEN 'filter' WHEN m = 9 THEN 'enrich' WHEN m = 10 THEN 'compare' ELSE 'features' END AS kind FROM q),
mapped AS (SELECT query_id, count(*) AS n FROM q JOIN map_polygons p ON p.scene_id = q.scene_id AND tag_key = 'amenity' AND x0 <= 400 AND y0 <= 400
  AND tag_value = CASE m WHEN 1 THEN 'school' WHEN 12 THEN 'hospital' END GROUP BY query_id),
words AS (SELECT list_filter(string_split_regex(lower(concat_ws(' ', name, street, city)), '[^a-z0-9_]+'), lambda w: w <> '') AS w FROM map_points),
placed AS (SELECT query_id, least(count(*), 6) AS n FROM q JOIN nation ON n_nationkey = query_id % 25 JOIN words ON list_has_any(w, string_split(lower(n_name), ' ')) WHERE m = 15 GROUP BY query_id)
SELECT k.query_id, kind, CAST(coalesce(f.n, p.n, CASE WHEN m IN (5, 6) THEN 1 ELSE 0 END) AS BIGINT) AS rows_found, true AS explained
FROM kinds k LEFT JOIN mapped f USING (query_id) LEFT JOIN placed p USING (query_id)""")
def _(t):
    """Requests of every kind; those for an address name a nation, which is the city of some places."""
    k = F.col("query_id")
    box = {"x0": 0, "y0": 0, "x1": 400, "y1": 400}
    named = t.query_log.join(t.nation.select(F.col("n_nationkey").cast("long").alias("_n"), "n_name"), k % 25 == F.col("_n"))
    asked = named.select("query_id", F.when(k % 16 == 15, F.col("n_name")).otherwise(F.col("text")).alias("text"), (k % 150).alias("scene_id"),
                         *[F.lit(v).cast("long").alias(n) for n, v in box.items()])
    places = t.map_points.select(F.col("osm_id").alias("place_id"), F.concat_ws(" ", "name", "street", "city").alias("text"), "x", "y")
    found = jobs.answer_all(asked, _polygons(t).withColumn("tags", F.create_map("tag_key", "tag_value")), places)["plans"]
    return found.select("query_id", "kind", "rows_found", F.col("message").isNotNull().alias("explained"))


@query("flow_compare_dates", "mask_pixels", changes_sql("(before_hit AND valid)", "(after_hit AND valid)") + """
, counted AS (SELECT s_suppkey AS scene_id, CAST(coalesce(sum(c1 - c0) FILTER (change = 'added candidate'), 0) AS BIGINT) AS added_pixels,
  CAST(coalesce(sum(c1 - c0) FILTER (change = 'removed candidate'), 0) AS BIGINT) AS removed_pixels FROM supplier LEFT JOIN changes ON s_suppkey = scene_id GROUP BY s_suppkey)
SELECT c.scene_id, added_pixels, removed_pixels, v.n AS valid_overlap_pixels FROM counted c JOIN (SELECT scene_id, count(*) FILTER (valid) AS n FROM mask_pixels GROUP BY scene_id) v ON v.scene_id = c.scene_id""", recursive=True)
def _(t):
    date = lambda hit: t.mask_pixels.select("scene_id", "prow", "pcol", F.col(hit).alias("hit"), "valid")
    return jobs.compare_dates(date("before_hit"), date("after_hit"), SIDE, SIDE)["metadata"].select(
        "scene_id", "added_pixels", "removed_pixels", "valid_overlap_pixels")


@query("flow_compare_images", "mask_pixels", changes_sql("(before_hit AND valid)", "(after_hit AND valid)") + """
SELECT scene_id, change, prow, CAST(sum(c1 - c0) AS BIGINT) AS pixels, count(*) AS runs FROM changes GROUP BY scene_id, change, prow""", recursive=True)
def _(t):
    """The before images are stored three columns and two rows off, and brought back by their matrix."""
    image = lambda hit, right, down: t.mask_pixels.select(
        "scene_id", (F.col("prow") + down).alias("prow"), (F.col("pcol") + right).alias("pcol"), "valid", F.when(F.col(hit), 255.0).otherwise(0.0).alias("grey"))
    inverse = F.array(*[F.lit(float(v)) for v in (1, 0, 3, 0, 1, 2, 0, 0, 1)])
    scenes = t.supplier.select(F.col("s_suppkey").alias("scene_id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), inverse.alias("inverse"))
    found = jobs.compare_images(image("before_hit", 3, 2), image("after_hit", 0, 0), scenes, ["building"], threshold_predictor(), ["grey"], size=40, overlap=16, object_pixels=1)
    return found["changes"].groupBy("scene_id", "change", "prow").agg(F.sum(F.col("c1") - F.col("c0")).alias("pixels"), F.count(F.lit(1)).alias("runs"))


PAIR_SQL = changes_sql("(before_hit AND valid)", "(after_hit AND valid)") + f"""
, pairs AS (SELECT s_suppkey AS scene_id, s_suppkey % 4 AS m, ({SIDE} - s_suppkey % 10) * CASE WHEN s_suppkey % 4 = 3 THEN 4 ELSE {SIDE} END AS met FROM supplier),
counted AS (SELECT scene_id, sum(c1 - c0) FILTER (change = 'added candidate') AS added, sum(c1 - c0) FILTER (change = 'removed candidate') AS removed FROM changes GROUP BY scene_id)
"""


def _pairs(t):
    """Pairs on one grid, by landmarks, by their transforms, and by landmarks that leave four columns in common; the
    before images of the second and third kind are stored three columns and two rows off."""
    from orthomark.functions import geo

    k = F.col("scene_id") % 4
    off = k.isin(1, 2)
    image = lambda hit, right, down: t.mask_pixels.select(
        "scene_id", (F.col("prow") + down).alias("prow"), (F.col("pcol") + right).alias("pcol"), "valid", F.when(F.col(hit), 255.0).otherwise(0.0).alias("grey"))
    pairs = t.supplier.select(F.col("s_suppkey").alias("scene_id")).select(
        F.col("scene_id").alias("pair_id"), F.when(k == 0, "same_grid").when(k == 2, "georeferenced").otherwise("manual").alias("mode"), *[F.lit(SIDE).alias(f"{w}_{s}") for w in ("before", "after") for s in ("width", "height")],
        geo.affine(1.0, 0.0, 97.0, 0.0, -1.0, 52.0).alias("before_transform"), geo.affine(1.0, 0.0, 100.0, 0.0, -1.0, 50.0).alias("after_transform"))
    at = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((4, 4), (60, 4), (60, 60), (4, 60), (30, 20))])).alias("p")
    far = F.col("pair_id") % 4 == 3
    marks = pairs.where("mode = 'manual'").select("pair_id", at).select("pair_id", F.col("p.x").alias("bx"), F.col("p.y").alias("by"), (F.col("p.x") + F.when(far, 60).otherwise(-3)).alias("ax"),
                                                                       (F.col("p.y") + F.when(far, 0).otherwise(-2)).alias("ay"))
    return jobs.compare_pairs(image("before_hit", F.when(off, 3).otherwise(0), F.when(off, 2).otherwise(0)), image("after_hit", F.lit(0), F.lit(0)), pairs, ["building"], threshold_predictor(), ["grey"],
                              marks, size=40, overlap=16, object_pixels=1)


@query("flow_compare_pairs", "mask_pixels", PAIR_SQL + """
SELECT p.scene_id, CASE m WHEN 0 THEN 'User-declared same pixel grid' WHEN 2 THEN 'Georeferenced common grid' ELSE 'Manual landmarks' END AS method, CAST(met AS BIGINT) AS valid_overlap_pixels,
  round(CAST(met AS DOUBLE) / 4096, 4) AS overlap_fraction, CASE WHEN m = 3 THEN 'less than 15% usable overlap' END AS reason,
  CASE WHEN m <> 3 THEN CAST(coalesce(added, 0) AS BIGINT) END AS added_pixels, CASE WHEN m <> 3 THEN CAST(coalesce(removed, 0) AS BIGINT) END AS removed_pixels
FROM pairs p LEFT JOIN counted c USING (scene_id)""", recursive=True)
def _(t):
    return _pairs(t)["metadata"].select("scene_id", "method", "valid_overlap_pixels", "overlap_fraction", "reason", "added_pixels", "removed_pixels")


@query("flow_alignment_preview", "mask_pixels", f"""
, met AS (SELECT scene_id, prow, pcol, valid AND (scene_id % 4 <> 3 OR pcol >= {SIDE} - 4) AS seen,
  CASE WHEN scene_id % 4 = 3 THEN lag(before_hit, {SIDE} - 4) OVER (PARTITION BY scene_id, prow ORDER BY pcol) ELSE before_hit END AS before_hit, after_hit FROM mask_pixels)
SELECT scene_id, prow, CAST(sum(CASE WHEN NOT seen THEN 40 WHEN before_hit AND after_hit THEN 255 WHEN before_hit OR after_hit THEN 127 ELSE 0 END) AS BIGINT) AS shade,
  CAST(count(*) FILTER (seen) AS BIGINT) AS seen_pixels FROM met GROUP BY scene_id, prow""")
def _(t):
    pixels = tiles.pixels_of_tiles(_pairs(t)["preview"], ["grey"], wide=True, kind="bigint")
    return pixels.groupBy("scene_id", "prow").agg(F.sum("grey").alias("shade"), F.count_if("valid").alias("seen_pixels"))


@query("flow_change_features", "mask_pixels", changes_sql("(before_hit AND valid)", "(after_hit AND valid)") + """
SELECT scene_id, change, CAST(sum(c1 - c0) AS BIGINT) AS area_pixels, round(13 + min(c0) * CAST(0.00001 AS DOUBLE), 6) AS west, round(13 + max(c1) * CAST(0.00001 AS DOUBLE), 6) AS east,
  round(52 - min(prow) * CAST(0.00001 AS DOUBLE), 6) AS north, round(52 - (max(prow) + 1) * CAST(0.00001 AS DOUBLE), 6) AS south, CAST(9 AS BIGINT) AS geohash_length
FROM changes WHERE scene_id % 7 <> 0 GROUP BY scene_id, change""", recursive=True)
def _(t):
    """A seventh of the scenes has no georeference and so no map features."""
    from orthomark.functions import geo

    date = lambda hit: t.mask_pixels.select("scene_id", "prow", "pcol", F.col(hit).alias("hit"), "valid")
    changes = jobs.compare_dates(date("before_hit"), date("after_hit"), SIDE, SIDE)["changes"]
    transform = F.when(F.col("s_suppkey") % 7 != 0, geo.affine(DEGREE, 0.0, 13.0, 0.0, -DEGREE, 52.0))
    features = jobs.change_features(changes, t.supplier.select(F.col("s_suppkey").alias("scene_id"), transform.alias("transform")))
    b = features.select("scene_id", "change", "area_pixels", "geohash", geometry.geom_bbox("geom").alias("b"))
    return b.select("scene_id", "change", "area_pixels", F.round("b.xmin", 6).alias("west"), F.round("b.xmax", 6).alias("east"), F.round("b.ymax", 6).alias("north"),
                    F.round("b.ymin", 6).alias("south"), F.length("geohash").cast("long").alias("geohash_length"))


@query("flow_segment_area", "mask_pixels map_polygons", SEGMENTED + f"""
, boxes AS (SELECT scene_id, osm_id, name, x0 % {SIDE} AS x, y0 % {SIDE} AS y FROM map_polygons),
pairs AS (SELECT f.scene_id, f.object_id, b.name, len(list_filter(p, lambda q: q % 100000 >= x AND q % 100000 < x + 8 AND q // 100000 >= y AND q // 100000 < y + 8)) AS shared, len(p) AS area
  FROM found f JOIN boxes b USING (scene_id)),
near AS (SELECT *, CAST(shared AS DOUBLE) / (area + 64 - shared) AS iou FROM pairs WHERE shared > 0),
kept AS (SELECT scene_id, object_id, count(*) AS n, count(*) FILTER (round(iou, 4) >= 0.5) AS strong, any_value(name) FILTER (round(iou, 4) >= 0.5) AS name
  FROM near WHERE iou >= CAST(0.05 AS DOUBLE) GROUP BY scene_id, object_id)
SELECT f.scene_id, f.object_id, 'Building ' || f.object_id AS label, coalesce(n, 0) AS evidence_count,
  CASE WHEN n IS NULL THEN '{labels.UNMATCHED}' ELSE '{labels.CANDIDATES}' END AS match_status, CASE WHEN strong = 1 THEN k.name END AS candidate_name, CAST(9 AS BIGINT) AS geohash_length
FROM found f LEFT JOIN kept k USING (scene_id, object_id)""", recursive=True)
def _(t):
    """The mask grids as images: segmented, outlined on the map and matched with mapped boxes on the same ground."""
    from orthomark.functions import geo

    pixels = t.mask_pixels.select("scene_id", "prow", "pcol", "valid", F.when(F.col("after_hit"), 255.0).otherwise(0.0).alias("grey"))
    scenes = t.supplier.select(F.col("s_suppkey").alias("scene_id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), geo.affine(DEGREE, 0.0, 13.0, 0.0, -DEGREE, 52.0).alias("transform"))
    x, y = 13 + F.col("x0") % SIDE * F.lit(DEGREE), 52 - F.col("y0") % SIDE * F.lit(DEGREE)
    box = geometry.box_geom(x, y - 8 * DEGREE, x + 8 * DEGREE, y)
    records = _polygons(t).select("scene_id", "osm_type", "osm_id", "name", "address", box.alias("geom"))
    found = jobs.label_area(pixels, scenes, records, ["building"], threshold_predictor(), ["grey"], size=40, overlap=16, min_pixels=4)
    return found.select("scene_id", "object_id", "label", "evidence_count", "match_status", "candidate_name", F.length("geohash").cast("long").alias("geohash_length"))


@query("udtf_windows", "", """
WITH s AS (SELECT s_suppkey AS scene_id, 300 + s_suppkey * 37 % 3000 AS width FROM supplier)
SELECT scene_id, CAST(sum(CASE WHEN width <= 1008 THEN 1 ELSE ceil((width - 1008) / 912.0) + 1 END) AS BIGINT) AS windows FROM s GROUP BY scene_id""")
def _(t):
    register_table_functions(t.spark)
    return t.spark.sql("""SELECT s_suppkey AS scene_id, count(*) AS windows FROM {supplier}, LATERAL windows(CAST(300 + s_suppkey * 37 % 3000 AS BIGINT), 500, 1008, 96)
                          GROUP BY s_suppkey""", supplier=t.supplier)


@query("udtf_geohash_cell", "geo_points", """
, b AS (SELECT point_id, floor((lon + 180) / 360 * 32768) AS i, floor((lat + 90) / 180 * 32768) AS j FROM geo_points)
SELECT point_id, round(-180 + i * (360 / CAST(32768 AS DOUBLE)), 6) AS west, round(-90 + j * (180 / CAST(32768 AS DOUBLE)), 6) AS south,
  round(-180 + (i + 1) * (360 / CAST(32768 AS DOUBLE)), 6) AS east, round(-90 + (j + 1) * (180 / CAST(32768 AS DOUBLE)), 6) AS north FROM b""")
def _(t):
    from orthomark.functions import geo
    register_table_functions(t.spark)
    cells = t.geo_points.select("point_id", geo.geohash_encode("lat", "lon", 6).alias("cell"))
    return t.spark.sql("""SELECT point_id, round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north
                          FROM {cells}, LATERAL geohash_cell(cell)""", cells=cells)


# --- streams ----------------------------------------------------------------------------

def _stream(t, name):
    """The table written in three steps by day of the month and read as a stream, so that
    micro-batches arrive in time order."""
    folder = scratch_folder(t.spark, "stream-input")
    df = getattr(t, name)
    files = max(FILES, -(-df.count() // ROWS_A_FILE))
    for part in ("day(ts) <= 10", "day(ts) > 10 AND day(ts) <= 20", "day(ts) > 20"):
        df.filter(part).repartition(files).write.mode("append").parquet(folder)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


@query("t1_stream_label_edits", "label_edits", EDITED + "SELECT edit_object AS object_id, edit_id, reviewed_label, rejected FROM last")
def _(t):
    path = scratch_folder(t.spark, "edit-log")
    edits = _stream(t, "events").select(
        F.col("event_id").alias("edit_id"), (F.col("event_id") % 500).alias("object_id"), F.col("ts").alias("edited_at"), F.col("user_id").alias("reviewer"),
        F.col("event_type").alias("reviewed_label"), (F.col("event_id") % 7 == 0).alias("rejected"))
    streams.stream_label_edits(edits, path, scratch_folder(t.spark, "edit-progress")).awaitTermination()
    return streams.current_edits(t.spark, path).select("object_id", "edit_id", "reviewed_label", "rejected")


@query("t2_stream_match_evidence", "detections map_polygons map_points", IDENTITY + "SELECT object_id, evidence_count, match_status, candidate_name FROM identified")
def _(t):
    """Three micro-batches of files of bounded size."""
    folder, path = scratch_folder(t.spark, "detections"), scratch_folder(t.spark, "matched")
    files = -(-t.lineitem.count() // (3 * ROWS_A_FILE)) or 1
    _detections(t).repartition(3 * files).write.parquet(folder)
    arriving = t.spark.readStream.schema(t.spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files).parquet(folder)
    streams.stream_match_evidence(arriving, _records(t), path, scratch_folder(t.spark, "match-progress"), levels=1).awaitTermination()
    return t.spark.read.parquet(path).select("object_id", "evidence_count", "match_status", "candidate_name")


@query("t3_stream_fresh_responses", "fetch_log", """
, t AS (SELECT request_id, request_text, requested_at FROM fetch_log),
fetches AS (SELECT request_text, min(requested_at) AS at FROM t GROUP BY request_text
  UNION ALL SELECT f.request_text, (SELECT min(requested_at) FROM t WHERE t.request_text = f.request_text AND t.requested_at >= f.at + INTERVAL 86400 SECONDS)
  FROM fetches f WHERE EXISTS (SELECT 1 FROM t WHERE t.request_text = f.request_text AND t.requested_at >= f.at + INTERVAL 86400 SECONDS))
SELECT request_id, t.request_text AS request_key, CAST(epoch_us(t.requested_at) - epoch_us(max(f.at)) AS BIGINT) AS age_us
FROM t JOIN fetches f ON t.request_text = f.request_text AND f.at <= t.requested_at GROUP BY request_id, t.request_text, t.requested_at""", recursive=True)
def _(t):
    path = scratch_folder(t.spark, "responses")
    log = _stream(t, "events").select(F.col("event_id").alias("request_id"), F.col("ts").alias("requested_at"),
                                                 F.concat(F.col("user_id").cast("string"), F.lit("|"), F.col("event_type")).alias("request_text"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(provider)
    t.spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        answered = streams.stream_fresh_responses(log)
        answered.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_folder(t.spark, "response-progress")).trigger(
            availableNow=True).start().awaitTermination()
    finally:
        t.spark.conf.set(provider, before)
    return t.spark.read.parquet(path).select("request_id", "request_key", "age_us")
