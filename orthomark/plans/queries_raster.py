"""Registered queries: masks, windows, bands and sets."""

from pyspark.sql import functions as F

from orthomark.functions import geo, geometry
from orthomark.operators import masks, outlines, raster, sets, tiles, unions, views
from orthomark.plans.queries_joins import _detections, _polygons
from orthomark.plans.registry import query

SIDE = 64


def _before(t):
    return masks.runs_of(t.mask_pixels.filter("before_hit"))


def _after(t):
    return masks.runs_of(t.mask_pixels.filter("after_hit"))


def _valid(t):
    return masks.runs_of(t.mask_pixels.filter("valid"))


def _changes(t, tolerance=1, minimum=25):
    return masks.detect_changes(_before(t), _after(t), _valid(t), SIDE, SIDE, tolerance, minimum)


def _rows(runs, *keys):
    return runs.groupBy(*keys, "prow").agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("c1") - F.col("c0")).alias("pixels"),
                                           F.sum("c0").alias("starts"))


def rows_sql(pixels: str, keys: str = "scene_id") -> str:
    """Run statistics per image row of a pixel relation."""
    return f"""
, islands AS (SELECT {keys}, prow, pcol, pcol - row_number() OVER (PARTITION BY {keys}, prow ORDER BY pcol) AS s FROM ({pixels})),
runs AS (SELECT {keys}, prow, min(pcol) AS c0, max(pcol) + 1 AS c1 FROM islands GROUP BY {keys}, prow, s)
"""


ROWS = "SELECT scene_id, prow, count(*) AS runs, CAST(sum(c1 - c0) AS BIGINT) AS pixels, CAST(sum(c0) AS BIGINT) AS starts FROM runs GROUP BY scene_id, prow"


def regions_sql(reach: int, keys: str = "scene_id", name: str = "regions") -> str:
    """Regions of ``runs`` by following neighbouring rows from every run."""
    same = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    picked = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    along = " AND ".join(f"r.{k.strip()} = e.{k.strip()}" for k in keys.split(","))
    kept = ", ".join(f"r.{k.strip()}" for k in keys.split(","))
    return f"""
, nodes AS (SELECT *, prow * 4294967296 + c0 AS node FROM runs),
edges AS (SELECT {picked}, a.node AS a, b.node AS b FROM nodes a JOIN nodes b ON {same} AND abs(a.prow - b.prow) = 1
   AND a.c0 < b.c1 + {reach} AND b.c0 < a.c1 + {reach}),
reach AS (SELECT {keys}, node, node AS root FROM nodes UNION SELECT {kept}, e.b, r.root FROM reach r JOIN edges e ON {along} AND e.a = r.node AND r.root < e.b),
{name} AS (SELECT {keys}, n.prow, n.c0, n.c1, l.region FROM nodes n JOIN (SELECT {keys}, node, min(root) AS region FROM reach GROUP BY {keys}, node) l USING ({keys}, node))
"""


# --- set operations -------------------------------------------------------------------

@query("u1_union_records", "map_polygons", """
SELECT DISTINCT osm_type, osm_id, tag_key FROM map_polygons WHERE tag_key IN ('amenity', 'leisure') OR osm_id % 3 = 0""")
def _(t):
    p = t.map_polygons.select("osm_type", "osm_id", "tag_key")
    return sets.union_records(p.filter("tag_key = 'amenity'"), p.filter("tag_key = 'leisure'"), p.filter("osm_id % 3 = 0"))


@query("u2_union_masks", "mask_pixels", rows_sql("SELECT scene_id, prow, pcol FROM mask_pixels WHERE before_hit OR after_hit") + ROWS)
def _(t):
    return _rows(masks.union_masks(_before(t).unionByName(_after(t))), "scene_id")


@query("u3_difference_masks", "mask_pixels", rows_sql("SELECT scene_id, prow, pcol FROM mask_pixels WHERE after_hit AND NOT before_hit AND valid") + ROWS)
def _(t):
    return _rows(masks.difference_masks(_after(t), _before(t), _valid(t)), "scene_id")


@query("u4_union_geometry", "detections", """
, pixel_rows AS (SELECT scene_id, concept, y0 + r AS prow, x0 AS c0, x0 + w AS c1 FROM detections, range(50) AS b(r) WHERE r < h),
reached AS (SELECT *, max(c1) OVER (PARTITION BY scene_id, concept, prow ORDER BY c0, c1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM pixel_rows)
SELECT scene_id, concept, CAST(sum(greatest(c1 - greatest(c0, coalesce(before, c0)), 0)) AS BIGINT) AS area FROM reached GROUP BY scene_id, concept""")
def _(t):
    runs = masks.rasterise_boxes(_detections(t), ["scene_id", "concept"], 100000, 100000, band=64)
    merged = masks.union_masks(runs, ["scene_id", "concept", "band"])
    return merged.groupBy("scene_id", "concept").agg(F.sum(F.col("c1") - F.col("c0")).alias("area"))


# Corners of a pixel set from the four pixels around every grid point; their balance is pieces minus holes.
CONCAVE = """
, boxes AS (SELECT scene_id, concept, object_id % 2 = 0 AS bent, x0, y0, x0 + w AS x1, y0 + h AS y1, x0 + (w - w % 2) / 2 AS xm, y0 + (h - h % 2) / 2 AS ym FROM detections),
px AS (SELECT DISTINCT scene_id, concept, x, y FROM (SELECT *, unnest(range(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT))) AS x FROM (SELECT *, unnest(range(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT))) AS y FROM boxes))
  WHERE CASE WHEN bent THEN y < ym OR x < xm ELSE x < x0 + 3 OR x >= x1 - 3 OR y < y0 + 3 OR y >= y1 - 3 END),
grid AS (SELECT scene_id, concept, x + dx AS gx, y + dy AS gy, sum(CASE dx + 2 * dy WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END) AS bits, count(*) AS n
  FROM px, range(2) AS a(dx), range(2) AS b(dy) GROUP BY ALL)
SELECT p.scene_id, p.concept, area, corners, euler AS pieces_less_holes FROM (SELECT scene_id, concept, count(*) AS area FROM px GROUP BY ALL) p
JOIN (SELECT scene_id, concept, CAST(sum(CASE WHEN n IN (1, 3) THEN 1 WHEN bits IN (6, 9) THEN 2 ELSE 0 END) AS BIGINT) AS corners,
        CAST(sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN bits IN (6, 9) THEN 2 ELSE 0 END) / 4 AS BIGINT) AS euler FROM grid GROUP BY ALL) g
  ON p.scene_id = g.scene_id AND p.concept = g.concept"""


def _concave(t):
    """Bent shapes and frames in place of the boxes of detections."""
    c = F.col
    xm, ym = c("x0") + F.floor(c("w") / 2), c("y0") + F.floor(c("h") / 2)
    d = t.detections.select("scene_id", "concept", "object_id", "x0", "y0", (c("x0") + c("w")).alias("x1"), (c("y0") + c("h")).alias("y1"), xm.alias("xm"), ym.alias("ym"))
    ring = lambda *points: F.array(*[geometry.vertex(x, y) for x, y in (*points, points[0])])
    bent = F.array(F.array(ring(*[(c(x), c(y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "ym"), ("xm", "ym"), ("xm", "y1"), ("x0", "y1"))])))
    frame = F.array(F.array(ring(*[(c(x), c(y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]),
                            ring(*[(x, y) for x, y in ((c("x0") + 3, c("y0") + 3), (c("x1") - 3, c("y0") + 3), (c("x1") - 3, c("y1") - 3), (c("x0") + 3, c("y1") - 3))])))
    rings = F.when(c("object_id") % 2 == 0, bent).otherwise(frame)
    return d.select("scene_id", "concept", F.struct(F.lit("Polygon").alias("kind"), rings.alias("rings")).alias("geom"))


@query("u4_union_outlines", "detections", CONCAVE)
def _(t):
    merged = unions.union_outlines(_concave(t), ["scene_id", "concept"])
    rings = F.col("geom.rings")[0]
    corners = F.aggregate(rings, F.lit(0), lambda n, r: n + F.size(r) - 1)
    return merged.groupBy("scene_id", "concept").agg(F.sum(geometry.geom_area("geom")).cast("long").alias("area"), F.sum(corners).alias("corners"),
                                                     F.sum((2 - F.size(rings)).cast("long")).alias("pieces_less_holes"))


# --- windows and views ----------------------------------------------------------------

@query("r1_window_offsets", "view_requests", """
, sizes AS (SELECT request_id, 100 + request_id % 4000 AS n, 1008 AS size, 1008 - 96 AS step FROM view_requests),
offsets AS (SELECT request_id, n, size, unnest(CASE WHEN n <= size THEN [0] ELSE range(0, n - size + 1, step) END) AS o, step FROM sizes
  UNION SELECT request_id, n, size, n - size, step FROM sizes WHERE n > size)
SELECT request_id, o AS offset_px FROM offsets""")
def _(t):
    length = 100 + F.col("request_id") % 4000
    return t.view_requests.select("request_id", F.explode(views.window_offsets(length, 1008, 96)).alias("offset_px"))


@query("r2_plan_windows", "", """
WITH s AS (SELECT s_suppkey AS scene_id, 300 + s_suppkey * 37 % 3000 AS width, 200 + s_suppkey * 53 % 2500 AS height FROM supplier),
xs AS (SELECT scene_id, width, height, unnest(CASE WHEN width <= 1008 THEN [0] ELSE list_distinct(list_append(range(0, width - 1008 + 1, 912), width - 1008)) END) AS x FROM s),
xy AS (SELECT *, unnest(CASE WHEN height <= 1008 THEN [0] ELSE list_distinct(list_append(range(0, height - 1008 + 1, 912), height - 1008)) END) AS y FROM xs)
SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY y, x) - 1 AS window_id, x, y, least(1008, width - x) AS w, least(1008, height - y) AS h FROM xy""")
def _(t):
    k = F.col("s_suppkey")
    scenes = t.supplier.select(k.alias("scene_id"), (300 + k * 37 % 3000).alias("width"), (200 + k * 53 % 2500).alias("height"))
    return views.plan_windows(scenes)


@query("r3_plan_views", "view_requests", """
, v AS (SELECT *, CASE WHEN NOT (west < east AND south < north) THEN 'invalid bounds'
    WHEN (east - west) * 111.32 * cos(radians((south + north) / 2)) * (north - south) * 111.32 > 25 THEN 'area too large'
    WHEN NOT (west >= CAST(13.08 AS DOUBLE) AND east <= CAST(13.77 AS DOUBLE) AND south >= CAST(52.32 AS DOUBLE) AND north <= CAST(52.69 AS DOUBLE)) THEN 'no coverage' END AS bad,
    CAST(6378137 AS DOUBLE) * radians(west) AS xmin, CAST(6378137 AS DOUBLE) * radians(east) AS xmax,
    CAST(6378137 AS DOUBLE) * ln(tan(CAST(0.7853981633974483 AS DOUBLE) + radians(south) / 2)) AS ymin,
    CAST(6378137 AS DOUBLE) * ln(tan(CAST(0.7853981633974483 AS DOUBLE) + radians(north) / 2)) AS ymax,
    greatest(resolution_m, CAST(0.2 AS DOUBLE)) / cos(radians((south + north) / 2)) AS pixel FROM view_requests),
sized AS (SELECT *, CAST(greatest(1, ceil((xmax - xmin) / pixel)) AS BIGINT) AS width, CAST(greatest(1, ceil((ymax - ymin) / pixel)) AS BIGINT) AS height FROM v),
counted AS (SELECT *, (CASE WHEN width <= 1008 THEN 1 ELSE CAST(ceil((width - 1008) / CAST(912 AS DOUBLE)) AS BIGINT) + 1 END)
   * (CASE WHEN height <= 1008 THEN 1 ELSE CAST(ceil((height - 1008) / CAST(912 AS DOUBLE)) AS BIGINT) + 1 END) AS windows FROM sized)
SELECT request_id, CASE WHEN bad IS NULL THEN width END AS width, CASE WHEN bad IS NULL THEN height END AS height, CASE WHEN bad IS NULL THEN windows END AS windows,
  CASE WHEN bad IS NOT NULL THEN bad WHEN width < 64 OR height < 64 THEN 'too few pixels' WHEN width * height > 4000000 THEN 'too many pixels'
    WHEN windows > 25 THEN 'too many windows' END AS reason FROM counted""")
def _(t):
    planned = views.plan_views(t.view_requests)
    usable = F.col("reason").isNull() | F.col("reason").isin("too few pixels", "too many pixels", "too many windows")
    return planned.select("request_id", *[F.when(usable, F.col(c)).alias(c) for c in ("width", "height", "windows")], "reason")


CUT_SQL = """
, w AS (SELECT * FROM (VALUES (0, 0, 0), (1, 24, 0), (2, 0, 24), (3, 24, 24)) AS v(window_id, x, y))
SELECT scene_id, CAST(window_id AS BIGINT) AS window_id, count(*) AS pixels, CAST(sum((prow - y) * 40 + (pcol - x)) AS BIGINT) AS positions, CAST(sum(after_hit::INT) AS BIGINT) AS hits
FROM mask_pixels JOIN w ON prow >= y AND prow < y + 40 AND pcol >= x AND pcol < x + 40 GROUP BY scene_id, window_id"""


@query("r4_cut_windows", "mask_pixels", CUT_SQL)
def _(t):
    scenes = t.supplier.select(F.col("s_suppkey").alias("scene_id"), F.lit(64).alias("width"), F.lit(64).alias("height"))
    windows = views.plan_windows(scenes, 40, 16)
    carried = tiles.tiles_of(t.mask_pixels.select("scene_id", "prow", "pcol", F.col("after_hit").cast("int").alias("hit")), ["hit"], size=32)
    cut = tiles.pixels_of_tiles(tiles.cut_windows(carried, windows, size=32), ["hit"], ("scene_id", "window_id", "y0", "x0"), wide=True)
    return cut.groupBy("scene_id", "window_id").agg(F.count(F.lit(1)).alias("pixels"), F.sum((F.col("prow") - F.col("y0")) * 40 + F.col("pcol") - F.col("x0")).alias("positions"),
                                                    F.sum("hit").cast("long").alias("hits"))


@query("r4_assign_windows", "mask_pixels", CUT_SQL)
def _(t):
    pixels = t.mask_pixels.select("scene_id", "prow", "pcol", "after_hit", F.lit(64).alias("width"), F.lit(64).alias("height"))
    cut = views.assign_windows(pixels, 40, 16)
    return cut.groupBy("scene_id", "window_id").agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.col("prow") * 40 + F.col("pcol")).alias("positions"),
                                                    F.count_if("after_hit").alias("hits"))


@query("r5_select_rgb", "", """
SELECT s_suppkey AS scene_id, CASE s_suppkey % 3 WHEN 0 THEN '1,2,3' WHEN 1 THEN '4,3,2' END AS rgb,
  CASE WHEN s_suppkey % 3 = 2 THEN 'raster does not declare RGB bands' END AS reason FROM supplier""")
def _(t):
    k = F.col("s_suppkey") % 3
    names = (F.when(k == 0, F.array(*map(F.lit, ("red", "green", "blue")))).when(k == 1, F.array(*map(F.lit, ("nir", "blue", "green", "red"))))
             .otherwise(F.array(F.lit("panchromatic"))))
    scenes = t.supplier.select(F.col("s_suppkey").alias("scene_id"), names.alias("band_names"))
    return raster.select_rgb(scenes).select("scene_id", F.array_join("rgb_bands", ",").alias("rgb"), "reason")


@query("r6_valid_pixels", "band_pixels", """
SELECT scene_id, prow, pcol, bool_and(value IS NOT NULL) AS valid FROM band_pixels GROUP BY scene_id, prow, pcol""")
def _(t):
    return raster.valid_pixels(t.band_pixels, 3)


@query("a16_band_percentiles", "band_pixels", """
SELECT scene_id, band, round(quantile_cont(value, 0.02), 6) AS p_low, round(quantile_cont(value, 0.98), 6) AS p_high FROM band_pixels GROUP BY scene_id, band""")
def _(t):
    p = raster.band_percentiles(t.band_pixels)
    return p.select("scene_id", "band", F.round("p_low", 6).alias("p_low"), F.round("p_high", 6).alias("p_high"))


STRETCHED = """
, good AS (SELECT scene_id, prow, pcol, bool_and(value IS NOT NULL) AS valid FROM band_pixels GROUP BY scene_id, prow, pcol),
marked AS (SELECT b.*, valid FROM band_pixels b JOIN good g ON b.scene_id = g.scene_id AND b.prow = g.prow AND b.pcol = g.pcol),
limits AS (SELECT scene_id, band, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM marked WHERE valid GROUP BY scene_id, band),
shown AS (SELECT m.scene_id, m.band, prow, pcol, valid, CASE WHEN valid AND hi > lo THEN CAST(floor(least(greatest((value - lo) / (hi - lo), 0), 1) * 255) AS BIGINT) ELSE 0 END AS value
  FROM marked m LEFT JOIN limits l ON m.scene_id = l.scene_id AND m.band = l.band)
"""


@query("r7_percentile_stretch", "band_pixels", STRETCHED + "SELECT scene_id, band, prow, pcol, value FROM shown")
def _(t):
    return raster.percentile_stretch(t.band_pixels, 3)


@query("r15_mosaic", "band_pixels", """
SELECT scene_id, band, prow, pcol, value FROM band_pixels WHERE value IS NOT NULL""")
def _(t):
    scenes = t.supplier.select(F.col("s_suppkey").alias("scene_id"), F.lit(32).alias("width"), F.lit(32).alias("height"))
    offsets = views.mosaic_tiles(scenes, size=12).withColumn("tile_id", F.floor(F.col("y") / 12) * 3 + F.floor(F.col("x") / 12))
    p = t.band_pixels.filter("value IS NOT NULL")
    tiles = p.select("scene_id", "band", (F.floor(F.col("prow") / 12) * 3 + F.floor(F.col("pcol") / 12)).alias("tile_id"),
                     (F.col("prow") % 12).alias("prow"), (F.col("pcol") % 12).alias("pcol"), "value")
    return raster.mosaic(tiles, offsets).select("scene_id", "band", "prow", "pcol", "value")


WARP_SQL = """
, t AS (SELECT s_suppkey AS scene_id, r AS prow, c AS pcol, c * CAST(0.75 AS DOUBLE) + r * CAST(0.125 AS DOUBLE) + s_suppkey % 4 AS x,
   r * CAST(0.75 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS y FROM supplier, range(24) AS a(c), range(24) AS b(r)),
f AS (SELECT *, floor(x) AS x0, floor(y) AS y0 FROM t),
k AS (SELECT f.scene_id, f.prow, f.pcol, x0 + dx AS c, y0 + dy AS r, (CASE WHEN dx = 1 THEN x - x0 ELSE 1 - (x - x0) END) * (CASE WHEN dy = 1 THEN y - y0 ELSE 1 - (y - y0) END) AS w
  FROM f, range(2) AS a(dx), range(2) AS b(dy))
SELECT k.scene_id, band, k.prow, k.pcol, round(sum(w * coalesce(value, 0)), 6) AS value FROM k JOIN band_pixels p ON p.scene_id = k.scene_id AND p.prow = r AND p.pcol = c
WHERE w > 0 GROUP BY k.scene_id, band, k.prow, k.pcol"""


@query("r16_warp", "band_pixels", WARP_SQL)
def _(t):
    k = F.col("s_suppkey")
    inverse = F.array(F.lit(0.75), F.lit(0.125), (k % 4).cast("double"), F.lit(0.0), F.lit(0.75), F.lit(0.5), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    targets = t.supplier.select(k.alias("scene_id"), F.lit(24).alias("width"), F.lit(24).alias("height"), inverse.alias("inverse"))
    warped = tiles.warp_tiles(tiles.tiles_of(t.band_pixels, [1, 2, 3]), targets, 3)
    return tiles.pixels_of_tiles(warped, [1, 2, 3]).select("scene_id", "band", "prow", "pcol", F.round("value", 6).alias("value"))


@query("r19_blend", "band_pixels mask_pixels", STRETCHED + """
SELECT s.scene_id, band, s.prow, s.pcol, CASE WHEN NOT s.valid THEN %s WHEN before_hit AND NOT after_hit THEN CAST(floor(CAST(0.4 AS DOUBLE) * value + CAST(0.6 AS DOUBLE) * %s) AS BIGINT)
  WHEN after_hit AND NOT before_hit THEN CAST(floor(CAST(0.4 AS DOUBLE) * value + CAST(0.6 AS DOUBLE) * %s) AS BIGINT) ELSE value END AS shade
FROM shown s JOIN mask_pixels m ON s.scene_id = m.scene_id AND s.prow = m.prow AND s.pcol = m.pcol""" % tuple(
    "list_extract([%d, %d, %d], band)" % tuple(colour) for colour in (raster.NO_DATA_COLOUR, raster.REMOVED_BLEND[2], raster.ADDED_BLEND[2])))
def _(t):
    valid = raster.valid_pixels(t.band_pixels, 3).withColumnRenamed("valid", "_ok")
    image = raster.percentile_stretch(t.band_pixels, 3).hint("merge").join(valid, ["scene_id", "prow", "pcol"])
    both = image.hint("merge").join(t.mask_pixels.drop("valid"), ["scene_id", "prow", "pcol"])
    shade = [raster.paint(b, "value", added=F.expr("after_hit AND NOT before_hit"), removed=F.expr("before_hit AND NOT after_hit"), valid=F.col("_ok")) for b in range(3)]
    return both.select("scene_id", "band", "prow", "pcol", F.when(F.col("band") == 1, shade[0]).when(F.col("band") == 2, shade[1]).otherwise(shade[2]).alias("shade"))


@query("r22_fit_within", "view_requests", """
, s AS (SELECT request_id, CAST(500 + request_id % 9000 AS DOUBLE) AS w, CAST(300 + request_id % 7000 AS DOUBLE) AS h FROM view_requests)
SELECT request_id, CAST(CASE WHEN w * h > 4000000 THEN floor(w * sqrt(4000000 / (w * h))) ELSE w END AS BIGINT) AS width,
  CAST(CASE WHEN w * h > 4000000 THEN floor(h * sqrt(4000000 / (w * h))) ELSE h END AS BIGINT) AS height FROM s""")
def _(t):
    k = F.col("request_id")
    return t.view_requests.select("request_id", views.fit_within(500 + k % 9000, 300 + k % 7000).alias("s")).select("request_id", "s.width", "s.height")


# --- masks ------------------------------------------------------------------------------

REGIONS = rows_sql("SELECT scene_id, prow, pcol FROM mask_pixels WHERE after_hit")
REGION_ROWS = """SELECT scene_id, region, CAST(sum(c1 - c0) AS BIGINT) AS area_pixels, min(c0) AS xmin, min(prow) AS ymin, max(c1) AS xmax, max(prow) + 1 AS ymax
FROM regions GROUP BY scene_id, region"""


@query("r9_connected_components_8", "mask_pixels", REGIONS + regions_sql(1) + REGION_ROWS, recursive=True)
def _(t):
    return masks.mask_measures(masks.label_regions(_after(t), connectivity=8), ["scene_id", "region"])


@query("r9_connected_components_4", "mask_pixels", REGIONS + regions_sql(0) + REGION_ROWS, recursive=True)
def _(t):
    return masks.mask_measures(masks.label_regions(_after(t), connectivity=4), ["scene_id", "region"])


@query("r10_remove_small", "mask_pixels", REGIONS + regions_sql(1) + """
, kept AS (SELECT r.* FROM regions r JOIN (SELECT scene_id, region FROM regions GROUP BY scene_id, region HAVING sum(c1 - c0) >= 100) USING (scene_id, region))
SELECT scene_id, prow, count(*) AS runs, CAST(sum(c1 - c0) AS BIGINT) AS pixels, CAST(sum(c0) AS BIGINT) AS starts FROM kept GROUP BY scene_id, prow""", recursive=True)
def _(t):
    return _rows(masks.remove_small(_after(t), 100), "scene_id")


@query("r11_dilate", "mask_pixels", rows_sql("""SELECT DISTINCT scene_id, prow + dr - 2 AS prow, pcol + dc - 2 AS pcol FROM mask_pixels, range(5) AS a(dr), range(5) AS b(dc)
  WHERE before_hit AND prow + dr - 2 BETWEEN 0 AND 63 AND pcol + dc - 2 BETWEEN 0 AND 63""") + ROWS)
def _(t):
    return _rows(masks.dilate(_before(t), 2, SIDE, SIDE), "scene_id")


def changes_sql(before: str = "before_hit", after: str = "after_hit", tolerance: int = 1, minimum: int = 25) -> str:
    size = 2 * tolerance + 1
    grown = lambda hit: (f"SELECT DISTINCT scene_id, prow + dr - {tolerance} AS prow, pcol + dc - {tolerance} AS pcol "  # noqa: E731
                         f"FROM mask_pixels, range({size}) AS a(dr), range({size}) AS b(dc) WHERE {hit}")
    return f"""
, near_before AS ({grown(before)}), near_after AS ({grown(after)}),
candidates AS (SELECT scene_id, 'added candidate' AS change, prow, pcol FROM mask_pixels ANTI JOIN near_before USING (scene_id, prow, pcol) WHERE {after} AND valid
  UNION ALL SELECT scene_id, 'removed candidate', prow, pcol FROM mask_pixels ANTI JOIN near_after USING (scene_id, prow, pcol) WHERE {before} AND valid)
""" + rows_sql("SELECT * FROM candidates", "scene_id, change") + regions_sql(1, "scene_id, change", "regions8") + f"""
, changes AS (SELECT r.* FROM regions8 r JOIN (SELECT scene_id, change, region FROM regions8 GROUP BY scene_id, change, region HAVING sum(c1 - c0) >= {minimum}) USING (scene_id, change, region))
"""


@query("r12_detect_changes", "mask_pixels", changes_sql() + """
SELECT scene_id, change, prow, CAST(sum(c1 - c0) AS BIGINT) AS pixels, count(*) AS runs FROM changes GROUP BY scene_id, change, prow""", recursive=True)
def _(t):
    return _changes(t).groupBy("scene_id", "change", "prow").agg(F.sum(F.col("c1") - F.col("c0")).alias("pixels"), F.count(F.lit(1)).alias("runs"))


@query("r12_change_regions", "mask_pixels", changes_sql() + """
, nodes4 AS (SELECT scene_id, change, prow, c0, c1, prow * 4294967296 + c0 AS node FROM changes),
edges4 AS (SELECT a.scene_id, a.change, a.node AS a, b.node AS b FROM nodes4 a JOIN nodes4 b ON a.scene_id = b.scene_id AND a.change = b.change AND abs(a.prow - b.prow) = 1 AND a.c0 < b.c1 AND b.c0 < a.c1),
reach4 AS (SELECT scene_id, change, node, node AS root FROM nodes4 UNION SELECT r.scene_id, r.change, e.b, r.root FROM reach4 r JOIN edges4 e ON r.scene_id = e.scene_id AND r.change = e.change AND e.a = r.node AND r.root < e.b),
regions4 AS (SELECT scene_id, change, node, min(root) AS region FROM reach4 GROUP BY scene_id, change, node)
SELECT scene_id, change, CAST(sum(c1 - c0) AS BIGINT) AS area_pixels, min(c0) AS xmin, min(prow) AS ymin, max(c1) AS xmax, max(prow) + 1 AS ymax
FROM nodes4 JOIN regions4 USING (scene_id, change, node) GROUP BY scene_id, change, region""", recursive=True)
def _(t):
    return masks.change_regions(_changes(t))


@query("a6_change_stats", "mask_pixels", changes_sql() + """
SELECT s_suppkey AS scene_id, CAST(coalesce(sum(c1 - c0) FILTER (change = 'added candidate'), 0) AS BIGINT) AS added_pixels,
  CAST(coalesce(sum(c1 - c0) FILTER (change = 'removed candidate'), 0) AS BIGINT) AS removed_pixels FROM supplier LEFT JOIN changes ON s_suppkey = scene_id GROUP BY s_suppkey""", recursive=True)
def _(t):
    return masks.change_stats(_changes(t), t.supplier.select(F.col("s_suppkey").alias("scene_id")))


@query("a4_coverage", "mask_pixels", """
SELECT scene_id, round(avg(valid::INT::DOUBLE), 6) AS coverage_fraction, CAST(NULL AS VARCHAR) AS reason,
  CASE WHEN NOT bool_and(valid) THEN 'Some selected pixels have no imagery; detections exclude those pixels.' END AS warning FROM mask_pixels GROUP BY scene_id""")
def _(t):
    c = masks.coverage(t.mask_pixels)
    return c.select("scene_id", F.round("coverage_fraction", 6).alias("coverage_fraction"), "reason", "warning")


@query("a5_overlap_stats", "mask_pixels", """
, j AS (SELECT scene_id, valid AND pcol >= scene_id % 63 AS valid FROM mask_pixels)
SELECT scene_id, count(*) FILTER (valid) AS valid_overlap_pixels, round(avg(valid::INT::DOUBLE) + CAST(0.000000001 AS DOUBLE), 4) AS overlap_fraction,
  CASE WHEN NOT bool_or(valid) THEN 'no valid overlap' WHEN avg(valid::INT::DOUBLE) < 0.15 THEN 'less than 15% usable overlap' END AS reason FROM j GROUP BY scene_id""")
def _(t):
    shifted = t.mask_pixels.withColumn("valid", F.col("valid") & (F.col("pcol") >= F.col("scene_id") % 63))
    return masks.overlap_stats(shifted, warped=True)


OBJECT = "((prow - prow % 16) / 16 * 4 + (pcol - pcol % 16) / 16)"


def _object_runs(t):
    pixels = t.mask_pixels.filter("after_hit").withColumn("object_id", F.expr(f"CAST({OBJECT} AS BIGINT)"))
    return masks.runs_of(pixels, ["scene_id", "object_id"])


OBJECTS = f", px AS (SELECT scene_id, CAST({OBJECT} AS BIGINT) AS object_id, prow, pcol FROM mask_pixels WHERE after_hit)"


@query("a7_mask_measures", "mask_pixels", OBJECTS + """
SELECT scene_id, object_id, count(*) AS area_pixels, min(pcol) AS xmin, min(prow) AS ymin, max(pcol) + 1 AS xmax, max(prow) + 1 AS ymax FROM px GROUP BY scene_id, object_id""")
def _(t):
    return masks.mask_measures(_object_runs(t), ["scene_id", "object_id"])


@query("r13_outlines", "mask_pixels", OBJECTS + """
, sides AS (SELECT p.scene_id, p.object_id, p.prow, p.pcol, (SELECT count(*) FROM (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) AS d(dr, dc)) AS n FROM px p),
shared AS (SELECT p.scene_id, p.object_id, count(*) AS n FROM px p JOIN px q ON p.scene_id = q.scene_id AND p.object_id = q.object_id
   AND ((q.prow = p.prow AND q.pcol = p.pcol + 1) OR (q.pcol = p.pcol AND q.prow = p.prow + 1)) GROUP BY p.scene_id, p.object_id)
SELECT scene_id, object_id, CAST(count(*) AS DOUBLE) AS area, CAST(sum(sides.n) - 2 * coalesce(max(shared.n), 0) AS DOUBLE) AS perimeter,
  CAST(min(pcol) AS DOUBLE) AS xmin, CAST(min(prow) AS DOUBLE) AS ymin, CAST(max(pcol) + 1 AS DOUBLE) AS xmax, CAST(max(prow) + 1 AS DOUBLE) AS ymax
FROM sides LEFT JOIN shared USING (scene_id, object_id) GROUP BY scene_id, object_id""")
def _(t):
    o = outlines.outlines(_object_runs(t), ["scene_id", "object_id"])
    length = F.aggregate(geometry._edges("geom"), F.lit(0.0), lambda s, e: s + F.abs(e["bx"] - e["ax"]) + F.abs(e["by"] - e["ay"]))
    o = o.select("scene_id", "object_id", geometry.geom_area("geom").alias("area"), length.alias("perimeter"), geometry.geom_bbox("geom").alias("b"))
    return o.select("scene_id", "object_id", "area", "perimeter", "b.*")


@query("r13_vectorise_masks", "mask_pixels", OBJECTS + """
SELECT scene_id, object_id, count(*) AS area_pixels, round(13 + min(pcol) * CAST(0.00001 AS DOUBLE), 6) AS west, round(52 - (max(prow) + 1) * CAST(0.00001 AS DOUBLE), 6) AS south,
  round(13 + (max(pcol) + 1) * CAST(0.00001 AS DOUBLE), 6) AS east, round(52 - min(prow) * CAST(0.00001 AS DOUBLE), 6) AS north, CAST(9 AS BIGINT) AS geohash_length
FROM px WHERE scene_id % 5 <> 0 GROUP BY scene_id, object_id""")
def _(t):
    k = F.col("s_suppkey")
    scenes = t.supplier.select(k.alias("scene_id"), F.when(k % 5 != 0, geo.affine(1e-5, 0, 13, 0, -1e-5, 52)).alias("transform"))
    v = outlines.vectorise_masks(_object_runs(t), scenes)
    v = v.select("scene_id", "object_id", "area_pixels", geometry.geom_bbox("geom").alias("b"), F.length("geohash").cast("long").alias("geohash_length"))
    return v.select("scene_id", "object_id", "area_pixels", F.round("b.xmin", 6).alias("west"), F.round("b.ymin", 6).alias("south"),
                    F.round("b.xmax", 6).alias("east"), F.round("b.ymax", 6).alias("north"), "geohash_length")


@query("r14_rasterise", "detections", """
SELECT scene_id, CAST(sum(w * h) AS BIGINT) AS pixels, CAST(sum(h) AS BIGINT) AS runs FROM detections GROUP BY scene_id""")
def _(t):
    runs = masks.rasterise_boxes(_detections(t), ["scene_id", "object_id"], 1000, 1000)
    return runs.groupBy("scene_id").agg(F.sum(F.col("c1") - F.col("c0")).alias("pixels"), F.count(F.lit(1)).alias("runs"))


@query("r14_rasterise_geometry", "map_polygons", """
SELECT osm_id, CAST(w * h AS BIGINT) AS pixels, CAST(h AS BIGINT) AS runs FROM map_polygons""")
def _(t):
    shapes = _polygons(t).select("osm_id", geometry.box_geom("x0", "y0", "x1", "y1").alias("geom"))
    runs = masks.rasterise_geometry(shapes, ["osm_id"], 1000, 1000)
    return runs.groupBy("osm_id").agg(F.sum(F.col("c1") - F.col("c0")).alias("pixels"), F.count(F.lit(1)).alias("runs"))


@query("r20_label_anchors", "detections", """
SELECT object_id, concat(upper(concept[1]), substr(concept, 2), ' ', CAST(object_id AS VARCHAR)) AS text, x0 + w / CAST(2 AS DOUBLE) AS x, y0 + h / CAST(2 AS DOUBLE) AS y
FROM detections WHERE object_id % 6 <> 0""")
def _(t):
    from orthomark.functions.labels import default_label
    d = _detections(t).select("object_id", default_label("concept", "object_id").alias("label"), F.col("concept").alias("visual_class"),
                              (F.col("object_id") % 6 == 0).alias("rejected"), geometry.box_geom("x0", "y0", "x1", "y1").alias("geom"))
    return outlines.label_anchors(d, ["object_id"]).select("object_id", "text", "anchor.x", "anchor.y")


@query("r21_foreground_mask", "mask_pixels", """
SELECT scene_id, prow, pcol, CASE WHEN NOT valid THEN 255 WHEN before_hit OR after_hit THEN 1 ELSE 0 END AS value FROM mask_pixels""")
def _(t):
    return masks.foreground_mask(t.mask_pixels.select("scene_id", "prow", "pcol", "valid"), _before(t).unionByName(_after(t)))
