"""Registered queries: geographic scalar functions."""

from pyspark.sql import functions as F

from orthomark.functions import geo, geometry, labels
from orthomark.plans.registry import query

B32 = geo.GEOHASH_ALPHABET


@query("c1_valid_bbox", "view_requests", """
SELECT request_id, reason IS NULL AS ok, reason FROM (
  SELECT request_id, CASE
    WHEN NOT (west >= -180 AND west < east AND east <= 180 AND south >= -90 AND south < north AND north <= 90)
      THEN 'invalid bounds'
    WHEN (east - west) * 111.32 * cos(radians((south + north) / 2)) * (north - south) * 111.32 > 5
      THEN 'area too large' END AS reason
  FROM view_requests)""")
def _(t):
    box = ("west", "south", "east", "north")
    return t.view_requests.select("request_id", geo.valid_bbox(*box, max_km2=5).alias("ok"),
                                  geo.bbox_reason(*box, max_km2=5).alias("reason"))


@query("c2_bbox_area_km2", "view_requests", """
SELECT request_id, round((east - west) * 111.32 * cos(radians((south + north) / 2)) * (north - south) * 111.32, 6)
  + CAST(0 AS DOUBLE) AS area_km2 FROM view_requests""")
def _(t):
    return t.view_requests.select("request_id", (F.round(
        geo.bbox_area_km2("west", "south", "east", "north"), 6) + F.lit(0.0)).alias("area_km2"))


@query("c3_bounds_around", "geo_points", """
, d AS (SELECT point_id, lon, lat, CAST(150 AS DOUBLE) / 111320 AS dy,
   (CAST(150 AS DOUBLE) / 111320) / greatest(cos(radians(lat)), CAST(0.001 AS DOUBLE)) AS dx FROM geo_points)
SELECT point_id, round(greatest(-180, lon - dx), 6) AS west, round(greatest(-90, lat - dy), 6) AS south,
       round(least(180, lon + dx), 6) AS east, round(least(90, lat + dy), 6) AS north FROM d""")
def _(t):
    box = t.geo_points.select("point_id", geo.bounds_around("lon", "lat", 150).alias("b"))
    return box.select("point_id", *[F.round(F.col(f"b.{k}"), 6).alias(k) for k in ("west", "south", "east", "north")])


@query("c4_geohash_encode", "geo_points", f"""
, cells AS (SELECT point_id, CAST(floor((lon + 180) / 360 * 8388608) AS BIGINT) AS x,
                   CAST(floor((lat + 90) / 180 * 4194304) AS BIGINT) AS y FROM geo_points),
digits AS (SELECT point_id, i, sum((CASE WHEN (5 * i + j) % 2 = 0 THEN (x >> (22 - (5 * i + j) // 2)) & 1
             ELSE (y >> (21 - (5 * i + j) // 2)) & 1 END) * (1 << (4 - j))) AS v
  FROM cells, range(9) AS a(i), range(5) AS b(j) GROUP BY point_id, i)
SELECT point_id, string_agg(substr('{B32}', CAST(v AS BIGINT) + 1, 1), '' ORDER BY i) AS geohash
FROM digits GROUP BY point_id""")
def _(t):
    return t.geo_points.select("point_id", geo.geohash_encode("lat", "lon").alias("geohash"))


@query("c5_geohash_decode", "geo_points", """
, bits AS (SELECT point_id, lon, lat, 1 + point_id % 9 AS n FROM geo_points),
sizes AS (SELECT *, CAST(pow(2, CAST((5 * n + 1) // 2 AS DOUBLE)) AS DOUBLE) AS nx, CAST(pow(2, CAST(5 * n // 2 AS DOUBLE)) AS DOUBLE) AS ny FROM bits),
cells AS (SELECT *, floor((lon + 180) / 360 * nx) AS x, floor((lat + 90) / 180 * ny) AS y FROM sizes)
SELECT point_id, round(-180 + x * (360 / nx), 6) AS west, round(-90 + y * (180 / ny), 6) AS south,
       round(-180 + (x + 1) * (360 / nx), 6) AS east, round(-90 + (y + 1) * (180 / ny), 6) AS north FROM cells""")
def _(t):
    text = F.substr(geo.geohash_encode("lat", "lon"), F.lit(1), (1 + F.col("point_id") % 9).cast("int"))
    # Upper case and blanks are accepted by the decoder.
    box = t.geo_points.select("point_id", geo.geohash_decode(F.concat(F.lit(" "), F.upper(text))).alias("b"))
    return box.select("point_id", *[F.round(F.col(f"b.{k}"), 6).alias(k) for k in ("west", "south", "east", "north")])


@query("c6_mercator", "geo_points", """
, m AS (SELECT point_id, 6378137 * radians(lon) AS x, 6378137 * ln(tan(pi() / 4 + radians(lat) / 2)) AS y FROM geo_points)
SELECT point_id, round(x, 3) AS x, round(y, 3) AS y, round(degrees(x / 6378137), 6) AS lon,
       round(degrees(2 * atan(exp(y / 6378137)) - pi() / 2), 6) + CAST(0 AS DOUBLE) AS lat FROM m""")
def _(t):
    m = t.geo_points.select("point_id", geo.mercator_x("lon").alias("x"), geo.mercator_y("lat").alias("y"))
    return m.select("point_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"),
                    F.round(geo.from_mercator_lon("x"), 6).alias("lon"),
                    (F.round(geo.from_mercator_lat("y"), 6) + F.lit(0.0)).alias("lat"))


@query("c7_tile_bounds", "geo_points", """
, tiles AS (SELECT point_id, 7 + point_id % 15 AS z, point_id * 13 % 700 AS x, point_id * 7 % 700 AS y FROM geo_points),
spans AS (SELECT *, z BETWEEN 8 AND 20 AND x < pow(2, z) AND y < pow(2, z) AS ok,
          2 * CAST(20037508.342789244 AS DOUBLE) / pow(2, CAST(z AS DOUBLE)) AS span FROM tiles)
SELECT point_id, CASE WHEN ok THEN round(x * span - CAST(20037508.342789244 AS DOUBLE), 3) END AS xmin,
  CASE WHEN ok THEN round(CAST(20037508.342789244 AS DOUBLE) - (y + 1) * span, 3) END AS ymin,
  CASE WHEN ok THEN round((x + 1) * span - CAST(20037508.342789244 AS DOUBLE), 3) END AS xmax,
  CASE WHEN ok THEN round(CAST(20037508.342789244 AS DOUBLE) - y * span, 3) END AS ymax FROM spans""")
def _(t):
    p = F.col("point_id")
    tile = t.geo_points.select("point_id", geo.tile_bounds(7 + p % 15, p * 13 % 700, p * 7 % 700).alias("b"))
    return tile.select("point_id", *[F.round(F.col(f"b.{k}"), 3).alias(k) for k in ("xmin", "ymin", "xmax", "ymax")])


@query("c8_pixel_to_geo", "detections", """
SELECT object_id, round(13 + x0 * CAST(0.00001 AS DOUBLE), 6) AS west, round(52 - (y0 + h) * CAST(0.00001 AS DOUBLE), 6) AS south,
  round(13 + (x0 + w) * CAST(0.00001 AS DOUBLE), 6) AS east, round(52 - y0 * CAST(0.00001 AS DOUBLE), 6) AS north FROM detections""")
def _(t):
    transform = geo.affine(1e-5, 0, 13, 0, -1e-5, 52)
    box = geometry.box_geom("x0", "y0", F.col("x0") + F.col("w"), F.col("y0") + F.col("h"))
    located = geometry.map_vertices(box, lambda x, y: geo.pixel_x(transform, x, y), lambda x, y: geo.pixel_y(transform, x, y))
    d = t.detections.select("object_id", geometry.geom_bbox(located).alias("b"))
    return d.select("object_id", F.round("b.xmin", 6).alias("west"), F.round("b.ymin", 6).alias("south"),
                    F.round("b.xmax", 6).alias("east"), F.round("b.ymax", 6).alias("north"))


@query("c9_bounds_transform", "view_requests", """
, s AS (SELECT request_id, west, north, (east - west) / (100 + request_id % 400) AS xres,
        (north - south) / (80 + request_id % 300) AS yres, request_id % 50 AS c, request_id % 30 AS r,
        west < east AND request_id % 11 <> 0 AS ok FROM view_requests)
SELECT request_id, CASE WHEN ok THEN round(xres * 1000000, 6) END AS a, CASE WHEN ok THEN round(west + xres * c + CAST(0.000000001 AS DOUBLE), 6) END AS c,
  CASE WHEN ok THEN round(-yres * 1000000, 6) END AS e, CASE WHEN ok THEN round(north - yres * r + CAST(0.000000001 AS DOUBLE), 6) END AS f FROM s""")
def _(t):
    i = F.col("request_id")
    nudge = F.lit(1e-9)  # keeps exact decimal ties away from the engines' rounding rules
    tr = t.view_requests.select("request_id", geo.bounds_transform(
        "west", "south", "east", "north", 100 + i % 400, 80 + i % 300, i % 50, i % 30,
        georeferenced=i % 11 == 0).alias("t"))
    return tr.select("request_id", F.round(F.col("t.a") * 1000000, 6).alias("a"), F.round(F.col("t.c") + nudge, 6).alias("c"),
                     F.round(F.col("t.e") * 1000000, 6).alias("e"), F.round(F.col("t.f") + nudge, 6).alias("f"))


@query("c10_geometry_measures", "detections", """
SELECT object_id, CAST(w * h AS DOUBLE) AS area, CAST(x0 AS DOUBLE) AS xmin, CAST(y0 AS DOUBLE) AS ymin,
  CAST(x0 + w AS DOUBLE) AS xmax, CAST(y0 + h AS DOUBLE) AS ymax,
  x0 + w / CAST(2 AS DOUBLE) AS px, y0 + h / CAST(2 AS DOUBLE) AS py FROM detections""")
def _(t):
    box = geometry.box_geom("x0", "y0", F.col("x0") + F.col("w"), F.col("y0") + F.col("h"))
    d = t.detections.select("object_id", box.alias("g"))
    d = d.select("object_id", geometry.geom_area("g").alias("area"), geometry.geom_bbox("g").alias("b"),
                 geometry.representative_point("g").alias("p"))
    return d.select("object_id", "area", "b.*", F.col("p.x").alias("px"), F.col("p.y").alias("py"))


@query("c11_local_equal_area", "detections", """
, g AS (SELECT object_id, 13 + x0 * CAST(0.00001 AS DOUBLE) AS lon, 52 + y0 * CAST(0.00001 AS DOUBLE) AS lat,
   13 + (x0 + w / CAST(2 AS DOUBLE)) * CAST(0.00001 AS DOUBLE) AS lon0, 52 + (y0 + h / CAST(2 AS DOUBLE)) * CAST(0.00001 AS DOUBLE) AS lat0 FROM detections),
k AS (SELECT *, sqrt(2 / (1 + sin(radians(lat0)) * sin(radians(lat)) + cos(radians(lat0)) * cos(radians(lat)) * cos(radians(lon - lon0)))) AS k FROM g)
SELECT object_id, round(CAST(6371007.1809 AS DOUBLE) * k * cos(radians(lat)) * sin(radians(lon - lon0)), 3) AS x,
  round(CAST(6371007.1809 AS DOUBLE) * k * (cos(radians(lat0)) * sin(radians(lat)) - sin(radians(lat0)) * cos(radians(lat)) * cos(radians(lon - lon0))), 3) AS y
FROM k""")
def _(t):
    step = F.lit(1e-5)
    d = t.detections.select("object_id", (13 + F.col("x0") * step).alias("lon"), (52 + F.col("y0") * step).alias("lat"),
                            (13 + (F.col("x0") + F.col("w") / 2) * step).alias("lon0"),
                            (52 + (F.col("y0") + F.col("h") / 2) * step).alias("lat0"))
    at = ("lon", "lat", "lon0", "lat0")
    return d.select("object_id", F.round(geo.laea_x(*at), 3).alias("x"), F.round(geo.laea_y(*at), 3).alias("y"))


@query("c12_address_from_tags", "map_points", """
SELECT osm_id, CASE WHEN osm_id % 17 = 0 THEN concat('Full address ', CAST(osm_id AS STRING))
  ELSE nullif(concat_ws(', ', housenumber, nullif(street, ''), CASE WHEN osm_id % 4 = 0 THEN NULL ELSE '10115' END, city), '') END AS address
FROM map_points""")
def _(t):
    i = F.col("osm_id")
    tags = F.create_map(
        F.lit("addr:full"), F.when(i % 17 == 0, F.concat(F.lit("Full address "), i.cast("string"))).otherwise(""),
        F.lit("addr:housenumber"), F.col("housenumber"), F.lit("addr:street"), F.col("street"),
        F.lit("addr:postcode"), F.when(i % 4 == 0, "").otherwise("10115"), F.lit("addr:city"), F.col("city"))
    return t.map_points.select("osm_id", labels.address_from_tags(tags).alias("address"))


@query("c13_address_from_place", "map_points", """
SELECT osm_id, nullif(concat_ws(', ', housenumber, street, city, CASE WHEN osm_id % 3 = 1 THEN 'State' END), '') AS address FROM map_points""")
def _(t):
    state = F.when(F.col("osm_id") % 3 == 1, "State").otherwise("")
    return t.map_points.select("osm_id", labels.address_from_place(
        {"housenumber": F.col("housenumber"), "street": F.col("street"), "city": F.col("city"), "state": state}).alias("address"))


@query("c14_display_label", "detections", """
SELECT object_id, CASE WHEN object_id % 7 = 0 THEN 'Reviewed' WHEN object_id % 7 = 1 THEN 'Name' WHEN object_id % 7 = 2 THEN '5 Road'
  WHEN object_id % 7 = 3 THEN 'Hall (candidate)' WHEN object_id % 7 = 4 THEN '6 Road (candidate)'
  WHEN object_id % 7 = 5 THEN concept ELSE 'Mapped feature' END AS label FROM detections""")
def _(t):
    k = F.col("object_id") % 7
    return t.detections.select("object_id", labels.display_label({
        "reviewed_label": F.when(k == 0, "Reviewed").otherwise(""), "name": F.when(k == 1, "Name"),
        "address": F.when(k == 2, "5 Road"), "candidate_name": F.when(k == 3, "Hall").otherwise(""),
        "candidate_address": F.when(k == 4, "6 Road"), "label": F.when(k == 5, F.col("concept"))}).alias("label"))


@query("c15_default_label", "detections", """
SELECT object_id, concat(upper(substr(concept, 1, 1)), lower(substr(concept, 2)), ' ', CAST(object_id AS STRING)) AS label FROM detections""")
def _(t):
    return t.detections.select("object_id", labels.default_label("concept", "object_id").alias("label"))


@query("c16_request_key", "fetch_log", """
SELECT request_id, sha256(concat('["https://example.org/api/", {"limit": "6", "q": "', request_text, '"}, null]')) AS request_key FROM fetch_log""")
def _(t):
    params = F.create_map(F.lit("q"), F.col("request_text"), F.lit("limit"), F.lit("6"))
    return t.fetch_log.select("request_id", labels.request_key(F.lit("https://example.org/api/"), params).alias("request_key"))


@query("c17_provider_for", "view_requests geo_points", """
, boxes AS (SELECT request_id, west, south, east, north FROM view_requests
  UNION ALL SELECT -1 - point_id, lon, lat, lon + CAST(0.01 AS DOUBLE), lat + CAST(0.01 AS DOUBLE) FROM geo_points
  UNION ALL SELECT -1000000000 - point_id, lon, CAST(85 AS DOUBLE), lon + CAST(0.01 AS DOUBLE), CAST(86 AS DOUBLE) FROM geo_points),
picked AS (SELECT *, NOT (west >= -180 AND west < east AND east <= 180 AND south < north) AS bad,
  CASE WHEN west >= CAST(13.08 AS DOUBLE) AND east <= CAST(13.77 AS DOUBLE) AND south >= CAST(52.32 AS DOUBLE) AND north <= CAST(52.69 AS DOUBLE) THEN 'berlin'
       WHEN west >= -125 AND east <= -66 AND south >= 24 AND north <= 50 THEN 'naip' END AS id FROM boxes)
SELECT request_id, CASE WHEN bad OR north > 85.05112878 THEN NULL ELSE id END AS source_id,
  CASE WHEN bad THEN 'invalid bounds' WHEN north > 85.05112878 THEN 'latitude out of range' WHEN id IS NULL THEN 'no coverage' END AS reason FROM picked""")
def _(t):
    p = t.geo_points
    west, step = F.col("lon"), F.lit(0.01)
    boxes = (t.view_requests.select("request_id", "west", "south", "east", "north")
             .unionByName(p.select((-1 - F.col("point_id")).alias("request_id"), west.alias("west"), F.col("lat").alias("south"),
                                   (west + step).alias("east"), (F.col("lat") + step).alias("north")))
             .unionByName(p.select((-1000000000 - F.col("point_id")).alias("request_id"), west.alias("west"), F.lit(85.0).alias("south"),
                                   (west + step).alias("east"), F.lit(86.0).alias("north"))))
    s = boxes.select("request_id", geo.source_for("west", "south", "east", "north").alias("s"))
    return s.select("request_id", F.col("s.id").alias("source_id"), F.col("s.reason").alias("reason"))


@query("c18_normalise_concepts", "query_log", """
, prompts AS (SELECT query_id, CASE query_id % 4 WHEN 0 THEN concat(' building, tree ,', text, ',building') WHEN 1 THEN ' , '
   WHEN 2 THEN 'a,b,c,d,e' ELSE text END AS prompt FROM query_log),
items AS (SELECT query_id, prompt, trim(item) AS item, pos FROM prompts, unnest(string_split(prompt, ',')) WITH ORDINALITY AS u(item, pos)),
firsts AS (SELECT query_id, item, min(pos) AS pos FROM items WHERE item <> '' GROUP BY query_id, item)
SELECT p.query_id, coalesce(string_agg(item, '|' ORDER BY pos), '') AS concepts,
  CASE WHEN count(item) = 0 THEN 'no concept' WHEN count(item) > 4 THEN 'too many concepts' END AS reason
FROM prompts p LEFT JOIN firsts f ON p.query_id = f.query_id GROUP BY p.query_id""")
def _(t):
    k = F.col("query_id") % 4
    prompt = (F.when(k == 0, F.concat(F.lit(" building, tree ,"), F.col("text"), F.lit(",building"))).when(k == 1, " , ")
              .when(k == 2, "a,b,c,d,e").otherwise(F.col("text")))
    p = t.query_log.select("query_id", prompt.alias("prompt"))
    return p.select("query_id", F.array_join(labels.concept_list("prompt"), "|").alias("concepts"),
                    labels.concept_reason("prompt").alias("reason"))


@query("c19_outcome_message", "detections", f"""
SELECT object_id, CASE WHEN object_id % 3 > 0 THEN '{labels.CANDIDATES}' ELSE 'unmatched' END AS match_status,
  CASE WHEN score < 1 THEN '{labels.PARTIAL_COVERAGE}' END AS warning FROM detections""")
def _(t):
    return t.detections.select("object_id", labels.match_status(F.col("object_id") % 3).alias("match_status"),
                               labels.coverage_warning("score").alias("warning"))
