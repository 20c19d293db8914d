"""Known cases of the single operators."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthomark.functions import geo, geometry, labels, requests
from orthomark.functions.numbers import round_exact
from orthomark.functions.ring_overlap import overlap, ring_edges
from orthomark.functions.sql import register_table_functions
from orthomark.operators import evidence, masks, merging, outlines, raster, registration, segmentation, training, views
from orthomark.plans import jobs
from orthomark.sources import readers, writers


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("text, expected", [
    ("mark all hospitals in Berlin", dict(intent="features", category="hospitals", area="Berlin")),
    ("where are schools in this area?", dict(intent="features", category="schools", area=None)),
    ("where is house number 5 Starmansrteen", dict(intent="address", query="5 Starmansrteen")),
    ("mark hiking routes", dict(category="hiking")),
    ("directions from Berlin to Potsdam", dict(intent="route")),
    ("52.52,13.405", dict(intent="coordinates", query="52.52,13.405")),
    ("detect buildings and trees here", dict(intent="segment", prompt="building, tree", area=None, source="imagery")),
    ("show results without mapped addresses", dict(intent="filter", filter="missing_address")),
    ("hash=U33DC1", dict(intent="geohash", query="u33dc1")),
    ("find hospilarts near the river", dict(category="hospitals", area="the river")),
    ("segment hospitals in the selected box", dict(intent="features", category="hospitals", area="the selected box", source="combined")),
    ("outline sheds in selected box", dict(intent="segment", area=None, prompt="sheds")),
    ("énormités à éno addresses", dict(intent="address")),
])
def test_parse_request(spark, text, expected):
    plan = one(spark, requests.parse_request(F.lit(text)).alias("p"))["p"]
    assert {k: plan[k] for k in expected} == expected


def test_parse_request_limits(spark):
    assert one(spark, requests.parse_request(F.lit("   ")).alias("p"))["p"] is None
    assert one(spark, requests.request_reason(F.repeat(F.lit("x"), 1001)).alias("r"))["r"] == "query too long"


def test_coordinates_are_latitude_longitude(spark):
    p = one(spark, requests.parse_coordinates(F.lit("52.52,13.405")).alias("p"))["p"]
    assert (p["lon"], p["lat"]) == (13.405, 52.52)
    assert one(spark, requests.parse_coordinates(F.lit("95,13")).alias("p"))["p"] is None


@pytest.mark.parametrize("box", [(170, 0, -170, 10), (-180, -80, 180, 80), (0, 0, float("nan"), 1)])
def test_bad_boxes(spark, box):
    assert one(spark, geo.bbox_reason(*[F.lit(float(v)) for v in box], max_km2=25).alias("r"))["r"]


def test_geohash(spark):
    row = one(spark, geo.geohash_encode(F.lit(57.64911), F.lit(10.40744), 11).alias("h"), geo.geohash_decode(F.lit(" U33DC1 ")).alias("b"),
              geo.geohash_decode(F.lit("aio")).alias("bad"))
    assert row["h"] == "u4pruydqqvj" and row["bad"] is None
    assert row["b"]["west"] < row["b"]["east"] and row["b"]["south"] < row["b"]["north"]
    register_table_functions(spark)
    cell = spark.sql("SELECT * FROM geohash_cell('u33dc1')").first()
    assert [cell[k] for k in ("west", "south", "east", "north")] == pytest.approx([row["b"][k] for k in ("west", "south", "east", "north")])
    assert spark.sql("SELECT * FROM windows(2000, 900, 1008, 96)").count() == 3


@pytest.mark.parametrize("value", [0.15625, 0.08625, 0.08635, 0.35625, 0.12345, 0.5, 0.0, 1.0, 0.99999, 0.28125, 2 / 3])
def test_round_exact(spark, value):
    assert one(spark, round_exact(F.lit(value), 4).alias("r"))["r"] == round(value, 4)


def test_view_plans(spark):
    rows = [(1, 13.41, 52.52, 13.412, 52.521, .6), (2, -122.26, 37.871, -122.258, 37.872, .6), (3, 10., 48., 10.001, 48.001, .6),
            (4, 179., 10., -179., 11., .6), (5, -180., -80., 180., 80., .6)]
    r = spark.createDataFrame(rows, "request_id int, west double, south double, east double, north double, resolution_m double")
    planned = {x["request_id"]: x for x in views.plan_views(r).collect()}
    assert planned[1]["source_id"] == "berlin" and planned[1]["width"] > 200 and planned[1]["reason"] is None
    assert planned[2]["source_id"] == "naip" and planned[2]["reason"] is None
    assert all(planned[i]["reason"] for i in (3, 4, 5))
    assert views.plan_views(r, max_pixels=100).filter("request_id = 1").first()["reason"] == "too many pixels"


def test_mosaic_covers_the_view(spark):
    scenes = spark.createDataFrame([(1, 2100, 1500)], "scene_id long, width int, height int")
    tiles = views.mosaic_tiles(scenes).collect()
    assert len(tiles) == 6 and sum(t["w"] * t["h"] for t in tiles) == 2100 * 1500


def located(spark, rows):
    return spark.createDataFrame(rows, "scene_id long, key long, x0 double, y0 double, x1 double, y1 double, name string, address string")


def test_evidence_keeps_tenants_and_unknown_identity(spark):
    box = (13.4, 52.5, 13.4002, 52.5002)
    shape = geometry.box_geom("x0", "y0", "x1", "y1")
    detection = located(spark, [(1, 1, *box, None, None)]).withColumn("geom", shape).withColumnRenamed("key", "object_id")
    records = located(spark, [(1, 10, *box, "Mapped building", "5 Example Road"), (1, 11, 13.4001, 52.5001, 0., 0., "Tenant A", None),
                              (1, 12, 13.40015, 52.5001, 0., 0., "Tenant B", None)]).withColumnRenamed("key", "osm_id").withColumn("osm_type", F.lit("way"))
    records = records.withColumn("geom", F.when(F.col("osm_id") == 10, shape).otherwise(geometry.point_geom("x0", "y0")))
    line = located(spark, [(1, 13, *box, "Road", None)]).withColumnRenamed("key", "osm_id").withColumn("osm_type", F.lit("way")).withColumn(
        "geom", F.struct(F.lit("LineString").alias("kind"), shape["rings"].alias("rings")))
    found = evidence.match_evidence_geometry(detection, records.unionByName(line))
    full = evidence.collect_evidence(detection.drop("name", "address"), found).first()
    assert full["name"] is None and full["address"] is None and full["candidate_name"] == "Mapped building"
    assert [e["name"] for e in full["map_evidence"]] == ["Mapped building", "Tenant A", "Tenant B"]
    assert full["map_evidence"][0]["intersection_over_union"] == 1.0
    none = evidence.collect_evidence(detection.drop("name", "address"), found.filter("false")).first()
    assert none["match_status"] == "unmatched" and none["map_evidence"] == []


def test_ring_overlap():
    square = ring_edges([0, 10, 10, 0, 0], [0, 0, 10, 10, 0], [5])
    holed = ring_edges([5, 15, 15, 5, 5, 7, 7, 13, 13, 7], [5, 5, 15, 15, 5, 7, 13, 13, 7, 7], [5, 5])
    triangle = ring_edges([0, 10, 0, 0], [0, 0, 10, 0], [4])
    assert overlap(square, holed)[:3] == pytest.approx((100, 64, 16))
    assert overlap(square, triangle)[:3] == pytest.approx((100, 50, 50))
    assert overlap(square, ring_edges([10, 20, 20, 10, 10], [0, 0, 5, 5, 0], [5]))[2:] == (0, True)
    assert overlap(square, ring_edges([11, 20, 20, 11, 11], [0, 0, 5, 5, 0], [5]))[2:] == (0, False)


def test_windows_and_seam_merge(spark):
    """An object over a window seam becomes one, one in a far corner is found, neighbours stay."""
    scenes = spark.createDataFrame([(1, 450, 320)], "scene_id long, width int, height int")
    span = spark.range(320).select(F.lit(1).cast("long").alias("scene_id"), F.col("id").alias("prow"), F.explode(F.sequence(F.lit(0), F.lit(449))).alias("pcol"))
    bright = F.expr("(prow BETWEEN 80 AND 159 AND pcol BETWEEN 210 AND 279) OR (prow BETWEEN 285 AND 309 AND pcol BETWEEN 420 AND 444)")
    pixels = span.withColumn("grey", F.when(bright, 255.0).otherwise(0.0)).withColumn("valid", F.lit(True))
    found = jobs.segment_scenes(pixels, scenes, ["building"], segmentation.threshold_predictor(), ["grey"], 256, 64, min_pixels=1)
    rows = found.orderBy("object_id").collect()
    assert sorted(r["area_pixels"] for r in rows) == [625, 5600] and [r["object_id"] for r in rows] == [1, 2]
    assert rows[0]["label"] == "Building 1"
    transform = spark.createDataFrame([(1,)], "scene_id long").withColumn("transform", geo.affine(1e-5, 0, 13.4, 0, -1e-5, 52.5))
    assert {f["geom"]["kind"] for f in jobs.locate_objects(found, transform).collect()} == {"Polygon"}
    two = spark.createDataFrame([(1, "building", 0, 0, .9, 0, 10), (1, "building", 0, 1, .8, 11, 20)],
                                "scene_id long, concept string, window_id long, instance_id long, score double, x0 long, x1 long")
    two = two.withColumn("y0", F.lit(0)).withColumn("y1", F.lit(10)).withColumn("rects", merging.box_rects())
    assert merging.merge_across_windows(two).count() == 2


def test_mask_becomes_a_located_feature(spark):
    runs = spark.createDataFrame([(1, 1, r, 10, 20) for r in range(10, 20)], "scene_id long, object_id long, prow long, c0 long, c1 long")
    scenes = spark.createDataFrame([(1,)], "scene_id long").withColumn("transform", geo.shift_transform(geo.affine(1e-5, 0, 13.4, 0, -1e-5, 52.5), F.lit(20), F.lit(30)))
    f = outlines.vectorise_masks(runs, scenes).collect()
    assert len(f) == 1 and f[0]["area_pixels"] == 100 and len(f[0]["geom"]["rings"][0][0]) == 5
    assert f[0]["geom"]["rings"][0][0][0]["x"] == pytest.approx(13.4 + 30e-5)
    nowhere = scenes.withColumn("transform", F.lit(None).cast(scenes.schema["transform"].dataType))
    assert outlines.vectorise_masks(runs, nowhere).count() == 0


def test_outline_keeps_holes_and_corner_contacts(spark):
    rows = [(1, 0, 0, 3), (1, 1, 0, 1), (1, 1, 2, 3), (1, 2, 0, 3), (2, 0, 0, 1), (2, 1, 1, 2)]
    runs = spark.createDataFrame(rows, "object_id long, prow long, c0 long, c1 long")
    o = {r["object_id"]: r for r in outlines.outlines(runs, ["object_id"]).select("object_id", "geom", geometry.geom_area("geom").alias("area")).collect()}
    assert o[1]["area"] == 8 and len(o[1]["geom"]["rings"][0]) == 2
    assert o[2]["area"] == 2 and o[2]["geom"]["kind"] == "MultiPolygon"


def test_bounds_transform(spark):
    t = one(spark, geo.bounds_transform(F.lit(13.4), F.lit(52.5), F.lit(13.42), F.lit(52.501), F.lit(1200), F.lit(80)).alias("t"))["t"]
    assert (t["a"] * 1200 + t["c"], t["e"] * 80 + t["f"]) == pytest.approx((13.42, 52.5))


def grid(spark, height, width):
    return spark.range(height).select(F.lit(1).cast("long").alias("scene_id"), F.col("id").alias("prow"),
                                      F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("pcol"))


def test_change_detection(spark):
    pixels = grid(spark, 180, 220).withColumn("valid", F.lit(True))
    before = pixels.withColumn("hit", F.lit(False))
    after = pixels.withColumn("hit", F.expr("prow BETWEEN 50 AND 89 AND pcol BETWEEN 60 AND 109"))
    result = jobs.compare_dates(before, after, 220, 180)
    meta = result["metadata"].first()
    assert (meta["added_pixels"], meta["removed_pixels"], meta["valid_overlap_pixels"]) == (2000, 0, 180 * 220)
    assert [r["area_pixels"] for r in result["regions"].collect()] == [2000]
    same = jobs.compare_dates(after, after, 220, 180)["metadata"].first()
    assert (same["added_pixels"], same["removed_pixels"]) == (0, 0)


def test_alpha_limits_the_overlap(spark):
    bands = grid(spark, 80, 80).withColumn("band", F.explode(F.sequence(F.lit(1), F.lit(4))))
    bands = bands.withColumn("value", F.expr("CASE WHEN band < 4 THEN 150.0D WHEN prow < 10 THEN 0.0D ELSE 255.0D END"))
    valid = raster.valid_pixels(bands, 4, alpha_band=4)
    assert valid.filter("valid").count() == 70 * 80 and valid.filter("prow < 10 AND valid").count() == 0
    stats = masks.overlap_stats(valid, warped=False).first()
    assert stats["valid_overlap_pixels"] == 5600 and stats["overlap_fraction"] == 0.875


def test_geographic_leakage(spark):
    rows = [(f"{i}.png", str(i % 2), "train" if i < 2 else "val", "same_scene") for i in range(4)]
    manifest = spark.createDataFrame(rows, "path string, label string, split string, grp string")
    assert [r["grp"] for r in training.group_leakage(manifest).collect()] == ["same_scene"]
    assert {r["violation"] for r in training.manifest_checks(manifest).collect()} == {"geographic leakage"}
    only = manifest.filter("split = 'train' AND label = '1'").withColumn("grp", F.lit("a"))
    assert {r["violation"] for r in training.manifest_checks(only).collect()} == {"empty split", "fewer than two training classes"}


def test_shift_is_recovered(spark):
    rng = np.random.default_rng(42)
    b = rng.uniform(0, 400, (200, 2))
    a = b + [12, 7] + rng.normal(0, .3, b.shape)
    a[:60] = rng.uniform(0, 400, (60, 2))
    rows = [(1, "auto", *map(float, p), *map(float, q)) for p, q in zip(b, a)] + [(2, "auto", 1., 1., 2., 2.)]
    fit = {r["pair_id"]: r for r in registration.align_pairs(spark.createDataFrame(rows, "pair_id long, mode string, bx double, by double, ax double, ay double")).collect()}
    m = np.array(fit[1]["matrix"]).reshape(3, 3)
    assert np.allclose(m[:2, 2], [12, 7], atol=2) and fit[1]["registration_error_px"] < 2 and fit[1]["matched_landmarks"] >= 130
    assert fit[2]["reason"] == "too few matches"


def test_manual_landmarks(spark):
    corners = [(.1, .1), (.9, .1), (.9, .9), (.1, .9)]
    points = spark.createDataFrame([(p, *c, *c, 200, 200, 200, 200) for p in (1, 2) for c in (corners if p == 1 else corners[:3])] +
                                   [(3, 1.5, .5, .5, .5, 200, 200, 200, 200)] * 4,
                                   "pair_id long, bx double, by double, ax double, ay double, before_width int, before_height int, after_width int, after_height int")
    fit = {r["pair_id"]: r for r in registration.align_pairs(registration.manual_landmarks(points)).collect()}
    assert fit[1]["reason"] is None and np.allclose(fit[1]["matrix"], np.eye(3).ravel(), atol=1e-6)
    assert fit[2]["reason"] == "add four point pairs or more" and fit[3]["reason"] == "landmarks must be finite"
    image = grid(spark, 20, 20).withColumn("value", (F.col("prow") * 20 + F.col("pcol")).cast("double"))
    same = raster.warp(image, grid(spark, 20, 20).withColumn("inverse", F.array(*[F.lit(float(v)) for v in np.eye(3).ravel()])))
    assert same.join(image.withColumnRenamed("value", "v"), ["scene_id", "prow", "pcol"]).filter("abs(value - v) > 1e-9").count() == 0


def png(path, pixels):
    """Minimal 8-bit PNG (RGB or RGBA)."""
    h, w, n = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if n == 3 else 6, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_read_images(spark, tmp_path):
    rgb = np.random.default_rng(1).integers(0, 255, (6, 9, 3), dtype=np.uint8)
    rgba = np.dstack([rgb, np.full((6, 9), 255, np.uint8)])
    rgba[0, -1, 3] = 0
    png(tmp_path / "plain.png", rgb)
    png(tmp_path / "alpha.png", rgba)
    scenes = spark.createDataFrame([("plain.png",)], "file string").withColumn("transform", geo.affine(1, 0, 0, 0, -1, 0))
    images, pixels = readers.read_images(spark, str(tmp_path), scenes)
    assert {(r["file"], r["width"], r["height"], r["transform"] is not None) for r in images.collect()} == {("plain.png", 9, 6, True), ("alpha.png", 9, 6, False)}
    for r in pixels.filter("file = 'plain.png'").collect():
        assert [r["red"], r["green"], r["blue"]] == rgb[r["prow"], r["pcol"]].tolist() and r["valid"]
    assert [(r["prow"], r["pcol"]) for r in pixels.filter("file = 'alpha.png' AND NOT valid").collect()] == [(0, 8)]


def test_geojson_files_are_checked(spark, tmp_path):
    good = '{"type":"FeatureCollection","crs":{"name":"EPSG:4326"},"features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[13.4,52.5]},"properties":{"name":"A","n":1}},'
    good += '{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]]]},"properties":{}},{"type":"Feature","geometry":null,"properties":null}]}'
    for name, text in {"good": good, "pixel": '{"type":"FeatureCollection","coordinate_space":"image_pixels","features":[]}', "crs":
                       '{"type":"FeatureCollection","crs":"EPSG:3857","features":[]}', "other": '{"type":"Feature"}', "broken": "{"}.items():
        (tmp_path / f"{name}.geojson").write_text(text)
    features, rejected = readers.read_geojson(spark, str(tmp_path))
    rows = features.collect()
    assert {r["geom"]["kind"] if r["geom"] else None for r in rows} == {"Point", "MultiPolygon", None}
    assert [r["properties"] for r in rows if r["geom"] and r["geom"]["kind"] == "Point"] == [{"name": "A", "n": "1"}]
    assert {r["file"].rsplit("/", 1)[1].split(".")[0]: r["reason"] for r in rejected.collect()} == {
        "pixel": "pixel coordinates", "crs": "not WGS84", "other": "not a feature collection", "broken": "not a feature collection"}


def test_manifest_file(spark, tmp_path):
    (tmp_path / "manifest.csv").write_bytes("﻿path,label,split,group\n0.png,a,train,g1\n".encode())
    row = readers.read_manifest(spark, str(tmp_path / "manifest.csv")).first()
    assert row["path"] == str(tmp_path / "0.png") and row["grp"] == "g1"
    (tmp_path / "bad.csv").write_text("path,label\nx,y\n")
    with pytest.raises(ValueError, match="split, group"):
        readers.read_manifest(spark, str(tmp_path / "bad.csv"))


def test_runs_are_not_overwritten(spark, tmp_path):
    df = spark.range(3)
    writers.write_run(df, str(tmp_path), "r1")
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_run(df, str(tmp_path), "r1")
    writers.write_run(df, str(tmp_path), "r2")
    assert spark.read.parquet(str(tmp_path)).groupBy("run_id").count().count() == 2


def test_label_table_text(spark, tmp_path):
    df = spark.createDataFrame([(1, 'Say "hi"', .9, None), (2, None, 1.0, "5 Road")], "object_id long, reviewed_label string, score double, address string")
    writers.write_labels_csv(df.withColumn("visual_class", F.lit("tree")).coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text().splitlines()
    assert text[0] == '"object_id","label","visual_class","score","address","candidate_address","match_status","source"'
    assert text[1:] == ['"1","Say ""hi""","tree","0.9","","","",""', '"2","5 Road","tree","1","5 Road","","",""']


def test_percentile_stretch(spark):
    image = grid(spark, 10, 10).withColumn("value", (F.col("prow") * 10 + F.col("pcol")).cast("double")).withColumn("band", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    image = image.withColumn("value", F.when(F.expr("prow = 0 AND pcol = 0"), None).when(F.col("band") == 3, 7.0).otherwise(F.col("value")))
    out = {(r["band"], r["prow"], r["pcol"]): r["value"] for r in raster.percentile_stretch(image, 3).collect()}
    values = np.arange(1, 100, dtype=float)
    low, high = np.percentile(values, [2, 98])
    expected = (np.clip((values - low) / (high - low), 0, 1) * 255).astype(np.uint8)
    assert [out[(1, v // 10, v % 10)] for v in range(1, 100)] == expected.tolist()
    assert out[(1, 0, 0)] == 0 and out[(3, 5, 5)] == 0


def test_labels(spark):
    row = one(spark, labels.display_label({"candidate_name": F.lit("Hall")}).alias("a"), labels.display_label({}).alias("b"),
              labels.concept_reason(F.lit(" , ")).alias("c"), labels.default_label(F.lit("swimming POOL"), F.lit(3)).alias("d"))
    assert (row["a"], row["b"], row["c"], row["d"]) == ("Hall (candidate)", "Mapped feature", "no concept", "Swimming pool 3")
