"""Distributed forms against brute force, with hot keys and awkward sizes."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from orthomark.functions import requests
from orthomark.operators import components, descriptors, evidence, lookups, masks, merging, ordering, registration
from orthomark.operators.grid_join import overlapping_pairs
from orthomark.sources import readers
from orthomark.streaming import jobs as streams

BOXES = "scene_id long, key long, x0 long, y0 long, x1 long, y1 long"


def boxes(rng, n, huge=0):
    side = rng.integers(1, 60, (n, 2))
    side[:huge] = rng.integers(2000, 9000, (huge, 2))
    corner = rng.integers(-300, 3000, (n, 2))
    scene = np.where(rng.random(n) < .5, 1, rng.integers(1, 6, n))  # one hot scene
    return [tuple(map(int, (s, k, x, y, x + w, y + h))) for k, (s, (x, y), (w, h)) in enumerate(zip(scene, corner, side))]


@pytest.mark.parametrize("levels, salt", [(1, 1), (None, 1), (4, 3)])
def test_overlapping_pairs(spark, levels, salt):
    rng = np.random.default_rng(7)
    a, b = boxes(rng, 250, 3), boxes(rng, 250, 3)
    pairs = overlapping_pairs(spark.createDataFrame(a, BOXES), spark.createDataFrame(b, BOXES), levels=levels, salt=salt)
    expected = sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5])
    assert sorted((r["key"], r["r_key"]) for r in pairs.collect()) == expected


@pytest.mark.parametrize("case", ["chain", "random", "star"])
def test_connected_components(spark, case):
    rng, n = np.random.default_rng(3), 400
    edges = {"chain": [(i, i + 1) for i in range(n)], "star": [(n, i) for i in range(n)],
             "random": [tuple(map(int, e)) for e in rng.integers(0, n, (330, 2))]}[case]
    ids = rng.permutation(n + 1)
    # Scattered ids put the parts of a component into different partitions.
    rows = [(g, int(ids[a]) << 38, int(ids[b]) << 38) for a, b in edges for g in (1, 2) if a != b]
    out = components.connected_components(spark.createDataFrame(rows, "g int, a long, b long"), ["g"]).collect()
    codes = np.array([(ids[a], ids[b]) for a, b in edges if a != b])
    root = components.roots_of(codes[:, 0], codes[:, 1], n + 1)
    expected = {(g, int(v) << 38): int(root[v]) << 38 for g in (1, 2) for v in np.unique(codes)}
    assert {(r["g"], r["node"]): r["component"] for r in out} == expected and len(out) == len(expected)


def test_star_steps_connect_partitions(spark, monkeypatch):
    """Edges scattered over partitions: the contraction inside them is not enough."""
    monkeypatch.setattr(components, "spread", lambda df, *keys: df.repartition(6))
    rows = [(1, i, i + 1) for i in range(0, 60) if i != 30]
    out = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(rows, "g int, a long, b long"), ["g"]).collect()}
    assert out == {i: 0 if i <= 30 else 31 for i in range(61)}


def brute_merge(items, overlap):
    """Every instance against everything merged so far, on sets of pixels."""
    merged = []
    for item in sorted(items, key=lambda i: (-i[2], i[0], i[1])):
        pixels, score, members = item[3], item[2], 1
        hits = [m for m in merged if len(pixels & m[0]) / min(len(pixels), len(m[0])) >= overlap]
        for m in hits:
            pixels, score, members = pixels | m[0], max(score, m[1]), members + m[2]
            merged.remove(m)
        merged.append((pixels, score, members))
    return sorted((m[1], len(m[0]), m[2]) for m in merged)


@pytest.mark.parametrize("seed, copies, tile", [(1, 0, 5), (2, 0, 16), (3, 60, 16), (3, 60, 1024)])
def test_merge_across_windows(spark, seed, copies, tile):
    rng, rows, items = np.random.default_rng(seed), [], []
    for k in range(140 + copies):
        if k < 140:
            x, y, w, h = (int(v) for v in (*rng.integers(0, 40, 2), *rng.integers(3, 14, 2)))
        else:  # copies of two boxes in changing order
            x, y, w, h = [(5, 5, 9, 9), (11, 6, 9, 8)][int(rng.integers(0, 2))]
        score = float(rng.integers(1, 20)) / 20
        rows.append((1, "tree", k % 5, k, score, x, y, x + w, y + h))
        items.append((k % 5, k, score, frozenset((i, j) for i in range(x, x + w) for j in range(y, y + h))))
    df = spark.createDataFrame(rows, "scene_id long, concept string, window_id long, instance_id long, score double, x0 long, y0 long, x1 long, y1 long")
    out = merging.merge_across_windows(df.withColumn("rects", merging.box_rects()), 0.6, tile=tile)
    assert sorted((r["score"], r["area_pixels"], r["members"]) for r in out.collect()) == brute_merge(items, 0.6)
    assert out.filter(merging.rects_area("rects") != F.col("area_pixels")).count() == 0


def test_merging_of_one_component_over_many_tiles(spark):
    """A band of overlapping boxes, one component, over a hundred tiles and several partitions."""
    rng, items, rows = np.random.default_rng(9), [], []
    for k in range(900):
        x, y, w, h = 3 * k + int(rng.integers(0, 5)), int(rng.integers(0, 6)), int(rng.integers(6, 14)), int(rng.integers(6, 14))
        score = float(rng.random())
        rows.append((1, "road", 0, k, score, x, y, x + w, y + h))
        items.append((0, k, score, frozenset((i, j) for i in range(x, x + w) for j in range(y, y + h))))
    df = spark.createDataFrame(rows, "scene_id long, concept string, window_id long, instance_id long, score double, x0 long, y0 long, x1 long, y1 long")
    out = merging.merge_across_windows(df.withColumn("rects", merging.box_rects()), 0.6, tile=32)
    assert sorted((r["score"], r["area_pixels"], r["members"]) for r in out.collect()) == brute_merge(items, 0.6)


def test_running_totals_over_one_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 7).alias("g"), (F.col("id") * 7919 % 5003).alias("o"), "id")
    out = ordering.running_totals(df, ["g"], [F.col("o").desc(), F.col("id")], {"n": F.lit(1).cast("long"), "s": F.col("id")})
    w = Window.partitionBy("g").orderBy(F.col("o").desc(), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    expected = df.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("s", F.sum("id").over(w))
    assert out.exceptAll(expected).count() == 0 and expected.exceptAll(out).count() == 0


@pytest.mark.parametrize("metric", ["hamming", "l2"])
def test_descriptor_blocks(spark, metric):
    rng = np.random.default_rng(5)
    make = lambda n, start: [(1 if i % 4 else 2, start + i, [int(v) for v in rng.integers(-2**62, 2**62, 4)], [float(v) for v in rng.normal(size=6)])
                             for i in range(n)]
    a, b = make(90, 0), make(110, 1000)
    schema = "pair_id int, id long, code array<long>, vector array<double>"
    out = descriptors.match_descriptors(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 0.9, metric, block=16)
    distance = (lambda p, q: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(p[2], q[2]))) if metric == "hamming" else (
        lambda p, q: float(np.linalg.norm(np.subtract(p[3], q[3]))))
    expected = []
    for p in a:
        near = sorted((distance(p, q), q[1]) for q in b if q[0] == p[0])[:2]
        if near[0][0] < 0.9 * near[1][0]:
            expected.append((p[1], near[0][1]))
    assert sorted((r["id_a"], r["id_b"]) for r in out.collect()) == sorted(expected) and expected


def brute_responses(rows, ttl):
    last, out = {}, {}
    for key, t, i in sorted(rows):
        if key not in last or t - last[key] >= ttl:
            last[key] = t
        out[i] = t - last[key]
    return out


def test_fresh_responses_with_a_busy_key(spark):
    rng = np.random.default_rng(11)
    rows = [("hot" if rng.random() < .6 else f"k{rng.integers(0, 20)}", int(rng.integers(0, 10**6)), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "request_text string, t long, request_id long").withColumn("requested_at", F.timestamp_seconds("t"))
    out = lookups.fresh_responses(df, 3600)
    assert {r["request_id"]: r["age_us"] // 10**6 for r in out.collect()} == brute_responses(rows, 3600)


@pytest.mark.parametrize("span", [40_000, 3_000_000])
def test_fresh_responses_of_a_single_key(spark, span):
    """All rows of one key, in any order, without or with pauses, over all partitions; ties in time as well."""
    rng = np.random.default_rng(12)
    rows = [("only", int(rng.integers(0, span)), i) for i in range(4000)] + [("zz", 5, 9000), (None, 7, 9001), (None, 9, 9002)]
    df = spark.createDataFrame(rows, "request_text string, t long, request_id long").withColumn("requested_at", F.timestamp_seconds("t"))
    out = lookups.fresh_responses(df.repartition(5), 600)
    assert {r["request_id"]: r["age_us"] // 10**6 for r in out.collect()} == brute_responses([(k or "", t, i) for k, t, i in rows], 600)


def test_evidence_pages_of_one_detection(spark):
    rng = np.random.default_rng(14)
    rows = [(1, 7, "way", k, "n", None, "overlap", round(float(rng.integers(0, 50)) / 50, 4)) for k in range(3000)] + [(1, 8, "node", 1, None, "a", "inside", None)]
    found = spark.createDataFrame(rows, "scene_id long, object_id long, osm_type string, osm_id long, name string, address string, spatial_relation string, intersection_over_union double")
    pages = sorted(evidence.evidence_pages(found, page=64).collect(), key=lambda r: (r["object_id"], r["page"]))
    listed = [(e["osm_id"], e["intersection_over_union"]) for r in pages if r["object_id"] == 7 for e in r["entries"]]
    assert listed == sorted(((r[3], r[7]) for r in rows if r[1] == 7), key=lambda e: (-e[1], e[0]))
    assert max(len(r["entries"]) for r in pages) == 64 and [r["first"] for r in pages if r["object_id"] == 7] == [64 * k + 1 for k in range(47)]


def test_evidence_does_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(13)
    detections = spark.createDataFrame(boxes(rng, 300), BOXES).withColumnRenamed("key", "object_id")
    records = spark.createDataFrame(boxes(rng, 300), BOXES).withColumnRenamed("key", "osm_id").select(
        "*", F.lit("way").alias("osm_type"), F.lit("Polygon").alias("kind"), F.lit("n").alias("name"), F.lit(None).cast("string").alias("address"))
    runs = [evidence.match_evidence(detections.repartition(p), records, cell=c, levels=v, salt=s) for p, c, v, s in ((1, 64, 1, 1), (5, 10, 2, 4), (3, 500, None, 1))]
    first = sorted(map(tuple, runs[0].collect()))
    assert first and all(sorted(map(tuple, r.collect())) == first for r in runs[1:])


def test_mask_algebra_against_sets(spark):
    rng = np.random.default_rng(17)
    make = lambda: [(1, int(r), int(c), int(c + n)) for r, c, n in zip(rng.integers(0, 12, 60), rng.integers(0, 40, 60), rng.integers(1, 9, 60))]
    a, b, v = make(), make(), make()
    frame = lambda rows: spark.createDataFrame(rows, "scene_id long, prow long, c0 long, c1 long")
    cells = lambda rows: {(r, c) for _, r, c0, c1 in rows for c in range(c0, c1)}
    back = lambda df: {(r["prow"], c) for r in df.collect() for c in range(r["c0"], r["c1"])}
    assert back(masks.union_masks(frame(a + b))) == cells(a) | cells(b)
    assert back(masks.difference_masks(frame(a), frame(b), frame(v))) == (cells(a) - cells(b)) & cells(v)
    grown = {(r + i, c + j) for r, c in cells(a) for i in (-2, -1, 0, 1, 2) for j in (-2, -1, 0, 1, 2)}
    assert back(masks.dilate(frame(a), 2, 45, 11)) == {(r, c) for r, c in grown if 0 <= r < 11 and 0 <= c < 45}
    assert back(masks.dilate(masks.union_masks(frame(a)), 0, 99, 99)) == cells(a)


def test_wide_rows_are_labelled_across_blocks(spark):
    rows = [(1, 0, 0, 700), (1, 1, 699, 1400), (1, 2, 1400, 1500), (1, 3, 300, 301)]
    runs = spark.createDataFrame(rows, "scene_id long, prow long, c0 long, c1 long")
    count = lambda k: masks.label_regions(runs, connectivity=k).select("region").distinct().count()
    assert count(8) == 2 and count(4) == 3


def test_late_edits_lose(spark, tmp_path):
    schema = "object_id long, edit_id long, edited_at long, reviewed_label string, rejected boolean"
    for n, rows in enumerate([[(1, 1, 10, "new", False), (2, 2, 5, "x", False)], [(1, 3, 4, "late", True), (2, 4, 6, "y", True)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.stream_label_edits(source, str(tmp_path / "log"), str(tmp_path / "progress")).awaitTermination()
    assert {r["object_id"]: r["reviewed_label"] for r in streams.current_edits(spark, str(tmp_path / "log")).collect()} == {1: "new", 2: "y"}
    streams.compact_edits(spark, str(tmp_path / "log"), str(tmp_path / "compact"))
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 2


@pytest.mark.parametrize("hot", [0, 3, 40, 10_000])
def test_top_places_with_frequent_words(spark, hot):
    """Every split of words into frequent and other ones gives the same places."""
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(12)]
    text = lambda: " ".join({words[int(v)] for v in np.minimum(rng.geometric(.25, rng.integers(1, 5)) - 1, 11)})
    places = [(k, text(), int(rng.integers(0, 30)), int(rng.integers(0, 30))) for k in range(300)]
    searches = [(k, text() if k else "", int(rng.integers(0, 30)), int(rng.integers(0, 30))) for k in range(40)]
    out = lookups.top_places(spark.createDataFrame(searches, "search_id long, text string, cx int, cy int"),
                             spark.createDataFrame(places, "place_id long, text string, x int, y int"), hot=hot)
    got = sorted((r["search_id"], r["place_rank"], r["place_id"], r["shared_words"]) for r in out.collect())
    expected = []
    for s, q, cx, cy in searches:
        ranked = sorted((-len(set(q.split()) & set(t.split())), (x - cx) ** 2 + (y - cy) ** 2, p) for p, t, x, y in places)
        expected += [(s, n + 1, p, -c) for n, (c, _, p) in enumerate(r for r in ranked[:6] if r[0])]
    assert got == sorted(expected)


def test_instances_without_area_stay(spark):
    rects = "array<struct<x0:bigint,y0:bigint,x1:bigint,y1:bigint>>"
    rows = [(1, "a", 0, k, .9, [(5, 5, 5, 9)]) for k in range(2)] + [(1, "a", 0, k, .8, [(0, 0, 9, 9)]) for k in (2, 3)]
    df = spark.createDataFrame(rows, f"scene_id long, concept string, window_id long, instance_id long, score double, rects {rects}")
    got = sorted((r["area_pixels"], r["members"]) for r in merging.merge_across_windows(df, 0.0).collect())
    assert got == [(0, 1), (0, 1), (81, 2)]


def test_codes_hold_every_element(spark):
    rows = [(1, [1.0] * 128), (2, [1.0] * 64 + [-1.0] * 64), (3, [1.0] * 70)]
    codes = {r["id"]: r["c"] for r in spark.createDataFrame(rows, "id long, v array<double>").select("id", descriptors.sign_code("v").alias("c")).collect()}
    assert codes[1] == [-1, -1] and codes[2] == [-1, 0] and codes[3] == [-1, 63]


def test_pair_of_very_many_landmarks(spark):
    rng = np.random.default_rng(2)
    b = rng.uniform(0, 900, (6001, 2))
    rows = [(1, "auto", *map(float, p), float(p[0] + 5), float(p[1] - 3)) for p in b] + [(2, "manual", *map(float, p), *map(float, p)) for p in b[:31]]
    fit = {r["pair_id"]: r for r in registration.align_pairs(spark.createDataFrame(rows, "pair_id long, mode string, bx double, by double, ax double, ay double")).collect()}
    assert fit[1]["reason"] is None and fit[1]["matched_landmarks"] == 6001 and np.allclose(np.array(fit[1]["matrix"])[[2, 5]], [5, -3], atol=1e-6)
    assert fit[2]["reason"] is None and fit[2]["landmarks"] == 31


def test_unreadable_images_are_kept(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "same.png").write_bytes(b"no image")
    images, pixels = readers.read_images(spark, str(tmp_path / "*"))
    rows = images.collect()
    assert len({r["path"] for r in rows}) == 2 and {(r["file"], r["reason"]) for r in rows} == {("same.png", "not a readable image")} and pixels.count() == 0


def test_long_texts_have_plans(spark):
    df = spark.createDataFrame([("find hospitals " + "x " * 2000,), ("   ",), ("segment " + "q" * 500,)], "text string")
    rows = requests.with_plan(df).select("plan.*", requests.request_reason("text").alias("reason")).collect()
    assert (rows[0]["intent"], rows[0]["category"], rows[0]["reason"]) == ("features", "hospitals", "query too long")
    assert rows[1]["intent"] is None and rows[1]["reason"] == "empty query" and rows[2]["prompt"] == "q" * 500
    same = df.select(requests.parse_request("text").alias("plan")).select("plan.*").collect()
    assert [tuple(r)[:10] for r in same] == [tuple(r)[:10] for r in rows]


def test_geojson_of_one_line_over_many_tasks(spark, tmp_path):
    """One line, cut into many splits, with braces, quotes and escapes in its strings and members around the features."""
    import json

    odd = ['plain', 'a}"{[]', "\\", '\\"', "}{", '"features": [', "é}日", "tab\t}"]
    features = [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[k, 0], [k + 1, 0], [k + 1, 1], [k, 0]]]} if k % 3 else {"type": "Point", "coordinates": [k, 2]},
                 "properties": {"n": k, "t": odd[k % len(odd)], "deep": {"x": {"y": [k, "}"]}}, "none": None}} for k in range(1500)]
    named = {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "crs": named, "attribution": "x{", "features": features}), encoding="utf-8")
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features[:40], "crs": named, "attribution": "y"}, ensure_ascii=False, indent=1) + "\n", encoding="utf-8")
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features[:3], "crs": {"type": "name", "properties": {"name": "EPSG:3857"}}}))
    (tmp_path / "d.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    (tmp_path / "e.geojson").write_text(json.dumps({"values": [{"a": 1}] * 50}))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found, rejected = readers.read_geojson(spark, str(tmp_path))
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    got = sorted((r["file"][-9], r["attribution"], int(r["properties"]["n"]), r["properties"]["t"], json.loads(r["properties"]["deep"])["x"]["y"][0], r["geom"]["kind"], len(r["geom"]["rings"][0][0])) for r in rows)
    want = sorted((f, a, k, odd[k % len(odd)], k, "Polygon" if k % 3 else "Point", 4 if k % 3 else 1) for f, a, n in (("a", "x{", 1500), ("b", "y", 40)) for k in range(n))
    assert got == want
    assert sorted((r["file"][-9], r["reason"]) for r in rejected.collect()) == [("c", "not WGS84"), ("e", "not a feature collection")]


def test_geojson_by_line_and_whole(spark, tmp_path):
    """A collection in one line, over many lines, and as the writer lays it out give the same features."""
    import json

    features = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [k, 1.5]}, "properties": {"n": k, "t": ',{"type":"Feature",'}} for k in range(5)]
    collection = {"type": "FeatureCollection", "attribution": "x", "features": features}
    (tmp_path / "one.geojson").write_text(json.dumps(collection))
    (tmp_path / "many.geojson").write_text(json.dumps(collection, indent=2))
    compact = [json.dumps(f, separators=(",", ":")) for f in features]
    (tmp_path / "lines.geojson").write_text('{"type": "FeatureCollection", "attribution": "x", "features": [\n' + "\n,".join(compact) + "\n]}\n")
    (tmp_path / "empty.geojson").write_text('{"type": "FeatureCollection", "features": [\n]}\n')
    found, rejected = readers.read_geojson(spark, str(tmp_path))
    rows = sorted((r["file"].rsplit("/", 1)[1], r["attribution"], r["geom"]["rings"][0][0][0]["x"], r["properties"]["n"]) for r in found.collect())
    assert rows == sorted((f"{name}.geojson", "x", float(k), str(k)) for name in ("one", "many", "lines") for k in range(5))
    assert rejected.count() == 0
