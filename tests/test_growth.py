"""What grows with the input is neither broadcast nor left to one task."""

import time

import __spark_entry__ as entry
from pyspark.sql import functions as F

from orthomark.functions import geometry
from orthomark.operators import masks

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def grid(spark, scenes: int, side: int):
    """Pixels made from a few rows, whose size is estimated before they are made."""
    rows = spark.range(scenes).withColumnRenamed("id", "scene_id")
    for axis in ("prow", "pcol"):
        rows = rows.withColumn(axis, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(side - 1).cast("long"))))
    return rows.withColumn("hit", (F.col("pcol") % 2) == 0).withColumn("valid", F.col("prow") > 0)


def test_dates_meet_without_broadcast(spark):
    pixels = grid(spark, 2, 4)
    both = masks.join_dates(pixels, pixels.where("pcol < 3"))
    assert both.count() == 32 and both.where("valid").count() == 18
    assert "BroadcastHashJoin" not in plan_of(both.where("before_hit AND valid"))


def test_foreground_mask_without_broadcast(spark):
    pixels = grid(spark, 2, 4)
    found = masks.foreground_mask(pixels, masks.runs_of(pixels.where("hit")))
    assert sorted((r["value"], r["count"]) for r in found.groupBy("value").count().collect()) == [(0, 12), (1, 12), (255, 8)]
    assert "BroadcastHashJoin" not in plan_of(found)


def test_blend_without_broadcast(spark):
    plan = plan_of(entry.queries()["r19_blend"](spark, SF))
    by_pixel = [line for line in plan.splitlines() if "Join [scene_id" in line and "prow" in line.split("]")[0]]
    assert len(by_pixel) == 2 and all("SortMergeJoin" in line for line in by_pixel)


def test_grids_are_made_in_many_tasks(spark):
    from orthomark.plans import fixture_views

    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, pixels in (("mask_pixels", 4096), ("band_pixels", 3072)):
        made = fixture_views.view(spark, SF, name)
        assert made.rdd.getNumPartitions() == wanted and made.count() == pixels * spark.read.parquet(f"{SF}/supplier.parquet").count()


def test_source_tiles_of_a_warp_are_made_once(spark):
    from orthomark.operators import tiles

    source = tiles.tiles_of(grid(spark, 2, 4).withColumn("grey", F.col("pcol").cast("double")), ["grey"], valid="valid")
    onto = spark.range(2).select(F.col("id").alias("scene_id"), F.lit(4).alias("width"), F.lit(4).alias("height"),
                                 F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)]).alias("inverse"))
    warped = tiles.warp_tiles(source, onto, 1)
    assert warped.count() == 2 and plan_of(warped).count("MapInPandas") == 1


def test_pairs_are_fitted_in_many_tasks(spark):
    from orthomark.operators import registration

    at = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((4, 4), (60, 4), (60, 60), (4, 60), (30, 20))])).alias("p")
    marks = spark.range(3).select(F.col("id").alias("pair_id"), F.lit("manual").alias("mode"), at).select(
        "pair_id", "mode", F.col("p.x").alias("bx"), F.col("p.y").alias("by"), (F.col("p.x") + F.col("pair_id")).alias("ax"), F.col("p.y").alias("ay"))
    fitted = registration.align_pairs(marks)
    assert sorted((r["pair_id"], round(r["matrix"][2], 6), r["matched_landmarks"], r["reason"]) for r in fitted.collect()) == [(k, float(k), 5, None) for k in range(3)]
    assert "FlatMapGroups" not in plan_of(fitted)


def test_geometry_is_rasterised_in_many_tasks(spark):
    from orthomark.functions import geometry

    shapes = spark.range(3).coalesce(1).select(F.col("id").alias("osm_id"), geometry.box_geom("id", "id", F.col("id") + 2, F.col("id") + 2).alias("geom"))
    runs = masks.rasterise_geometry(shapes, ["osm_id"], 10, 10)
    assert runs.count() == 6 and runs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_requests_are_parsed_once(spark):
    from orthomark.plans import jobs

    text = F.concat(F.lit("where are schools in this area?"), F.repeat(F.lit(" "), F.col("id").cast("int")))
    asked = spark.range(1, 2).select(F.col("id").alias("query_id"), F.lit(0).cast("long").alias("scene_id"), text.alias("text"),
                                     *[F.lit(v).cast("long").alias(n) for n, v in (("x0", 0), ("y0", 0), ("x1", 9), ("y1", 9))])
    records = spark.sql("SELECT 0L AS scene_id, 'way' AS osm_type, 7L AS osm_id, 'A' AS name, 1L AS x0, 1L AS y0, 2L AS x1, 2L AS y1, map('amenity', 'school') AS tags")
    found = jobs.answer_requests(asked, records)
    assert [r["osm_id"] for r in found.collect()] == [7]
    assert "regexp" not in plan_of(found)


def test_boxes_move_before_they_become_runs(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 4, 9), (1, 2, 3, 6, 5), (1, 6, 4, 8, 5), (2, 5, 5, 5, 9), (2, -3, 7, 2, 30)], "scene_id long, x0 long, y0 long, x1 long, y1 long")
    runs = masks.rasterise_boxes(boxes, ["scene_id"], 100, 20, band=4)
    merged = masks.union_masks(runs, ["scene_id", "band"])
    plan = plan_of(merged)
    assert plan.count("Exchange ") == 1 and "Aggregate" not in plan
    found = [tuple(r) for r in merged.select("scene_id", "prow", "c0", "c1").collect()]
    wide = {3: [(0, 6)], 4: [(0, 8)]}
    assert sorted(found) == [(1, r, *c) for r in range(9) for c in wide.get(r, [(0, 4)])] + [(2, r, 0, 2) for r in range(7, 20)]
    assert sorted(map(tuple, masks.union_masks(masks.rasterise_boxes(boxes, ["scene_id"], 100, 20)).collect())) == sorted(found)


def test_stored_tables_take_less_than_checkpoints(spark):
    import os

    from orthomark import session
    from orthomark.operators import rings, unions

    def size(folder):
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)

    session.ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    rows = spark.range(200_000).select((F.col("id") % 50).alias("scene_id"), F.lit("water").alias("concept"), *[(F.col("id") * k % 600).cast("double").alias(n) for k, n in ((1, "ax"), (7, "ay"))])
    start = size(folder)
    kept = session.stored(rows)
    written = size(folder) - start
    checkpoint = session.cut_lineage(rows)
    assert kept.dtypes == rows.dtypes and kept.exceptAll(rows).isEmpty() and kept.count() == checkpoint.count()
    assert 0 < 4 * written < size(folder) - start - written
    assert unions.stored is rings.stored is session.stored


def test_a_task_makes_a_bounded_number_of_grids(spark, tmp_path, monkeypatch):
    from orthomark.plans import fixture_views

    spark.range(1, 101).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(fixture_views, "GRIDS_A_TASK", 4)
    made = fixture_views.view(spark, str(tmp_path), "band_pixels")
    assert made.rdd.getNumPartitions() == 25 and made.count() == 100 * 3072


def test_counts_of_many_tiles_are_handed_on_in_parts(spark, monkeypatch):
    from orthomark.operators import tiles

    pixels = grid(spark, 6, 8).withColumn("a", (F.col("prow") * 8 + F.col("pcol") * (F.col("scene_id") + 1)).cast("double"))
    packed = tiles.tiles_of(pixels, ["a"]).coalesce(1)
    at = lambda: sorted(map(tuple, tiles.tile_percentiles(packed, ["a"]).collect()))
    whole = at()
    monkeypatch.setattr(tiles, "PIECES", 50)
    assert len(whole) == 6 and at() == whole


def test_pixels_of_a_task_are_bounded(spark, monkeypatch):
    from orthomark.operators import raster

    pixels = grid(spark, 5, 8).withColumn("band", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("value", F.when((F.col("pcol") > 0) | (F.col("band") > 1), 1.0))
    plain = sorted(map(tuple, raster.valid_pixels(pixels, 2).collect()))
    monkeypatch.setattr(raster, "PIXELS_A_TASK", 32)
    spread = raster.valid_pixels(pixels, 2)
    assert "hashpartitioning(scene_id" in plan_of(spread) and ", 20), REPARTITION_BY_NUM" in plan_of(spread)
    assert sorted(map(tuple, spread.collect())) == plain and sum(v for *_, v in plain) == 5 * 8 * 7


def test_keys_share_states_of_a_stream(spark):
    """Every call for a state takes milliseconds; a bucket of keys is one call, whose rows may come in several batches."""
    import pandas as pd
    from types import SimpleNamespace

    from orthomark.streaming import jobs

    class States:
        """The part of a handle and of a list state that is used."""
        def __init__(self):
            self.rows, self.timers = [], []

        def getListState(self, _name, _schema):
            return SimpleNamespace(get=lambda: iter(self.rows), put=lambda rows: setattr(self, "rows", rows), clear=lambda: setattr(self, "rows", []))

        def listTimers(self):
            return list(self.timers)

        def deleteTimer(self, at):
            self.timers.remove(at)

        def registerTimer(self, at):
            self.timers.append(at)

    states, processor = States(), jobs.FreshResponses(10_000_000)
    processor.init(states)

    def ages(batches, watermark_ms):
        frames = (pd.DataFrame(b, columns=["request_id", "request_key", "t"]) for b in batches)
        out = pd.concat(processor.handleInputRows((3,), frames, SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark_ms)))
        return {r.request_id: (r.request_key, r.age_us) for r in out.itertuples()}

    first = ages([[(1, "a", 5_000_000), (2, "b", 1_000_000), (3, None, 2_000_000)], [(4, "a", 1_000_000), (5, "b", 12_000_000), (6, None, 2_000_000)]], 0)
    assert first == {4: ("a", 0), 1: ("a", 4_000_000), 2: ("b", 0), 5: ("b", 0), 3: (None, 0), 6: (None, 0)}
    assert sorted(states.rows, key=str) == [("a", 1_000_000), ("b", 1_000_000), ("b", 12_000_000), (None, 2_000_000)] and states.timers == [22_001]
    assert ages([[(7, "b", 21_999_999), (8, "a", 22_000_000)]], 12_000) == {7: ("b", 9_999_999), 8: ("a", 0)}
    assert sorted(states.rows) == [("a", 22_000_000), ("b", 12_000_000)] and states.timers == [32_001]


def test_files_of_a_stream_grow_with_its_table(spark, monkeypatch):
    from orthomark.plans import queries_io, registry

    made = []
    folder = queries_io.scratch_folder
    monkeypatch.setattr(queries_io, "scratch_folder", lambda session, name: made.append(folder(session, name)) or made[-1])
    monkeypatch.setattr(queries_io, "ROWS_A_FILE", 100)
    inputs = registry.Inputs(spark, SF)
    events = inputs.events
    queries_io._stream(inputs, "events")
    written = spark.read.parquet(made[-1])
    wanted = -(-events.count() // 100)
    assert wanted > 4 and len(written.inputFiles()) == 3 * wanted and written.count() == events.count()
    made.clear()
    found = entry.queries()["t2_stream_match_evidence"](spark, SF)
    written = spark.read.parquet(made[0])
    assert len(written.inputFiles()) > 3 and max(r["count"] for r in written.groupBy(F.input_file_name()).count().collect()) <= 110
    assert found.count() == written.count()


def test_named_files_share_folders(spark, tmp_path):
    from orthomark.sources import writers

    names = [f"scene_id={k}.bmp" for k in range(600)]
    rows = spark.createDataFrame([(n, bytes([k % 251]) * (k % 7)) for k, n in enumerate(names)], "name string, content binary")
    assert writers.write_files(rows.repartition(5), f"file:{tmp_path}/images") == 600
    assert len([p for p in (tmp_path / "images").iterdir()]) <= writers.FILE_FOLDERS
    assert {p.name: p.read_bytes() for p in (tmp_path / "images").rglob("*.bmp")} == {n: bytes([k % 251]) * (k % 7) for k, n in enumerate(names)}
    assert writers.write_files(rows, str(tmp_path / "images")) == 600 and len(list((tmp_path / "images").rglob("*.bmp"))) == 600


def shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return sum("/shuffle_" in f and f.endswith(".data") for f in files.split("\n"))


def test_written_tables_leave_no_shuffle_files(spark):
    """the files of all steps of a job lay on disk until the driver collected garbage."""
    from orthomark.session import cut_lineage, stored

    moved = spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count()
    before = shuffle_files(spark)
    for keep in (cut_lineage, stored):
        assert keep(moved).count() == 5000
        deadline = time.time() + 20  # they are removed in the background
        while shuffle_files(spark) > before + 1 and time.time() < deadline:  # one of the count above
            time.sleep(0.2)
        assert shuffle_files(spark) <= before + 1
        before += 1


def test_pieces_of_several_owners(spark):
    """boxes that share sides with one, two and three others, and a box under one of these sides."""
    from orthomark.operators import unions

    boxes = [(0, 0, 4, 4), (2, 0, 6, 4), (3, 0, 9, 4), (0, 6, 2, 8), (0, 6, 2, 8), (0, 6, 2, 9), (1, 6, 2, 7), (5, 3, 6, 9), (None, 0, 1, 1)]
    rows = [(1 if b[0] is not None else None, *(float(v or 0) for v in b)) for b in boxes]
    shapes = spark.createDataFrame(rows, "scene_id long, x0 double, y0 double, x1 double, y1 double").select("scene_id", geometry.box_geom("x0", "y0", "x1", "y1").alias("geom"))
    parts = unions.union_outlines(shapes, ["scene_id"], cell=2)
    assert sorted(r[0] for r in parts.select(geometry.geom_area("geom")).collect()) == [6.0, 41.0]
    assert {r["scene_id"] for r in parts.collect()} == {1}


def test_mask_runs_share_folders(spark, tmp_path):
    """there was a folder and a file for every run."""
    from orthomark.sources import writers

    names = [f"{k:05d}" for k in range(700)] + [None]
    rows = [(n, o, r, 3 * r, 3 * r + 2) for n in names for o in (1, 2) for r in range(2)]
    runs = spark.createDataFrame(rows + rows[:1], "run_id string, object_id long, prow long, c0 long, c1 long")
    writers.write_masks(runs, runs.select("run_id", "object_id").distinct().withColumn("score", F.lit(0.9)), str(tmp_path / "masks"))
    for name, count in (("mask_runs", len(rows) + 1), ("scores", 2 * len(names))):
        assert len([p for p in (tmp_path / "masks" / name).iterdir() if p.is_dir()]) <= writers.FILE_FOLDERS + 1
        back = spark.read.parquet(str(tmp_path / "masks" / name))
        assert back.count() == count and back.groupBy("run_id").agg(F.countDistinct("block").alias("n")).where("n > 1").isEmpty()
    back = spark.read.parquet(str(tmp_path / "masks/mask_runs")).drop("block")
    assert sorted(map(tuple, back.select(runs.columns).collect()), key=repr) == sorted(rows + rows[:1], key=repr)


def test_limits_of_many_scenes_are_not_broadcast(spark, monkeypatch):
    """the limits of all scenes were broadcast, since their pixels come from a small file."""
    from orthomark.operators import tiles

    pixels = grid(spark, 5, 20).select("scene_id", F.lit(1).alias("band"), "prow", "pcol", F.sqrt((F.col("prow") * 20 + F.col("pcol") * F.col("scene_id") + 7).cast("double")).alias("value"))
    rows = lambda df: sorted(map(tuple, tiles.pixels_of_tiles(df, [1]).collect()))
    expected = rows(tiles.stretch_tiles(tiles.tiles_of(pixels, [1]), [1]))
    plans, checkpoint = [], tiles.cut_lineage
    monkeypatch.setattr(tiles, "cut_lineage", lambda df: plans.append(plan_of(df)) or checkpoint(df))
    monkeypatch.setattr(tiles, "MOST_LIMITS", 4)
    monkeypatch.setattr(tiles, "MOST_BROADCAST", 0)
    many = tiles.stretch_tiles(tiles.tiles_of(pixels, [1]), [1])
    assert rows(many) == expected and len({r[-1] for r in expected}) > 50
    assert len(plans) > 3 and all("Broadcast" not in p for p in [*plans, plan_of(many)])


def test_dates_as_runs_are_dates_as_pixels(spark):
    """pixel rows of both dates were moved for their join and for three tables of runs. Pixels may come twice, lack a place or a date."""
    import random

    rng = random.Random(3)
    pick = lambda n: [rng.choice([0, 0, 1, None]) if rng.random() < 0.05 else rng.randrange(n) for _ in range(1)][0]
    rows = lambda: [(pick(3), pick(5), pick(12), rng.choice([True, True, False, None]), rng.choice([True, True, True, False, None])) for _ in range(300)]
    kind = "scene_id long, prow long, pcol long, hit boolean, valid boolean"
    before, after = (spark.createDataFrame(rows(), kind) for _ in range(2))
    pixels, joined = masks.join_dates(before, after).persist(), masks.join_date_runs(before, after).persist()
    wanted = masks.overlap_stats(pixels, warped=True).where("scene_id IS NOT NULL")
    assert sorted(map(tuple, masks.run_overlap_stats(joined, warped=True).collect())) == sorted(map(tuple, wanted.collect()))
    covered = lambda runs: sorted(map(tuple, masks.pixels_of(masks.union_masks(runs)).collect()))
    for condition, run in (("before_hit AND valid", "n_before"), ("after_hit AND valid", "n_after"), ("valid", "n_valid")):
        found = masks.pixels_of(joined.where(f"{run} > 0").select("scene_id", "prow", "c0", "c1"))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, pixels.where(condition).select("scene_id", "prow", "pcol").distinct().collect()))
        assert covered(masks.runs_of_pieces(joined, run)) == covered(masks.runs_of(pixels.where(condition)))
    # Pixels in order are few runs before they are moved.
    marked = grid(spark, 4, 64).select("scene_id", "prow", "pcol", F.lit(3).alias("kind"))
    assert masks.partial_runs(marked).count() < 64 * 4 * 2


def test_pairs_are_fitted_side_by_side(spark, monkeypatch):
    """every pair was sorted, fitted and made a row by itself."""
    import numpy as np

    from orthomark.operators import registration

    rng, rows = np.random.default_rng(4), []
    for k in range(40):
        n = 20 if k % 2 else 14 + k % 5
        b = rng.uniform(0, 500, (n, 2))
        a = b + [k, -k]
        a[:n // 4] += rng.uniform(50, 90, (n // 4, 2))
        if k == 7:
            a[:] = 3.0
        rows += [(k, "auto" if k % 3 else "manual", *map(float, (*p, *q))) for p, q in zip(b, a)]
    found = {r["pair_id"]: r for r in registration.align_pairs(spark.createDataFrame(rows, "pair_id long, mode string, bx double, by double, ax double, ay double")).collect()}
    assert len(found) == 40
    for k, row in found.items():
        n = row["landmarks"]
        if k == 7:
            assert row["reason"] in ("alignment is degenerate", "alignment is unreliable")
        else:
            assert row["reason"] is None and row["matched_landmarks"] == n - n // 4 and np.allclose(np.array(row["matrix"])[[2, 5]], [k, -k], atol=1e-6)
    # Many pairs at once are fitted as each is alone, however many samples are worked out at a time.
    points = np.array([sorted(r[2:] for r in rows if r[0] == k) for k in range(1, 40, 2)])
    alone = [registration.fits_robust(p[None, :, :2], p[None, :, 2:], 3.0) for p in points]
    for values in (registration.FIT_VALUES, 3 * 32 * 20, 1):
        monkeypatch.setattr(registration, "FIT_VALUES", values)
        matrices, good, inside = registration.fits_robust(points[..., :2], points[..., 2:], 3.0)
        for k, (matrix, one, mine) in enumerate(alone):
            assert good[k] == one[0] and (inside[k] == mine[0]).all() and (not good[k] or np.allclose(matrices[k], matrix[0]))


def test_anchored_boxes_move_once(spark):
    """F8: a detection was moved to all cells it touches, once for areas and once for points."""
    import random

    from orthomark.operators import evidence
    from orthomark.operators.grid_join import _cells, overlapping_pairs

    rng = random.Random(5)
    kind = "scene_id long, key long, x0 double, y0 double, x1 double, y1 double"

    def boxes(n):
        out = []
        for k in range(n):
            x, y, w, h = rng.choice([rng.uniform(-90, 90), float(rng.randrange(-6, 6) * 16)]), rng.uniform(-90, 90), rng.choice([0.0, 3.0, 16.0, rng.uniform(0, 16), rng.uniform(0, 400)]), rng.uniform(0, 40)
            out.append((rng.choice([1, 1, 2, None]), k, x, y, x + w, y + h))
        return out

    a, b = boxes(150), boxes(150)
    expected = sorted((p[1], q[1]) for p in a for q in b if p[0] is not None and p[0] == q[0] and p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5])
    left, right = (spark.createDataFrame(rows, kind) for rows in (a, b))
    for levels, salt in ((1, 1), (2, 1), (None, 3)):
        pairs = overlapping_pairs(left, right, cell=16, levels=levels, salt=salt, anchored=True)
        assert sorted((r["key"], r["r_key"]) for r in pairs.collect()) == expected
    short = left.where("x1 - x0 <= 16 AND y1 - y0 <= 16")
    assert _cells(short, 16, 1, "left").count() == short.count()

    box = lambda x, y, w: geometry.box_geom(F.lit(x), F.lit(y), F.lit(x + w), F.lit(y + w))
    detections = spark.range(1).select(F.lit(1).alias("scene_id"), F.col("id").alias("object_id"), box(13.0, 52.0, 0.0004).alias("geom"))
    place = lambda osm_id, geom: spark.range(1).select(F.lit(1).alias("scene_id"), F.lit("way").alias("osm_type"), F.lit(osm_id).alias("osm_id"), F.lit("n").alias("name"),
                                                       F.lit(None).cast("string").alias("address"), geom.alias("geom"))
    records = place(1, box(13.0001, 52.0, 0.0004)).unionByName(place(2, geometry.point_geom(F.lit(13.0002), F.lit(52.0002)))).unionByName(
        place(3, geometry.point_geom(F.lit(13.0009), F.lit(52.0002)))).unionByName(place(4, box(13.00039, 52.00039, 0.0004)))
    found = evidence.match_evidence_geometry(detections, records)
    assert sorted((r["osm_id"], r["intersection_over_union"]) for r in found.collect()) == [(1, 0.6), (2, None)]
    # Two sides meet in one join, so each is moved once.
    assert plan_of(found).split("Initial Plan")[0].count("SortMergeJoin") == 1


def test_nearest_places_by_a_window(spark):
    """every search for frequent words was compared with every place of a tile."""
    import numpy as np

    from orthomark.operators import lookups

    rng = np.random.default_rng(8)
    for n, spread in ((3, 9), (300, 4), (5000, 9), (5000, 900), (2000, 1)):
        x, y, ids = np.sort(rng.integers(0, spread, n).astype(float)), rng.integers(0, spread, n).astype(float), rng.permutation(n)
        if n == 300:
            y[::7] = np.nan
        for cx, cy in [(-5.0, 3.0), (spread / 2, spread / 2), (spread * 3.0, 0.0)]:
            for k in (1, 6):
                found, away = lookups.nearest(x, y, ids, cx, cy, k)
                distance = (x - cx) ** 2 + (y - cy) ** 2
                expected = np.lexsort((ids, distance))[:k]
                assert found.tolist() == expected.tolist() and away.tolist() == distance[expected].tolist()
    # Two million comparisons of a search with a place, in a window each.
    x, y, ids = np.sort(rng.uniform(0, 600, 200_000)), rng.uniform(0, 600, 200_000), np.arange(200_000)
    started = time.time()
    for c in rng.uniform(0, 600, (400, 2)):
        lookups.nearest(x, y, ids, *c, 6)
    windows, started = time.time() - started, time.time()
    for c in rng.uniform(0, 600, (40, 2)):
        np.partition((x - c[0]) ** 2 + (y - c[1]) ** 2, 5)
    assert windows / 400 < (time.time() - started) / 40


def test_parts_without_all_corners_have_no_area(spark):
    """edges that stay of such parts run into rings of others and were followed for ever, or lost those rings."""
    from orthomark.operators import unions

    rows = [(1, 0.0, 0.0, 40.0, 8.0), (1, 10.0, 2.0, None, 30.0), (1, 12.0, -3.0, 20.0, None), (1, 10.0, -5.0, None, 2.0), (2, 0.0, 0.0, None, 1.0)]
    shapes = spark.createDataFrame(rows, "scene_id long, x0 double, y0 double, x1 double, y1 double").select("scene_id", geometry.box_geom("x0", "y0", "x1", "y1").alias("geom"))
    parts = unions.union_outlines(shapes, ["scene_id"], cell=4)
    assert [tuple(r) for r in parts.select("scene_id", geometry.geom_area("geom")).collect()] == [(1, 320.0)]
