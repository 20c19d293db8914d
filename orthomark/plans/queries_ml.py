"""Registered queries: manifests, evaluation, registration and lookups."""

from pyspark.sql import functions as F

from orthomark.functions.numbers import round_exact
from orthomark.operators import lookups, ordering, registration, training
from orthomark.plans.registry import query


@query("a8_group_leakage", "manifest", """
SELECT grp, min(split) AS first_split, max(split) AS last_split, count(*) AS samples FROM manifest GROUP BY grp HAVING count(DISTINCT split) > 1""")
def _(t):
    return training.group_leakage(t.manifest)


@query("a9_duplicate_leakage", "manifest", """
SELECT sha256(file_bytes) AS digest, min(split) AS first_split, max(split) AS last_split, count(*) AS files FROM manifest GROUP BY sha256(file_bytes) HAVING count(DISTINCT split) > 1""")
def _(t):
    return training.duplicate_leakage(t.manifest, "file_bytes")


BROKEN = """
, m AS (SELECT CASE WHEN sample_id % 53 = 0 THEN 'tiles/raw.tif' ELSE path END AS path, CASE WHEN sample_id % 59 = 0 THEN '' WHEN sample_id % 10 = 9 AND sample_id % 4 = 1 THEN 'rare' ELSE label END AS label,
  CASE WHEN sample_id % 61 = 0 THEN 'holdout' ELSE split END AS split, grp FROM manifest)
"""


@query("a10_manifest_checks", "manifest", BROKEN + """
SELECT CASE WHEN split NOT IN ('train', 'val', 'test') THEN 'unknown split' WHEN label = '' THEN 'empty label' ELSE 'unsupported file type' END AS violation, path AS detail
  FROM m WHERE split NOT IN ('train', 'val', 'test') OR label = '' OR path LIKE '%.tif'
UNION ALL SELECT 'geographic leakage', grp FROM m GROUP BY grp HAVING count(DISTINCT split) > 1
UNION ALL SELECT DISTINCT 'class not in training', label FROM m WHERE split <> 'train' AND label NOT IN (SELECT label FROM m WHERE split = 'train')""")
def _(t):
    k = F.col("sample_id")
    broken = t.manifest.select(
        F.when(k % 53 == 0, "tiles/raw.tif").otherwise(F.col("path")).alias("path"),
        F.when(k % 59 == 0, "").when((k % 10 == 9) & (k % 4 == 1), "rare").otherwise(F.col("label")).alias("label"),
        F.when(k % 61 == 0, "holdout").otherwise(F.col("split")).alias("split"), "grp")
    return training.manifest_checks(broken)


@query("a11_split_counts", "manifest", "SELECT split, count(*) AS samples FROM manifest GROUP BY split")
def _(t):
    return training.split_counts(t.manifest)


@query("a11_class_index", "manifest", """
SELECT label, row_number() OVER (ORDER BY label) - 1 AS class_index FROM (SELECT DISTINCT label FROM manifest WHERE split = 'train')""")
def _(t):
    return training.class_index(t.manifest)


@query("a12_confusion_matrix", "predictions", """
, grid AS (SELECT split, target, predicted FROM (SELECT DISTINCT split FROM predictions), range(10) AS a(target), range(10) AS b(predicted))
SELECT split, target, predicted, count(p.sample_id) AS n FROM grid LEFT JOIN predictions p USING (split, target, predicted) GROUP BY split, target, predicted""")
def _(t):
    return training.confusion_matrix(t.predictions, 10)


REPORT = """
, c AS (SELECT split, k, count(*) FILTER (target = k AND predicted = k) AS tp, count(*) FILTER (target = k) AS support, count(*) FILTER (predicted = k) AS chosen
  FROM predictions, range(10) AS a(k) GROUP BY split, k),
pr AS (SELECT *, CASE WHEN chosen > 0 THEN tp / CAST(chosen AS DOUBLE) ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END AS r FROM c),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM pr),
report AS (SELECT split, CAST(k AS VARCHAR) AS label, p AS precision, r AS recall, f AS f1, support FROM f
  UNION ALL SELECT split, 'accuracy', sum(tp) / CAST(sum(support) AS DOUBLE), sum(tp) / CAST(sum(support) AS DOUBLE), sum(tp) / CAST(sum(support) AS DOUBLE), sum(support) FROM f GROUP BY split
  UNION ALL SELECT split, 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM f GROUP BY split
  UNION ALL SELECT split, 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM f GROUP BY split)
"""


def _rounded(report):
    return report.select("split", "label", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")], "support")


@query("a13_classification_report", "predictions", REPORT + """
SELECT split, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM report""")
def _(t):
    return _rounded(training.classification_report(training.confusion_matrix(t.predictions, 10)))


@query("m5_evaluate", "predictions", REPORT + """
SELECT split, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM report WHERE split IN ('val', 'test')""")
def _(t):
    return _rounded(training.evaluate(t.predictions, 10)[0])


@query("a14_sample_mean_metrics", "epoch_log", """
SELECT run_id, CAST(sum(n_samples) AS BIGINT) AS samples, round(sum(val_loss * n_samples) / sum(n_samples) + CAST(0.000000001 AS DOUBLE), 6) AS loss, round(sum(n_samples - epoch % 8) / CAST(sum(n_samples) AS DOUBLE), 6) AS accuracy
FROM epoch_log GROUP BY run_id""")
def _(t):
    batches = t.epoch_log.select("run_id", F.col("val_loss").alias("loss"), "n_samples", (F.col("n_samples") - F.col("epoch") % 8).alias("n_correct"))
    m = training.sample_mean_metrics(batches, ["run_id"])
    nudge = F.lit(1e-9)  # keeps exact decimal ties away from the engines' rounding rules
    return m.select("run_id", "samples", F.round(F.col("loss") + nudge, 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


@query("w2_best_epoch", "epoch_log", """
SELECT run_id, epoch, val_loss FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY val_loss, epoch) AS n FROM epoch_log) WHERE n = 1""")
def _(t):
    return ordering.best_epoch(t.epoch_log)


@query("w4_rank_classes", "", """
WITH s AS (SELECT vec_id, CAST(i - 1 AS BIGINT) AS i, embedding[i] AS score FROM embeddings, range(1, 65) AS a(i) WHERE i <= len(embedding))
SELECT vec_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY score DESC, i) AS ranking, CAST(arg_max(i, score) AS VARCHAR) AS predicted_class FROM s GROUP BY vec_id""")
def _(t):
    ranked = training.rank_classes(t.embeddings.select("vec_id", F.col("embedding").alias("scores")))
    return ranked.select("vec_id", F.array_join(F.transform("ranking", lambda r: r["label"]), ",").alias("ranking"), "predicted_class")


@query("w5_top_places", "map_points", """
, s AS (SELECT s_suppkey AS search_id, list_distinct(string_split_regex(lower(concat('Customer#', right(s_name, 9), ' ', n_name)), '[^a-z0-9_]+')) AS q,
   s_suppkey * 31 % 600 AS cx, s_suppkey * 17 % 600 AS cy FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT osm_id AS place_id, list_distinct(list_filter(string_split_regex(lower(concat_ws(' ', name, street, city)), '[^a-z0-9_]+'), lambda w: w <> '')) AS t, x, y FROM map_points),
r AS (SELECT search_id, place_id, len(list_intersect(q, t)) AS shared_words, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d FROM s JOIN p ON len(list_intersect(q, t)) > 0)
SELECT search_id, place_id, shared_words, place_rank FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY shared_words DESC, d, place_id) AS place_rank FROM r) WHERE place_rank <= 6""")
def _(t):
    nation = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    k = F.col("s_suppkey")
    searches = t.supplier.join(nation, "s_nationkey").select(
        k.alias("search_id"), F.concat(F.lit("Customer#"), F.right("s_name", F.lit(9)), F.lit(" "), F.col("n_name")).alias("text"),
        (k * 31 % 600).alias("cx"), (k * 17 % 600).alias("cy"))
    places = t.map_points.select(F.col("osm_id").alias("place_id"), F.concat_ws(" ", "name", "street", "city").alias("text"), "x", "y")
    return lookups.top_places(searches, places).select("search_id", "place_id", "shared_words", F.col("place_rank").cast("long").alias("place_rank"))


@query("w6_retain_within_budget", "fetch_log", """
, f AS (SELECT request_id, split_part(request_text, '|', 2) AS provider, requested_at, size_kb FROM fetch_log),
r AS (SELECT *, sum(size_kb) OVER (PARTITION BY provider ORDER BY requested_at DESC, request_id DESC ROWS UNBOUNDED PRECEDING) AS running_size FROM f)
SELECT request_id, provider, CAST(running_size AS BIGINT) AS running_size, running_size <= 524288 AS kept,
  running_size <= 524288 AND requested_at > TIMESTAMP '2024-01-30 00:00:00' AS served FROM r""")
def _(t):
    files = t.fetch_log.select("request_id", F.substring_index("request_text", "|", -1).alias("provider"), "requested_at", "size_kb")
    out = ordering.retain_within_budget(files, 524288, ["provider"], "requested_at", "size_kb", "request_id", "2024-01-31 00:00:00", 86400)
    return out.select("request_id", "provider", "running_size", "kept", "served")


@query("w7_fresh_responses", "fetch_log", """
, t AS (SELECT request_id, request_text, requested_at FROM fetch_log),
fetches AS (SELECT request_text, min(requested_at) AS at FROM t GROUP BY request_text
  UNION ALL SELECT f.request_text, (SELECT min(requested_at) FROM t WHERE t.request_text = f.request_text AND t.requested_at >= f.at + INTERVAL 86400 SECONDS)
  FROM fetches f WHERE EXISTS (SELECT 1 FROM t WHERE t.request_text = f.request_text AND t.requested_at >= f.at + INTERVAL 86400 SECONDS))
SELECT request_id, t.request_text AS request_key, t.requested_at = max(f.at) AS fetched, CAST(epoch_us(t.requested_at) - epoch_us(max(f.at)) AS BIGINT) AS age_us
FROM t JOIN fetches f ON t.request_text = f.request_text AND f.at <= t.requested_at GROUP BY request_id, t.request_text, t.requested_at""", recursive=True)
def _(t):
    return lookups.fresh_responses(t.fetch_log).select("request_id", "request_key", "fetched", "age_us")


def _landmarks(t):
    """Forty landmarks per customer-derived pair under a known shift, a tenth of them wrong."""
    k, i = F.col("c_custkey"), F.col("i")
    rows = t.customer.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))))
    bx, by = ((k * 37 + i * 97) % 500).cast("double"), ((k * 53 + i * 61) % 400).cast("double")
    wrong = i % 10 == 9
    return rows.select(k.alias("pair_id"), F.lit("auto").alias("mode"), bx.alias("bx"), by.alias("by"),
                       (bx + k % 20 + F.when(wrong, 57 + i).otherwise(0)).alias("ax"), (by + k % 11 - F.when(wrong, 31 + i).otherwise(0)).alias("ay"))


@query("r17_align_pairs", "", """
SELECT c_custkey AS pair_id, CAST(36 AS BIGINT) AS matched_landmarks, CAST(c_custkey % 20 AS DOUBLE) AS dx, CAST(c_custkey % 11 AS DOUBLE) AS dy,
  CAST(0 AS DOUBLE) AS registration_error_px, CAST(NULL AS VARCHAR) AS reason FROM customer""")
def _(t):
    a = registration.align_pairs(_landmarks(t))
    at = lambda i: F.round(F.get("matrix", F.lit(i)), 4) + F.lit(0.0)
    return a.select("pair_id", "matched_landmarks", at(2).alias("dx"), at(5).alias("dy"), (F.col("registration_error_px") + F.lit(0.0)).alias("registration_error_px"), "reason")


@query("r17_modes", "", """
WITH k AS (SELECT c_custkey AS pair_id, c_custkey % 5 AS m, CAST(c_custkey % 40 AS DOUBLE) AS s FROM customer)
SELECT pair_id, CASE m WHEN 0 THEN 'Identical image grids' WHEN 1 THEN 'Georeferenced common grid' WHEN 2 THEN 'Georeferenced common grid' END AS method,
  CASE m WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN s WHEN 2 THEN s / 2 END AS dx, CASE m WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(1 AS DOUBLE) WHEN 2 THEN CAST(0.5 AS DOUBLE) END AS scale,
  CASE m WHEN 3 THEN 'not georeferenced' WHEN 4 THEN 'different coordinate systems' END AS reason,
  CASE WHEN m = 2 THEN 'images differ in size' END AS declared_reason FROM k""")
def _(t):
    """Grids that are equal, shifted, shifted and half as fine, without georeference, and in another system."""
    from orthomark.functions import geo

    k, m, shift = F.col("c_custkey"), F.col("c_custkey") % 5, (F.col("c_custkey") % 40).cast("double")
    fine = F.when(m == 2, 4.0).otherwise(2.0)
    pairs = t.customer.select(
        k.alias("pair_id"), F.when(m != 3, geo.affine(2.0, 0.0, 100.0 + F.when(m == 0, 0.0).otherwise(2.0 * shift), 0.0, -2.0, 50.0)).alias("before_transform"),
        geo.affine(fine, 0.0, F.lit(100.0), 0.0, -fine, F.lit(50.0)).alias("after_transform"), F.lit("EPSG:3857").alias("before_crs"),
        F.when(m == 4, "EPSG:4326").otherwise("EPSG:3857").alias("after_crs"), *[F.lit(n).alias(c) for c, n in (("before_width", 200), ("before_height", 100))],
        F.when(m == 2, 100).otherwise(200).alias("after_width"), F.when(m == 2, 50).otherwise(100).alias("after_height"))
    placed = registration.align_georeferenced(pairs)
    declared = registration.align_same_grid(pairs).select("pair_id", F.col("reason").alias("declared_reason"))
    at = lambda i: F.round(F.get("matrix", F.lit(i)), 9) + F.lit(0.0)
    return placed.select("pair_id", "method", at(2).alias("dx"), at(0).alias("scale"), "reason").join(declared, "pair_id")


@query("a15_registration_quality", "", """
WITH l AS (SELECT c_custkey, i, CASE WHEN i % 10 = 9 THEN sqrt((57 + i - 1) * (57 + i - 1) + (31 + i) * (31 + i)) ELSE CAST(1 AS DOUBLE) END AS residual FROM customer, range(40) AS a(i))
SELECT c_custkey AS pair_id, round(median(residual) FILTER (residual <= 3), 6) AS registration_error_px, count(*) FILTER (residual <= 3) AS matched_landmarks,
  round(avg((residual <= 3)::INT::DOUBLE), 6) AS inlier_share FROM l GROUP BY c_custkey""")
def _(t):
    """Residuals against a transform that is one pixel off in x."""
    k = F.col("pair_id")
    matrix = F.array(F.lit(1.0), F.lit(0.0), (k % 20 + 1).cast("double"), F.lit(0.0), F.lit(1.0), (k % 11).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    q = registration.registration_quality(_landmarks(t).withColumn("matrix", matrix))
    return q.select("pair_id", F.round("registration_error_px", 6).alias("registration_error_px"), "matched_landmarks", F.round("inlier_share", 6).alias("inlier_share"))


@query("r18_alignment_guards", "", """
SELECT o_orderkey AS pair_id, CASE o_orderkey % 6 WHEN 0 THEN 'degenerate' WHEN 1 THEN 'excessive distortion' WHEN 2 THEN 'landmarks too close together'
  WHEN 3 THEN 'less than 15% usable overlap' WHEN 5 THEN 'excessive distortion' END AS reason FROM orders""")
def _(t):
    k = F.col("o_orderkey") % 6
    # 0 flat, 1 far too large, 5 folded over itself; the others keep the image as it is.
    scale = F.when(k == 0, 0.0).when(k == 1, 9.0).otherwise(1.0)
    fold = F.when(k == 5, F.lit(-0.012)).otherwise(0.0)
    matrix = F.array(scale, F.lit(0.0), F.lit(2.0), F.lit(0.0), scale, F.lit(1.0), fold, F.lit(0.0), F.lit(1.0))
    pairs = t.orders.select(F.col("o_orderkey").alias("pair_id"), matrix.alias("matrix"), *[F.lit(v).alias(n) for n, v in (
        ("before_width", 200), ("before_height", 100), ("after_width", 200), ("after_height", 100))],
        F.when(k == 2, 10.0).otherwise(9000.0).alias("hull_area"), F.when(k == 3, 0.1).otherwise(0.9).alias("overlap_fraction"))
    return registration.alignment_guards(pairs).select("pair_id", "reason")


@query("m3_tile_features", "band_pixels", """
, axis AS (SELECT i, greatest(0, (i + 0.5::DOUBLE) * 4 - 0.5::DOUBLE) AS p FROM range(8) AS a(i)),
w AS (SELECT i, CAST(floor(p) AS BIGINT) + d AS s, CASE WHEN d = 0 THEN 1 - (p - floor(p)) ELSE p - floor(p) END AS w FROM axis, range(2) AS b(d)),
r AS (SELECT scene_id, band, y.i AS y, x.i AS x, sum(coalesce(value, 0) / 4 * y.w * x.w) / 255 AS v FROM band_pixels JOIN w y ON y.s = prow JOIN w x ON x.s = pcol GROUP BY scene_id, band, y.i, x.i),
n AS (SELECT scene_id, (v - CASE band WHEN 1 THEN 0.485::DOUBLE WHEN 2 THEN 0.456::DOUBLE ELSE 0.406::DOUBLE END) / CASE band WHEN 1 THEN 0.229::DOUBLE WHEN 2 THEN 0.224::DOUBLE ELSE 0.225::DOUBLE END AS v,
   (band - 1) * 64 + y * 8 + x AS k FROM r)
SELECT scene_id, k AS position, round(v, 5) AS value FROM n""")
def _(t):
    p = t.band_pixels.select("scene_id", "band", "prow", "pcol", (F.coalesce("value", F.lit(0.0)) / 4).alias("value"))
    f = training.tile_features(p, ["scene_id"], 8, (32, 32))
    return f.select("scene_id", F.posexplode("features").alias("position", "v")).select("scene_id", F.col("position").cast("long").alias("position"), F.round("v", 5).alias("value"))


@query("m4_augment_flips", "band_pixels", """
, coins AS (SELECT DISTINCT scene_id, CAST('0x' || substr(sha256('42|0|' || CAST(scene_id AS VARCHAR)), 1, 1) AS INTEGER) AS coin FROM band_pixels)
SELECT p.scene_id, band, CASE WHEN p.scene_id % 10 < 7 THEN 'train' ELSE 'val' END AS split,
  CASE WHEN p.scene_id % 10 < 7 AND (coin // 2) % 2 = 1 THEN 31 - prow ELSE prow END AS prow,
  CASE WHEN p.scene_id % 10 < 7 AND coin % 2 = 1 THEN 31 - pcol ELSE pcol END AS pcol, value FROM band_pixels p JOIN coins USING (scene_id)""")
def _(t):
    p = t.band_pixels.withColumn("split", F.when(F.col("scene_id") % 10 < 7, "train").otherwise("val"))
    return training.augment_flips(p, ["scene_id"], 32, 32).select("scene_id", "band", "split", "prow", "pcol", "value")


def _samples(t):
    split = F.when(F.col("vec_id") % 10 < 7, "train").when(F.col("vec_id") % 10 < 9, "val").otherwise("test")
    return t.embeddings.select("vec_id", split.alias("split"), F.col("label").alias("class_index"), F.col("embedding").alias("features"))


@query("m1_train_classifier")
def _(t):
    model, history = training.train_classifier(_samples(t))
    return training.classify(model, _samples(t)).groupBy("split").agg(
        F.count(F.lit(1)).alias("samples"), F.avg((F.col("predicted_class") == F.col("class_index").cast("string")).cast("double")).alias("accuracy"))


@query("m2_classify")
def _(t):
    model, _ = training.train_classifier(_samples(t), epochs=(5,))
    return training.classify(model, _samples(t)).select("vec_id", "predicted_class", round_exact(F.get("ranking", F.lit(0))["score"], 4).alias("score"))
