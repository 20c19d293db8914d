"""Alignment of image pairs from landmarks: homography, its quality and its guards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomark.functions.geo import let
from orthomark.operators.walk import arranged, whole_groups

# Limits of the alignment checks.
MANUAL_POINTS = 4
MIN_MATCHES, MIN_INLIERS, MIN_INLIER_SHARE = 12, 10, 0.4
MANUAL_THRESHOLD, AUTO_THRESHOLD = 4.0, 3.0
MIN_DETERMINANT, AREA_RATIO, MIN_HULL, MIN_OVERLAP = 1e-8, (0.1, 10.0), 0.015, 0.15
SEED = 42
#: Distances of landmarks worked out at a time for the samples of many pairs.
FIT_VALUES = 250_000
METHODS = {"same_grid": "User-declared same pixel grid", "identical": "Identical image grids", "manual": "Manual landmarks",
           "auto": "Automatic landmark matching", "georeferenced": "Georeferenced common grid"}
FIT_TYPE = ("pair_id bigint, mode string, matrix array<double>, registration_error_px double, matched_landmarks bigint, "
            "landmarks bigint, inlier_share double, hull_area double, reason string")


def _four_point(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Exact homographies of batches of four point pairs; degenerate ones become NaN."""
    x, y, u, v = source[..., 0], source[..., 1], target[..., 0], target[..., 1]
    one, zero = np.ones_like(x), np.zeros_like(x)
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], -1),
                           np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], -1)], 1)
    with np.errstate(invalid="ignore"):
        flat = ~(np.abs(np.linalg.det(rows)) >= 1e-6)
    rows[flat] = np.eye(8)
    solved = np.linalg.solve(rows, np.concatenate([u, v], 1)[..., None])[..., 0]
    solved[flat] = np.nan
    return np.concatenate([solved, np.ones((len(solved), 1))], 1).reshape(-1, 3, 3)


def distances(matrices: np.ndarray, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """How far (pairs, n, 2) points under (pairs, ..., 3, 3) matrices lie from their targets: (pairs, ..., n)."""
    more = (slice(None), *[None] * (matrices.ndim - 3))
    x, y, u, v = (p[more] for p in (source[..., 0], source[..., 1], target[..., 0], target[..., 1]))
    m = matrices[..., None]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        depth = m[..., 2, 0, :] * x + m[..., 2, 1, :] * y + m[..., 2, 2, :]
        dx = (m[..., 0, 0, :] * x + m[..., 0, 1, :] * y + m[..., 0, 2, :]) / depth - u
        dy = (m[..., 1, 0, :] * x + m[..., 1, 1, :] * y + m[..., 1, 2, :]) / depth - v
        return np.sqrt(dx * dx + dy * dy)


def homographies(source: np.ndarray, target: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares homographies of many pairs (pairs, n, 2) by the points that are ``used``, by the normalised direct linear
    transform, and whether there is one."""
    n, one = used.sum(1)[:, None], used.astype(float)

    def scaled(p):
        p = np.where(used[..., None], p, 0)
        centre = p.sum(1) / n
        spread = (np.sqrt(((p - centre[:, None]) ** 2).sum(2)) * one).sum(1) / n[:, 0]
        s = np.sqrt(2) / np.where(spread == 0, 1, spread)
        t = np.zeros((len(p), 3, 3))
        t[:, 0, 0], t[:, 1, 1], t[:, 2, 2], t[:, :2, 2] = s, s, 1, -s[:, None] * centre
        return (p - centre[:, None]) * s[:, None, None] * one[..., None], t

    (a, ta), (b, tb) = scaled(source), scaled(target)
    h = np.concatenate([a, one[..., None]], 2)
    zero = np.zeros_like(h)
    rows = np.concatenate([np.concatenate([h, zero, -b[..., :1] * h], 2), np.concatenate([zero, h, -b[..., 1:] * h], 2)], 1)
    m = np.linalg.inv(tb) @ np.linalg.eigh(rows.transpose(0, 2, 1) @ rows)[1][:, :, 0].reshape(-1, 3, 3) @ ta
    found = np.isfinite(m).all((1, 2)) & (np.abs(m[:, 2, 2]) > 1e-12)
    return m / np.where(found, m[:, 2, 2], 1)[:, None, None], found


def fits_robust(source: np.ndarray, target: np.ndarray, threshold: float, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many pairs of n landmarks (pairs, n, 2): the homography of the largest consensus among seeded four-point samples,
    refitted on it, whether there is one, and the consensus.

    Samples, the same for all pairs, are drawn until a better consensus is as good as excluded (chance 1e-5). ``rounds`` ends
    the search only where a third of the landmarks or fewer agree, less than an automatic
    alignment needs to be accepted.
    """
    rng, (count, n) = np.random.default_rng(SEED), source.shape[:2]
    best, needed, done, active = np.zeros((count, n), bool), np.full(count, float(rounds)), 0, np.arange(count)
    batch = max(1, min(32, 1_000_000 // n))
    at_once = max(1, FIT_VALUES // (batch * n))
    while len(active):
        picks = (np.argsort(rng.random((batch, n)), axis=1)[:, :4] if n <= 10_000
                 else np.stack([rng.choice(n, 4, replace=False) for _ in range(batch)]))
        done += len(picks)
        for first in range(0, len(active), at_once):
            some = active[first:first + at_once]
            s, t = source[some], target[some]
            matrices = _four_point(s[:, picks].reshape(-1, 4, 2), t[:, picks].reshape(-1, 4, 2)).reshape(len(some), len(picks), 3, 3)
            inside = distances(matrices, s, t) <= threshold
            top = inside[np.arange(len(some)), inside.sum(2).argmax(1)]
            better = top.sum(1) > best[some].sum(1)
            some, top = some[better], top[better]
            best[some] = top
            with np.errstate(divide="ignore"):
                needed[some] = np.log(1e-5) / np.log(1 - top.mean(1)**4)
        active = active[done < np.minimum(rounds, needed[active])]
    matrices, found = np.full((count, 3, 3), np.nan), best.sum(1) >= 4
    for _ in range(3):
        for at in np.split(np.flatnonzero(found), np.arange(at_once, found.sum(), at_once)):
            matrices[at], found[at] = homographies(source[at], target[at], best[at])
            at = at[found[at]]
            best[at] = distances(matrices[at], source[at], target[at]) <= threshold
            found[at] = best[at].sum(1) >= 4
    return matrices, found, best


def hull_area(points: np.ndarray) -> float:
    """Area of the convex hull by the monotone chain."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return 0.0
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    chains = []
    for ordered in (pts, pts[::-1]):
        chain: list = []
        for p in ordered:
            while len(chain) > 1 and turn(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        chains += chain[:-1]
    h = np.array(chains)
    return abs(float((h[:, 0] * np.roll(h[:, 1], -1) - h[:, 1] * np.roll(h[:, 0], -1)).sum())) / 2


def align_pairs(landmarks: DataFrame) -> DataFrame:
    """Homography from before to after per pair, or the reason why there is none.

    ``landmarks``: pair_id, mode (manual or auto), bx, by, ax, ay in pixels. A pair is one group, about
    100 bytes a landmark in memory; its hypotheses are tried in batches that shrink as it grows.
    """
    finite = F.lit(True)
    for c in ("bx", "by", "ax", "ay"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    sizes = landmarks.groupBy("pair_id", "mode").agg(F.count(F.lit(1)).alias("landmarks"), F.bool_and(finite).alias("_finite"))
    reason = (F.when(~F.col("mode").isin("manual", "auto"), "unknown mode")
              .when((F.col("mode") == "manual") & (F.col("landmarks") < MANUAL_POINTS), "add four point pairs or more")
              .when(~F.col("_finite"), "landmarks must be finite")
              .when((F.col("mode") == "auto") & (F.col("landmarks") < MIN_MATCHES), "too few matches"))
    sizes = sizes.withColumn("reason", reason).drop("_finite")
    usable = landmarks.join(sizes.filter("reason IS NULL").select("pair_id", "mode"), ["pair_id", "mode"], "left_semi")

    def fit(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        sizes = np.diff(starts)
        points = frame[["bx", "by", "ax", "ay"]].to_numpy(float)
        points = points[np.lexsort((*points.T[::-1], np.repeat(np.arange(len(sizes)), sizes)))]
        heads = frame.iloc[starts[:-1]]
        modes, rows = heads["mode"].to_numpy(), [None] * len(sizes)
        # Pairs of a mode with equally many landmarks are fitted side by side.
        for n, mode in sorted(set(zip(sizes.tolist(), modes))):
            at = np.flatnonzero((sizes == n) & (modes == mode))
            both = points[starts[at][:, None] + np.arange(n)]
            source, target = both[..., :2], both[..., 2:]
            matrices, found, inside = fits_robust(source, target, MANUAL_THRESHOLD if mode == "manual" else AUTO_THRESHOLD)
            counts, flat = inside.sum(1), matrices.reshape(-1, 9).tolist()
            usable = found & np.isfinite(matrices).all((1, 2))
            usable[usable] = np.abs(np.linalg.det(matrices[usable])) >= MIN_DETERMINANT
            away = np.sort(np.where(inside, distances(matrices, source, target), np.inf), axis=1)
            for k, place in enumerate(at):
                count, share = int(counts[k]), float(inside[k].mean())
                why = None
                if mode == "auto" and (count < MIN_INLIERS or share < MIN_INLIER_SHARE):
                    why = "alignment is unreliable"
                elif not usable[k]:
                    why = "alignment is degenerate"
                error = area = None
                if found[k] and count:
                    error = round(float((away[k, (count - 1) // 2] + away[k, count // 2]) / 2), 3)
                    area = hull_area(target[k, inside[k]])
                rows[place] = (mode, flat[k] if found[k] else None, error, count, n, share, area, why)
        out = pd.DataFrame(rows, columns=columns[1:])
        out.insert(0, "pair_id", heads["pair_id"].to_numpy())
        return out

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(batches, ["pair_id", "mode"]):
            yield fit(frame, starts)

    columns = [c.split()[0] for c in FIT_TYPE.split(", ")]
    # Grouping would shuffle once more where the mode is a constant, into as few tasks as the small rows fill.
    fitted = arranged(usable.select("pair_id", "mode", "bx", "by", "ax", "ay"), ["pair_id", "mode"]).mapInPandas(fits, FIT_TYPE)
    none = lambda kind: F.lit(None).cast(kind)
    refused = sizes.filter("reason IS NOT NULL").select(
        F.col("pair_id").cast("long").alias("pair_id"), "mode", none("array<double>").alias("matrix"), none("double").alias("registration_error_px"),
        none("long").alias("matched_landmarks"), "landmarks", none("double").alias("inlier_share"), none("double").alias("hull_area"), "reason")
    return fitted.select(*columns).unionByName(refused.select(*columns))


def manual_landmarks(points: DataFrame) -> DataFrame:
    """Normalised 0..1 point pairs (bx, by, ax, ay, widths and heights of both images) in
    pixels; rows outside the images make the whole pair fail via NULL coordinates."""
    inside = F.lit(True)
    for c in ("bx", "by", "ax", "ay"):
        inside = inside & F.col(c).between(0, 1)
    scaled = {"bx": "before_width", "by": "before_height", "ax": "after_width", "ay": "after_height"}
    return points.select("pair_id", F.lit("manual").alias("mode"), *[F.when(inside, F.col(c) * F.col(s)).alias(c) for c, s in scaled.items()])


def align_same_grid(pairs: DataFrame) -> DataFrame:
    """Pairs declared to share a grid: method, or a reason when the sizes differ."""
    same = (F.col("before_width") == F.col("after_width")) & (F.col("before_height") == F.col("after_height"))
    return pairs.withColumn("method", F.when(same, METHODS["same_grid"])).withColumn("reason", F.when(~same, "images differ in size"))


def align_georeferenced(pairs: DataFrame) -> DataFrame:
    """Pairs brought to the grid of the after image by their transforms (before_transform, after_transform,
    sizes; one crs, or equal before_crs and after_crs): method and the matrix from before to after
    pixels. Grids that are the same already keep the identity. Otherwise a reason."""
    b, a = F.col("before_transform"), F.col("after_transform")
    size = (F.col("before_width") == F.col("after_width")) & (F.col("before_height") == F.col("after_height"))
    crs = F.lit(True)
    if "before_crs" in pairs.columns:
        crs = F.col("before_crs").eqNullSafe(F.col("after_crs"))
    det = a["a"] * a["e"] - a["b"] * a["d"]
    # Before pixels to the ground, and from there to after pixels.
    inverse = {"a": a["e"] / det, "b": -a["b"] / det, "d": -a["d"] / det, "e": a["a"] / det}
    dx, dy = b["c"] - a["c"], b["f"] - a["f"]
    row = lambda p, q: [p * b["a"] + q * b["d"], p * b["b"] + q * b["e"], p * dx + q * dy]
    zero, one = F.lit(0.0), F.lit(1.0)
    matrix = F.array(*row(inverse["a"], inverse["b"]), *row(inverse["d"], inverse["e"]), zero, zero, one)
    reason = (F.when(b.isNull() | a.isNull(), "not georeferenced").when(~crs, "different coordinate systems")
              .when(F.abs(det) < F.lit(1e-30), "degenerate"))
    same = size & b.eqNullSafe(a)
    marked = pairs.withColumn("reason", reason)
    identity = F.array(*[one if i % 4 == 0 else zero for i in range(9)])
    usable = F.col("reason").isNull()
    return (marked.withColumn("method", F.when(usable & same, METHODS["identical"]).when(usable, METHODS["georeferenced"]))
            .withColumn("matrix", F.when(usable & same, identity).when(usable, matrix)))


def apply_matrix(matrix, x, y) -> Column:
    """Struct x, y of a point under a row-major 3x3 matrix."""
    m = lambda i: F.get(matrix, F.lit(i))
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    depth = F.nullif(m(6) * x + m(7) * y + m(8), F.lit(0.0))
    return F.struct(((m(0) * x + m(1) * y + m(2)) / depth).alias("x"), ((m(3) * x + m(4) * y + m(5)) / depth).alias("y"))


def determinant(matrix) -> Column:
    m = lambda i: F.get(matrix, F.lit(i))
    return m(0) * (m(4) * m(8) - m(5) * m(7)) - m(1) * (m(3) * m(8) - m(5) * m(6)) + m(2) * (m(3) * m(7) - m(4) * m(6))


def inverse_matrix(matrix) -> Column:
    """Row-major inverse of a 3x3 matrix; NULL where it has none."""
    m = lambda i: F.get(matrix, F.lit(i)).cast("double")
    minors = [m(4) * m(8) - m(5) * m(7), m(2) * m(7) - m(1) * m(8), m(1) * m(5) - m(2) * m(4), m(5) * m(6) - m(3) * m(8), m(0) * m(8) - m(2) * m(6),
              m(2) * m(3) - m(0) * m(5), m(3) * m(7) - m(4) * m(6), m(1) * m(6) - m(0) * m(7), m(0) * m(4) - m(1) * m(3)]
    det = determinant(matrix)
    return F.when(det != 0, F.array(*[v / F.nullif(det, F.lit(0.0)) for v in minors]))


def align_by_mode(pairs: DataFrame, landmarks: DataFrame | None = None) -> DataFrame:
    """pair_id, sizes, method, the matrix from before to after pixels, its inverse, registration_error_px and matched_landmarks of every pair,
    or a reason.

    ``pairs``: pair_id, mode (same_grid, georeferenced, manual or auto), before_width, before_height, after_width,
    after_height and, for georeferenced ones, the transforms. Manual and automatic pairs take their ``landmarks``
    (pair_id, bx, by, ax, ay in pixels) and are held to the guards of an alignment."""
    sizes = ["before_width", "before_height", "after_width", "after_height"]
    none = lambda kind: F.lit(None).cast(kind)
    identity = F.array(*[F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)])
    columns = ["pair_id", *sizes, "method", "matrix", "registration_error_px", "matched_landmarks", "reason"]
    plain = {"registration_error_px": none("double"), "matched_landmarks": none("long")}
    same = align_same_grid(pairs.where("mode = 'same_grid'")).withColumns({"matrix": F.when(F.col("reason").isNull(), identity), **plain})
    out = same.select(*columns)
    if "before_transform" in pairs.columns:
        out = out.unionByName(align_georeferenced(pairs.where("mode = 'georeferenced'")).withColumns(plain).select(*columns))
    if landmarks is not None:
        wanted = pairs.where("mode IN ('manual', 'auto')").select("pair_id", "mode", *sizes)
        fitted = align_pairs(landmarks.select("pair_id", "bx", "by", "ax", "ay").join(wanted.select("pair_id", "mode"), "pair_id"))
        joined = wanted.join(fitted.drop("mode").withColumnRenamed("reason", "_why"), "pair_id", "left").withColumn("overlap_fraction", none("double"))
        guarded = alignment_guards(joined).withColumn("method", F.when(F.col("mode") == "manual", METHODS["manual"]).otherwise(METHODS["auto"]))
        why = F.coalesce("_why", F.when(F.col("landmarks").isNull(), F.when(F.col("mode") == "manual", "add four point pairs or more").otherwise("too few matches")), "reason")
        out = out.unionByName(guarded.withColumn("reason", why).select(*columns))
    known = ["same_grid", *(["georeferenced"] if "before_transform" in pairs.columns else []), *(["manual", "auto"] if landmarks is not None else [])]
    rest = pairs.where(F.col("mode").isNull() | ~F.col("mode").isin(*known)).withColumns({"method": none("string"), "matrix": none("array<double>"), **plain, "reason": F.lit("unknown mode")})
    return out.unionByName(rest.select(*columns)).withColumn("inverse", inverse_matrix(F.col("matrix")))


def alignment_guards(pairs: DataFrame) -> DataFrame:
    """Adds reason (NULL when the alignment is usable) from matrix, image sizes, hull_area and
    overlap_fraction."""
    w, h = F.col("before_width").cast("double"), F.col("before_height").cast("double")
    zero = F.lit(0.0)
    corners = F.array(*[apply_matrix("matrix", x, y) for x, y in ((zero, zero), (w, zero), (w, h), (zero, h))])

    def shape(c):
        point = lambda i: F.get(c, F.lit(i % 4))
        turns = [(point(i + 1)["x"] - point(i)["x"]) * (point(i + 2)["y"] - point(i + 1)["y"])
                 - (point(i + 1)["y"] - point(i)["y"]) * (point(i + 2)["x"] - point(i + 1)["x"]) for i in range(4)]
        area = sum((point(i)["x"] * point(i + 1)["y"] - point(i + 1)["x"] * point(i)["y"] for i in range(4)), zero) / 2
        convex = (F.greatest(*turns) <= 0) | (F.least(*turns) >= 0)
        return F.struct(F.abs(area).alias("area"), convex.alias("convex"))

    target = F.col("after_width").cast("double") * F.col("after_height").cast("double")
    out = pairs.withColumn("_c", corners).withColumn("_q", let(F.col("_c"), shape)).withColumn("_det", determinant("matrix"))
    ratio = F.col("_q.area") / target
    reason = (F.when(F.col("matrix").isNull() | F.isnan("_det") | (F.abs("_det") < MIN_DETERMINANT), "degenerate")
              .when(~F.col("_q.convex") | ~((ratio > AREA_RATIO[0]) & (ratio < AREA_RATIO[1])), "excessive distortion")
              .when(F.col("hull_area") / target < MIN_HULL, "landmarks too close together")
              .when(F.col("overlap_fraction") < MIN_OVERLAP, "less than 15% usable overlap"))
    return out.withColumn("reason", reason).drop("_c", "_q", "_det")


def registration_quality(landmarks: DataFrame, threshold: float = AUTO_THRESHOLD) -> DataFrame:
    """Median residual of the inliers, their count and share per pair; landmarks carry the
    pair's matrix."""
    p = apply_matrix("matrix", F.col("bx").cast("double"), F.col("by").cast("double"))
    rows = landmarks.withColumn("_p", p)
    dx, dy = F.col("_p.x") - F.col("ax"), F.col("_p.y") - F.col("ay")
    residual = F.sqrt(dx * dx + dy * dy)
    inside = residual <= F.lit(float(threshold))
    return rows.groupBy("pair_id").agg(
        F.percentile(F.when(inside, residual), F.lit(0.5)).alias("registration_error_px"),
        F.count_if(inside).alias("matched_landmarks"), F.avg(inside.cast("double")).alias("inlier_share"))
