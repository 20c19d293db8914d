"""Band and pixel operators on tables of pixels (scene_id, band, prow, pcol, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomark.functions.geo import is_finite
from orthomark.operators import tiles
from orthomark.session import cut_lineage

SCENE = ("scene_id",)
# Overlay colours and weights.
DETECTION_BLEND = (0.55, 0.45, (50, 240, 160))
ADDED_BLEND = (0.4, 0.6, (45, 230, 125))
REMOVED_BLEND = (0.4, 0.6, (255, 80, 90))
NO_DATA_COLOUR = (40, 45, 55)
#: Rows of bands that one task brings together to pixels.
PIXELS_A_TASK = 4_000_000


def select_rgb(scenes: DataFrame, bands: Sequence[int] | None = None, names: str = "band_names") -> DataFrame:
    """1-based red, green and blue band of every scene from its declared band names, or the
    explicit three; a reason where neither works."""
    if bands is not None:
        chosen = F.array(*[F.lit(int(b)).cast("long") for b in bands])
        usable = F.forall(chosen, lambda b: (b >= 1) & (b <= F.size(names))) & F.lit(len(bands) == 3)
        reason = F.when(~usable, "RGB bands must be three valid one-based indexes")
    else:
        chosen = F.array(*[F.array_position(names, c) for c in ("red", "green", "blue")])
        usable = F.forall(chosen, lambda b: b > 0)
        reason = F.when(~usable, "raster does not declare RGB bands")
    return scenes.withColumn("rgb_bands", F.when(usable, chosen)).withColumn("reason", reason)


def valid_pixels(pixels: DataFrame, bands: int, keys: Sequence[str] = SCENE, alpha_band: int | None = None,
                 mask: DataFrame | None = None) -> DataFrame:
    """One row per pixel: valid when every band is present and finite, alpha and the data set
    mask (scene, prow, pcol, mask) are above zero."""
    at = [*keys, "prow", "pcol"]
    good = is_finite("value")
    if alpha_band is not None:
        good = F.when(F.col("band") == alpha_band, F.coalesce(F.col("value") > 0, F.lit(False))).otherwise(good)
    marked = pixels.select(*at, good.alias("_good"))
    # The pixels a task brings together do not grow with the table.
    parts = -(-marked.count() // PIXELS_A_TASK)
    if parts > int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        marked = marked.repartition(parts, *at)
    per_pixel = marked.groupBy(*at).agg((F.bool_and("_good") & (F.count_if("_good") == bands)).alias("valid"))
    if mask is None:
        return per_pixel
    joined = per_pixel.hint("merge").join(mask.select(*at, F.col("mask").alias("_m")), at, "left")
    return joined.select(*at, (F.col("valid") & (F.coalesce("_m", F.lit(0)) > 0)).alias("valid"))


def band_percentiles(pixels: DataFrame, low: float = 2, high: float = 98, keys: Sequence[str] = SCENE,
                     exact: bool = True, bands: Sequence | None = None) -> DataFrame:
    """Percentiles of the finite values per scene and band, linearly interpolated.

    Exact ones come from counts over tiles, in bounded memory for any number of different values;
    ``bands`` (else found by a pass over the table) are those to look at."""
    if not 0 <= low < high <= 100:
        raise ValueError("percentiles must satisfy 0 <= low < high <= 100")
    if not exact:
        finite = pixels.filter(is_finite("value"))
        return finite.groupBy(*keys, "band").agg(*[F.approx_percentile("value", F.lit(p / 100)).alias(n) for p, n in ((low, "p_low"), (high, "p_high"))])
    if bands is None:
        bands = sorted(r["band"] for r in pixels.select("band").distinct().where("band IS NOT NULL").collect())  # the bands of a sensor
    packed = cut_lineage(tiles.tiles_of(pixels, bands, keys))
    return tiles.tile_percentiles(packed, bands, low, high, keys, per_band=True)


def percentile_stretch(pixels: DataFrame, bands: int, low: float = 2, high: float = 98, keys: Sequence[str] = SCENE,
                       eight_bit: bool = False) -> DataFrame:
    """8-bit display values of all bands 1 to ``bands``: 0 on invalid pixels and on flat bands, else stretched between the
    percentiles of the pixels valid in all bands, truncated. 8-bit input is kept as it is.
    The tile form is :func:`orthomark.operators.tiles.stretch_tiles`; this one packs and unpacks pixel rows."""
    names = list(range(1, bands + 1))
    shown = tiles.stretch_tiles(tiles.tiles_of(pixels, names, keys), names, low, high, keys, eight_bit)
    return tiles.pixels_of_tiles(shown, names, keys, kind="bigint").select(*keys, "band", "prow", "pcol", "value")


def mosaic(tiles: DataFrame, offsets: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Tile pixels (tile_id, prow, pcol, ...) placed on the scene grid at their tile's offset."""
    keys = list(keys)
    placed = tiles.join(offsets.select(*keys, "tile_id", "x", "y"), [*keys, "tile_id"])
    rest = [c for c in tiles.columns if c not in (*keys, "tile_id", "prow", "pcol")]
    return placed.select(*keys, (F.col("prow") + F.col("y")).alias("prow"), (F.col("pcol") + F.col("x")).alias("pcol"), *rest)


def _target(matrix: Column, col: Column, row: Column) -> tuple[Column, Column]:
    m = lambda i: F.get(matrix, F.lit(i))
    depth = F.nullif(m(6) * col + m(7) * row + m(8), F.lit(0.0))
    return (m(0) * col + m(1) * row + m(2)) / depth, (m(3) * col + m(4) * row + m(5)) / depth


def warp(pixels: DataFrame, targets: DataFrame, value_columns: Sequence[str] = ("value",), keys: Sequence[str] = SCENE,
         nearest: bool = False) -> DataFrame:
    """Values of a source image at the pixels of a target grid.

    ``targets``: keys, prow, pcol and ``inverse``, the row-major 3x3 matrix from target to
    source pixels. Every target pixel asks for its four neighbours, weighted bilinearly
    (neighbours outside count as 0), or for the nearest one; an equi-join fetches them.
    """
    keys = list(keys)
    sx, sy = _target(F.col("inverse"), F.col("pcol").cast("double"), F.col("prow").cast("double"))
    at = targets.select(*keys, "prow", "pcol", sx.alias("_x"), sy.alias("_y"))
    if nearest:
        wanted = at.select(*keys, "prow", "pcol", F.floor(F.col("_x") + 0.5).cast("long").alias("_c"),
                           F.floor(F.col("_y") + 0.5).cast("long").alias("_r"), F.lit(1.0).alias("_w"))
    else:
        x0, y0 = F.floor("_x"), F.floor("_y")
        fx, fy = F.col("_x") - x0, F.col("_y") - y0
        corner = lambda dx, dy: F.struct((x0 + dx).cast("long").alias("c"), (y0 + dy).cast("long").alias("r"),
                                         ((fx if dx else 1 - fx) * (fy if dy else 1 - fy)).alias("w"))
        corners = F.filter(F.array(corner(0, 0), corner(1, 0), corner(0, 1), corner(1, 1)), lambda k: k["w"] > 0)
        wanted = at.select(*keys, "prow", "pcol", F.explode(corners).alias("k")).select(
            *keys, "prow", "pcol", F.col("k.c").alias("_c"), F.col("k.r").alias("_r"), F.col("k.w").alias("_w"))
    source = pixels.select(*keys, F.col("prow").cast("long").alias("_r"), F.col("pcol").cast("long").alias("_c"), *value_columns)
    found = wanted.hint("merge").join(source, [*keys, "_r", "_c"])
    return found.groupBy(*keys, "prow", "pcol").agg(*[F.sum(F.col("_w") * F.col(v)).alias(v) for v in value_columns])


def blend(colour, weight: float, paint_weight: float, paint) -> Column:
    """Truncated mix of a pixel value and a paint value."""
    c = F.col(colour) if isinstance(colour, str) else colour
    p = paint if isinstance(paint, Column) else F.lit(float(paint))
    return F.floor(F.lit(weight) * c + F.lit(paint_weight) * p).cast("long")


def paint(channel: int, value, detected=None, added=None, removed=None, valid=None) -> Column:
    """One channel (0 red, 1 green, 2 blue) of an overlay image: conditions are columns."""
    out = F.col(value) if isinstance(value, str) else value
    for condition, (keep, mix, colour) in ((detected, DETECTION_BLEND), (added, ADDED_BLEND), (removed, REMOVED_BLEND)):
        if condition is not None:
            out = F.when(condition, blend(out, keep, mix, colour[channel])).otherwise(out)
    if valid is not None:
        out = F.when(valid, out).otherwise(NO_DATA_COLOUR[channel])
    return out.cast("long")
