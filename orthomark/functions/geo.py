"""Geographic scalar functions as Column expressions (lon/lat in WGS84 degrees)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kilometres and metres per degree, the sphere of EPSG:3857, its half width,
# the latitude limit of web imagery and the base-32 geohash alphabet.
KM_PER_DEGREE = 111.32
METRES_PER_DEGREE = 111320
MERCATOR_RADIUS = 6378137.0
MERCATOR_HALF = 20037508.342789244
IMAGERY_MAX_LATITUDE = 85.05112878
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
# Built-in imagery sources in order of preference.
IMAGERY_SOURCES = (
    {"id": "berlin", "bounds": (13.08, 52.32, 13.77, 52.69), "resolution_m": 0.2},
    {"id": "naip", "bounds": (-125.0, 24.0, -66.0, 50.0), "resolution_m": 0.6},
)


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


def _d(value) -> Column:
    return _c(value).cast("double")


def is_finite(value) -> Column:
    v = _d(value)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def bbox_area_km2(west, south, east, north) -> Column:
    w, s, e, n = map(_d, (west, south, east, north))
    middle = F.cos(F.radians((s + n) / F.lit(2.0)))
    return (e - w) * F.lit(KM_PER_DEGREE) * middle * (n - s) * F.lit(KM_PER_DEGREE)


def bbox_reason(west, south, east, north, max_km2: float | None = None) -> Column:
    """NULL for a usable box, else why it is rejected."""
    w, s, e, n = map(_d, (west, south, east, north))
    finite = is_finite(w) & is_finite(s) & is_finite(e) & is_finite(n)
    ordered = (w >= -180) & (w < e) & (e <= 180) & (s >= -90) & (s < n) & (n <= 90)
    reason = F.when(~finite, "not finite").when(~ordered, "invalid bounds")
    if max_km2 is not None:
        reason = reason.when(bbox_area_km2(w, s, e, n) > F.lit(float(max_km2)), "area too large")
    return reason


def valid_bbox(west, south, east, north, max_km2: float | None = None) -> Column:
    return bbox_reason(west, south, east, north, max_km2).isNull()


def bounds_around(lon, lat, radius_m=150) -> Column:
    """Struct west/south/east/north of the box ``radius_m`` around a point; NULL off the map."""
    x, y = _d(lon), _d(lat)
    dy = _d(radius_m) / F.lit(float(METRES_PER_DEGREE))
    dx = dy / F.greatest(F.cos(F.radians(y)), F.lit(0.001))
    box = F.struct(
        F.greatest(F.lit(-180.0), x - dx).alias("west"), F.greatest(F.lit(-90.0), y - dy).alias("south"),
        F.least(F.lit(180.0), x + dx).alias("east"), F.least(F.lit(90.0), y + dy).alias("north"))
    return F.when((x >= -180) & (x <= 180) & (y > -89.9) & (y < 89.9), box)


def _cell_index(value: Column, low: float, span: float, bits: int) -> Column:
    cells = 1 << bits
    index = F.floor((value - F.lit(low)) / F.lit(span) * F.lit(float(cells))).cast("long")
    return F.least(F.greatest(index, F.lit(0)), F.lit(cells - 1)).cast("long")


def geohash_encode(lat, lon, precision: int = 9) -> Column:
    """Base-32 geohash; longitude supplies the even bits."""
    total = precision * 5
    lon_bits, lat_bits = (total + 1) // 2, total // 2
    x = _cell_index(_d(lon), -180.0, 360.0, lon_bits)
    y = _cell_index(_d(lat), -90.0, 180.0, lat_bits)
    characters = []
    for position in range(precision):
        digit = F.lit(0).cast("long")
        for bit in range(position * 5, position * 5 + 5):
            source, shift = (x, lon_bits - 1 - bit // 2) if bit % 2 == 0 else (y, lat_bits - 1 - bit // 2)
            digit = digit * 2 + F.shiftright(source, shift).bitwiseAND(F.lit(1).cast("long"))
        characters.append(F.substr(F.lit(GEOHASH_ALPHABET), (digit + 1).cast("int"), F.lit(1)))
    return F.concat(*characters)


def geohash_normalised(text) -> Column:
    """Trimmed lower-case geohash, NULL unless it has 1-12 characters of the alphabet."""
    value = F.regexp_extract(F.lower(_c(text)), rf"^\s*([{GEOHASH_ALPHABET}]{{1,12}})\s*$", 1)
    return F.nullif(value, F.lit(""))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def geohash_decode(text) -> Column:
    """Struct west/south/east/north of the geohash cell; NULL for malformed text.

    Characters at even places carry three longitude and two latitude bits, at odd places the
    other way round, so each axis is a sum of digit parts times a power of two.
    """
    def cell(value):
        places = F.sequence(F.lit(1), F.length(value))
        digit = lambda i: F.instr(F.lit(GEOHASH_ALPHABET), F.substr(value, i, F.lit(1))).cast("long") - 1

        def odd_bits(d):   # bits 4, 2, 0
            return (F.floor(d / 16) % 2) * 4 + (F.floor(d / 4) % 2) * 2 + d % 2

        def even_bits(d):  # bits 3, 1
            return (F.floor(d / 8) % 2) * 2 + F.floor(d / 2) % 2

        def axis(first):
            def step(total, i):
                three = (i % 2 == 1) if first else (i % 2 == 0)
                return F.when(three, total * 8 + odd_bits(digit(i))).otherwise(total * 4 + even_bits(digit(i)))
            return F.aggregate(places, F.lit(0).cast("long"), step)

        bits = F.length(value) * 5
        dx = F.lit(360.0) / F.pow(F.lit(2.0), F.ceil(bits / 2).cast("double"))
        dy = F.lit(180.0) / F.pow(F.lit(2.0), F.floor(bits / 2).cast("double"))
        west, south = F.lit(-180.0) + axis(True) * dx, F.lit(-90.0) + axis(False) * dy
        return let(F.struct(west.alias("west"), south.alias("south"), dx.alias("dx"), dy.alias("dy")), lambda b: F.struct(
            b["west"].alias("west"), b["south"].alias("south"),
            (b["west"] + b["dx"]).alias("east"), (b["south"] + b["dy"]).alias("north")))

    return let(geohash_normalised(text), lambda value: F.when(value.isNotNull(), cell(value)))


def mercator_x(lon) -> Column:
    return F.lit(MERCATOR_RADIUS) * F.radians(_d(lon))


def mercator_y(lat) -> Column:
    return F.lit(MERCATOR_RADIUS) * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(_d(lat)) / F.lit(2.0)))


def from_mercator_lon(x) -> Column:
    return F.degrees(_d(x) / F.lit(MERCATOR_RADIUS))


def from_mercator_lat(y) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(_d(y) / F.lit(MERCATOR_RADIUS))) - F.lit(1.5707963267948966))


def tile_bounds(z, x, y) -> Column:
    """Web-Mercator extent of an XYZ tile (z 8..20); NULL outside the pyramid."""
    zoom, col, row = _c(z), _c(x), _c(y)
    count = F.pow(F.lit(2.0), zoom.cast("double"))
    span = F.lit(2 * MERCATOR_HALF) / count
    extent = F.struct(
        (col * span - F.lit(MERCATOR_HALF)).alias("xmin"), (F.lit(MERCATOR_HALF) - (row + 1) * span).alias("ymin"),
        ((col + 1) * span - F.lit(MERCATOR_HALF)).alias("xmax"), (F.lit(MERCATOR_HALF) - row * span).alias("ymax"))
    inside = zoom.between(8, 20) & (col >= 0) & (row >= 0) & (col < count) & (row < count)
    return F.when(inside, extent)


def affine(a, b, c, d, e, f) -> Column:
    """Transform struct: x = a*col + b*row + c, y = d*col + e*row + f."""
    return F.struct(*[_d(v).alias(n) for v, n in zip((a, b, c, d, e, f), "abcdef")])


def pixel_x(transform, col, row) -> Column:
    t = _c(transform)
    return t["a"] * _d(col) + t["b"] * _d(row) + t["c"]


def pixel_y(transform, col, row) -> Column:
    t = _c(transform)
    return t["d"] * _d(col) + t["e"] * _d(row) + t["f"]


def bounds_transform(west, south, east, north, width, height, col_off=0, row_off=0,
                     georeferenced=None) -> Column:
    """North-up transform of an image filling the bounds, shifted to a window; NULL when the
    bounds are unusable or the image is georeferenced already."""
    w, s, e, n = map(_d, (west, south, east, north))
    xres, yres = (e - w) / _d(width), (n - s) / _d(height)
    transform = affine(xres, 0.0, w + xres * _d(col_off), 0.0, -yres, n - yres * _d(row_off))
    usable = valid_bbox(w, s, e, n)
    if georeferenced is not None:
        usable = usable & ~_c(georeferenced)
    return F.when(usable, transform)


def shift_transform(transform, col_off, row_off) -> Column:
    """The transform of a window that starts at (col_off, row_off)."""
    t = _c(transform)
    return affine(t["a"], t["b"], pixel_x(t, col_off, row_off), t["d"], t["e"], pixel_y(t, col_off, row_off))


def laea_x(lon, lat, lon0, lat0, radius: float = 6371007.1809) -> Column:
    p, p0, dl = F.radians(_d(lat)), F.radians(_d(lat0)), F.radians(_d(lon) - _d(lon0))
    return F.lit(radius) * _laea_k(p, p0, dl) * F.cos(p) * F.sin(dl)


def laea_y(lon, lat, lon0, lat0, radius: float = 6371007.1809) -> Column:
    p, p0, dl = F.radians(_d(lat)), F.radians(_d(lat0)), F.radians(_d(lon) - _d(lon0))
    return F.lit(radius) * _laea_k(p, p0, dl) * (F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(dl))


def _laea_k(p: Column, p0: Column, dl: Column) -> Column:
    return F.sqrt(F.lit(2.0) / (F.lit(1.0) + F.sin(p0) * F.sin(p) + F.cos(p0) * F.cos(p) * F.cos(dl)))


def source_for(west, south, east, north, selection: str = "auto", sources=IMAGERY_SOURCES) -> Column:
    """Struct id/resolution_m/reason: the first source whose coverage holds the whole box.

    ``sources`` is a short configured list, so it becomes literals rather than a join.
    """
    w, s, e, n = map(_d, (west, south, east, north))
    usable = valid_bbox(w, s, e, n) & (s >= -IMAGERY_MAX_LATITUDE) & (n <= IMAGERY_MAX_LATITUDE)
    choice, resolution = F.when(~usable, None), F.when(~usable, None)
    for source in sources:
        if selection not in ("auto", source["id"]):
            continue
        west0, south0, east0, north0 = source["bounds"]
        inside = (w >= west0) & (e <= east0) & (s >= south0) & (n <= north0)
        choice = choice.when(inside, source["id"])
        resolution = resolution.when(inside, F.lit(float(source["resolution_m"])))
    reason = (F.when(~valid_bbox(w, s, e, n), "invalid bounds").when(~usable, "latitude out of range")
              .when(choice.isNull(), "no coverage"))
    return F.struct(choice.cast("string").alias("id"), resolution.cast("double").alias("resolution_m"),
                    reason.alias("reason"))
