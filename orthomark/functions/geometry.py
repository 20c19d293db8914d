"""Polygon and point geometry as nested arrays: parts -> rings -> vertices.

Everything here stays on the JVM. The exact overlap of general rings, which needs a sweep,
is in :mod:`orthomark.functions.ring_overlap`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orthomark.functions.geo import let

GEOMETRY_TYPE = "struct<kind:string,rings:array<array<array<struct<x:double,y:double>>>>>"


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def vertex(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def box_geom(x0, y0, x1, y1) -> Column:
    ring = F.array(vertex(x0, y0), vertex(x1, y0), vertex(x1, y1), vertex(x0, y1), vertex(x0, y0))
    return F.struct(F.lit("Polygon").alias("kind"), F.array(F.array(ring)).alias("rings"))


def point_geom(x, y) -> Column:
    return F.struct(F.lit("Point").alias("kind"), F.array(F.array(F.array(vertex(x, y)))).alias("rings"))


def map_vertices(geom, fx, fy) -> Column:
    """Apply ``fx(x, y)`` and ``fy(x, y)`` to every vertex (affine, projection, ...)."""
    g = _c(geom)
    rings = F.transform(g["rings"], lambda part: F.transform(part, lambda ring: F.transform(
        ring, lambda v: vertex(fx(v["x"], v["y"]), fy(v["x"], v["y"])))))
    return F.struct(g["kind"].alias("kind"), rings.alias("rings"))


def ring_area(ring: Column) -> Column:
    edges = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1),
                       lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(edges, F.lit(0.0), lambda total, e: total + e)) / F.lit(2.0)


def geom_area(geom) -> Column:
    """Shoelace area: outer ring minus holes, summed over parts; 0 for points and lines."""
    g = _c(geom)

    def part_area(part):
        holes = F.slice(part, F.lit(2), F.greatest(F.size(part) - 1, F.lit(0)))
        return ring_area(part[0]) - F.aggregate(F.transform(holes, ring_area), F.lit(0.0), lambda t, a: t + a)

    total = F.aggregate(F.transform(g["rings"], part_area), F.lit(0.0), lambda t, a: t + a)
    return F.when(g["kind"].isin("Polygon", "MultiPolygon"), total).otherwise(F.lit(0.0))


def vertices(geom) -> Column:
    return F.flatten(F.flatten(_c(geom)["rings"]))


def geom_bbox(geom) -> Column:
    return let(vertices(geom), lambda points: let(F.struct(
        F.transform(points, lambda v: v["x"]).alias("xs"), F.transform(points, lambda v: v["y"]).alias("ys")),
        lambda s: F.struct(F.array_min(s["xs"]).alias("xmin"), F.array_min(s["ys"]).alias("ymin"),
                           F.array_max(s["xs"]).alias("xmax"), F.array_max(s["ys"]).alias("ymax"))))


def _edges(geom) -> Column:
    """All ring edges as structs ax, ay, bx, by."""
    rings = F.flatten(_c(geom)["rings"])
    return F.flatten(F.transform(rings, lambda ring: F.zip_with(
        F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))),
        F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))),
        lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))))


def representative_point(geom) -> Column:
    """A point inside: the middle of the widest inner run at mid-height; a point is itself."""
    def crossings(edges, level):
        hit = F.filter(edges, lambda e: ((e["ay"] <= level) & (level < e["by"])) | ((e["by"] <= level) & (level < e["ay"])))
        return F.array_sort(F.transform(
            hit, lambda e: e["ax"] + (level - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"])))

    def widest(xs):
        starts = F.sequence(F.lit(0), F.size(xs) - 2, F.lit(2))
        return F.array_max(F.transform(starts, lambda i: F.struct(
            (F.get(xs, i + 1) - F.get(xs, i)).alias("width"), F.get(xs, i).alias("x"))))

    def inside(box):
        level = (box["ymin"] + box["ymax"]) / F.lit(2.0)
        return let(crossings(_edges(geom), level), lambda xs: F.when(F.size(xs) >= 2, let(
            widest(xs), lambda run: vertex(run["x"] + run["width"] / F.lit(2.0), level)))
            .otherwise(F.get(vertices(geom), F.lit(0))))

    return let(geom_bbox(geom), inside)


def covers_point(geom, x, y) -> Column:
    """Even-odd containment; points on an edge count as covered."""
    px, py = _c(x).cast("double"), _c(y).cast("double")
    edges = _edges(geom)

    def on_edge(e):
        cross = (e["bx"] - e["ax"]) * (py - e["ay"]) - (e["by"] - e["ay"]) * (px - e["ax"])
        return ((cross == 0) & (px >= F.least(e["ax"], e["bx"])) & (px <= F.greatest(e["ax"], e["bx"]))
                & (py >= F.least(e["ay"], e["by"])) & (py <= F.greatest(e["ay"], e["by"])))

    def right_of(e):
        spans = (e["ay"] > py) != (e["by"] > py)
        return F.when(spans, px < e["ax"] + (py - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"])).otherwise(F.lit(False))

    odd = F.size(F.filter(edges, right_of)) % 2 == 1
    return F.exists(edges, on_edge) | odd


def is_valid_geometry(geom) -> Column:
    """Non-empty, finite, closed rings with area for polygons."""
    g = _c(geom)
    points = vertices(g)
    finite = F.forall(points, lambda v: v["x"].isNotNull() & v["y"].isNotNull() & ~F.isnan(v["x"]) & ~F.isnan(v["y"])
                      & (F.abs(v["x"]) < F.lit(float("inf"))) & (F.abs(v["y"]) < F.lit(float("inf"))))
    closed = F.forall(F.flatten(g["rings"]), lambda r: (F.size(r) >= 4) & (r[0] == F.element_at(r, -1)))
    polygon = g["kind"].isin("Polygon", "MultiPolygon")
    return F.coalesce(g.isNotNull() & (F.size(points) > 0) & finite
                      & F.when(polygon, closed & (geom_area(g) > 0)).otherwise(F.lit(True)), F.lit(False))
