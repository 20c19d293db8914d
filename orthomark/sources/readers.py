"""Readers: feature files, images, manifests and bulk extracts of map records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthomark.functions import geo, geometry, labels
from orthomark.operators import tiles
from orthomark.operators.ordering import running_totals
from orthomark.session import cut_lineage

# Fixed value: the source written on normalised map records.
RECORD_SOURCE = "OpenStreetMap via Overpass"
RECORD_URL = "https://www.openstreetmap.org/"
MANIFEST_COLUMNS = ("path", "label", "split", "group")
_FEATURE = "struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>"
_COLLECTION = f"type string, coordinate_space string, crs string, attribution string, features array<{_FEATURE}>"


def geojson_geometry(kind, coordinates) -> Column:
    """Geometry struct from a GeoJSON type and the JSON text of its coordinates."""
    k = F.col(kind) if isinstance(kind, str) else kind
    text = F.col(coordinates) if isinstance(coordinates, str) else coordinates

    def vertex(p):
        return F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))

    line = lambda ring: F.transform(ring, vertex)
    part = lambda rings: F.transform(rings, line)
    point = F.array(F.array(F.array(vertex(F.from_json(text, "array<double>")))))
    rings = (F.when(k == "Point", point)
             .when(k.isin("LineString", "MultiPoint"), F.array(F.array(line(F.from_json(text, "array<array<double>>")))))
             .when(k.isin("Polygon", "MultiLineString"), F.array(part(F.from_json(text, "array<array<array<double>>>"))))
             .when(k == "MultiPolygon", F.transform(F.from_json(text, "array<array<array<array<double>>>>"), part)))
    return geo.let(F.struct(k.alias("kind"), rings.alias("rings")), lambda g: F.when(g["rings"].isNotNull(), g))


def geojson_coordinates(geom) -> Column:
    """JSON text of the coordinates of a geometry struct."""
    g = F.col(geom) if isinstance(geom, str) else geom
    pair = lambda v: F.array(v["x"], v["y"])
    line = lambda ring: F.transform(ring, pair)
    part = lambda rings: F.transform(rings, line)
    first = F.get(F.get(g["rings"], F.lit(0)), F.lit(0))
    return (F.when(g["kind"] == "Point", F.to_json(pair(F.get(first, F.lit(0)))))
            .when(g["kind"].isin("LineString", "MultiPoint"), F.to_json(line(first)))
            .when(g["kind"].isin("Polygon", "MultiLineString"), F.to_json(part(F.get(g["rings"], F.lit(0)))))
            .otherwise(F.to_json(F.transform(g["rings"], part))))


def json_pieces(spark: SparkSession, path: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, features) of feature collections in any layout: file with the JSON text of all but the features, and file with
    the JSON text of each feature. ``wanted`` has the files to look at. Files without features have no root.

    Files are split at closing braces, so that a single line of any length is scanned by many tasks. What a piece does to
    the nesting depends on the pieces before: first whether it starts inside a string (the parity of quotes before it), then
    at which depth (a sum of braces and brackets outside of strings). Both are running sums over range partitions. A feature
    ends where an object closes to the depth of the list of features, and is put together from its pieces."""
    order = [F.col("_block"), F.col("_at")]
    raw = spark.read.option("lineSep", "}").text(path).select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    raw = raw.join(wanted, "file", "left_semi")
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # without escaped characters
    count = lambda text, mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    rows = running_totals(raw.withColumn("_plain", plain).withColumn("_q", count(F.col("_plain"), '"').cast("long")), ["file"], order, {"_quotes": F.col("_q")})
    inside_before, inside_after = (F.col("_quotes") - F.col("_q")) % 2 == 1, F.col("_quotes") % 2 == 1
    outer = F.when(inside_before, F.regexp_replace("_plain", r'(?s)^[^"]*("|$)', "")).otherwise(F.col("_plain"))
    outer = F.regexp_replace(F.regexp_replace(outer, r'"[^"]*"', ""), r'(?s)".*$', "")
    rows = rows.withColumn("_outer", outer)
    step = count(F.col("_outer"), "{") + count(F.col("_outer"), "[") - count(F.col("_outer"), "]") - F.when(inside_after, 0).otherwise(1)
    rows = running_totals(rows.withColumn("_closes", ~inside_after).withColumn("_step", step.cast("long")).drop("_plain", "_q", "_quotes"), ["file"], order, {"_depth": F.col("_step")})
    before = F.col("_depth") - F.col("_step")
    opening = r'(?s)^(.*?"features"\s*:\s*\[)(.*)$'
    opens = (before <= 1) & F.col("value").rlike(opening)
    ends = F.col("_closes") & (F.col("_depth") == 2)
    shuts = (before == 2) & F.col("_outer").rlike(r"^\s*\]")
    flags = rows.withColumns({"_opens": opens.cast("long"), "_ends": ends.cast("long"), "_shuts": shuts.cast("long")}).select("file", "_block", "_at", "value", "_closes", "_opens", "_ends", "_shuts")
    counted = running_totals(flags, ["file"], order, {"_opened": F.col("_opens"), "_ended": F.col("_ends"), "_shut": F.col("_shuts")})
    listed = cut_lineage(counted)
    brace = F.lit("}")  # what the pieces were split at
    first = F.col("_opens") == 1
    tail = F.regexp_extract("value", opening, 2)
    starts = first & tail.rlike(r"^\s*\{")
    within = (F.col("_opened") > 0) & (F.col("_shut") == 0)
    put = lambda df, keys, text: df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_at", text.alias("t")))), lambda p: p["t"]), "").alias("text"))
    own = F.concat(F.when(first, tail).otherwise(F.col("value")), brace)
    numbered = listed.where(within & (~first | starts)).withColumn("_n", F.col("_ended") - F.col("_ends"))
    features = put(numbered, ["file", "_n"], own).select("file", F.regexp_replace("text", r"^[\s,]+", "").alias("text"))
    outside = F.when(first & starts, F.regexp_extract("value", opening, 1)).otherwise(F.concat("value", brace))
    has_list = listed.where("_opens = 1").select("file").distinct()
    roots = put(listed.where(~within | first).join(has_list, "file", "left_semi"), ["file"], outside)
    return roots, features


def read_geojson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(features, rejected files). Rejected: other types, pixel space, other coordinate systems.

    A file with a head line, one feature a line and a closing line, as the writer makes them, is read by line. Any other
    layout, a single line too, is split at braces and put together feature by feature.
    """
    value = F.trim("value")
    is_feature = value.rlike(r'^,?\s*\{"type":\s*"Feature",')
    is_head = value.rlike(r'^\{"type":\s*"FeatureCollection".*"features":\s*\[$')
    is_end = value.isin("]}", "")
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    # One row per file.
    files = cut_lineage(lines.groupBy("file").agg(
        F.count_if(is_head).alias("heads"), F.count_if(~(is_feature | is_head | is_end)).alias("others"), F.max(F.when(is_head, value)).alias("head")))
    by_line = (F.col("heads") == 1) & (F.col("others") == 0)
    head = F.from_json(F.concat("head", F.lit("]}")), _COLLECTION)
    reason = (F.when(~F.coalesce(F.col("_d.type") == "FeatureCollection", F.lit(False)) | F.col("_d.features").isNull(), "not a feature collection")
              .when(F.col("_d.coordinate_space").isNotNull(), "pixel coordinates")
              .when(~F.coalesce(F.col("_d.crs").rlike("4326|CRS84"), F.lit(True)), "not WGS84"))
    heads = files.filter(by_line).select("file", head.alias("_d")).withColumn("reason", reason)
    feature = F.from_json(F.regexp_replace(value, r"^,\s*", ""), _FEATURE)
    found = (lines.filter(is_feature).join(heads.filter("reason IS NULL").select("file", "_d.attribution"), "file")
             .select("file", "attribution", feature.alias("f")))
    rejected = heads
    rest = files.filter(~by_line).select("file")
    if not rest.isEmpty():
        roots, texts = json_pieces(spark, path, rest)
        marked = rest.join(roots, "file", "left").select("file", F.from_json("text", _COLLECTION).alias("_d")).withColumn("reason", reason)
        put_together = texts.join(marked.filter("reason IS NULL").select("file", "_d.attribution"), "file").select("file", "attribution", F.from_json("text", _FEATURE).alias("f"))
        found, rejected = found.unionByName(put_together), heads.unionByName(marked)
    geom = geojson_geometry(F.col("f.geometry.type"), F.col("f.geometry.coordinates"))
    return (found.select("file", "attribution", geom.alias("geom"), F.col("f.properties").alias("properties")),
            rejected.filter("reason IS NOT NULL").select("file", "reason"))


def read_manifest(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Manifest rows with absolute paths; ``group`` becomes ``grp``. A byte-order mark is accepted. With
    ``multi_line`` quoted values may hold line ends, but a file is then read by one task."""
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    clean = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    missing = [c for c in MANIFEST_COLUMNS if c not in clean.columns]
    if missing:
        raise ValueError(f"manifest needs the columns {', '.join(MANIFEST_COLUMNS)}; missing: {', '.join(missing)}")
    base = F.regexp_replace(F.regexp_replace(F.input_file_name(), r"^file:/+", "/"), r"[^/]+$", "")
    located = F.when(F.col("path").rlike(r"^(/|[a-z0-9]+://)"), F.col("path")).otherwise(F.concat(base, "path"))
    return clean.select(located.alias("path"), "label", "split", F.col("group").alias("grp"),
                        *[c for c in clean.columns if c not in MANIFEST_COLUMNS])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw files (path, content) for digests."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def read_image_tiles(spark: SparkSession, path: str, scenes: DataFrame | None = None, size: int = tiles.SIZE) -> tuple[DataFrame, DataFrame]:
    """(images, tiles) of a folder of PNG, JPEG, BMP or plain TIFF files.

    Images carry path, file (its name), width, height, channels and, from ``scenes`` (path or file,
    transform), their georeference; one that cannot be decoded is kept with a reason. Tiles have the keys
    path and file, the bands red, green and blue, and are valid where alpha is above zero.
    """
    raw = spark.read.format("image").load(path).select("image.*")
    name = F.regexp_extract("origin", r"([^/]+)$", 1)
    broken = F.coalesce((F.col("width") < 1) | (F.col("nChannels") < 1), F.lit(True))
    seen = raw.select(F.col("origin").alias("path"), name.alias("file"), *[F.when(~broken, F.col(c)).alias(n) for c, n in (
        ("width", "width"), ("height", "height"), ("nChannels", "channels"))], F.when(broken, "not a readable image").alias("reason"), "data")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image in batch.itertuples(index=False):
                # Bytes are stored blue, green, red and, with four channels, alpha; grey has one.
                values = np.frombuffer(image.data, np.uint8).reshape(int(image.height), int(image.width), int(image.channels))
                for top in range(0, values.shape[0], size):
                    rows = []
                    for left in range(0, values.shape[1], size):
                        part = values[top:top + size, left:left + size]
                        colours = part[:, :, [0, 0, 0]] if part.shape[2] == 1 else part[:, :, [2, 1, 0]]
                        state = np.where(part[:, :, 3] > 0, tiles.VALID, tiles.PRESENT) if part.shape[2] == 4 else np.full(part.shape[:2], tiles.VALID)
                        rows.append([image.path, image.file, top // size, left // size, top, left, *part.shape[:2], "|u1",
                                     np.ascontiguousarray(colours.transpose(2, 0, 1)).tobytes(), state.astype(np.uint8).tobytes()])
                    yield pd.DataFrame(rows, columns=["path", "file", *tiles.FIELDS])

    carried = seen.filter("reason IS NULL").mapInPandas(decode, f"path string, file string, {tiles.TILE}")
    described = seen.drop("data")
    if scenes is not None:
        key = "path" if "path" in scenes.columns else "file"
        described = described.join(scenes.select(key, "transform"), key, "left")
    return described, carried


def read_images(spark: SparkSession, path: str, scenes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(images, pixels): as :func:`read_image_tiles`, with rows of red, green, blue and ``valid`` per pixel instead of tiles."""
    described, carried = read_image_tiles(spark, path, scenes)
    return described, tiles.pixels_of_tiles(carried, ["red", "green", "blue"], ("path", "file"), wide=True, kind="int")


def normalise_map_records(raw: DataFrame) -> DataFrame:
    """Raw elements (type, id, tags, geom, fetched_at) in the map-record schema; elements
    without geometry are dropped."""
    kept = raw.filter(F.col("geom").isNotNull() & (F.size(geometry.vertices("geom")) > 0))
    at = kept.withColumn("_at", geometry.representative_point("geom"))
    return at.select(
        F.col("type").alias("osm_type"), F.col("id").alias("osm_id"), "tags", F.try_element_at("tags", F.lit("name")).alias("name"),
        labels.address_from_tags("tags").alias("address"), F.lit(RECORD_SOURCE).alias("source"), "fetched_at",
        F.concat(F.lit(RECORD_URL), "type", F.lit("/"), F.col("id").cast("string")).alias("source_url"),
        F.lit(labels.MAPPED).alias("match_status"), geo.geohash_encode(F.col("_at.y"), F.col("_at.x")).alias("geohash"), "geom")
