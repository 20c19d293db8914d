"""Writers: feature collections, label tables and the records of runs."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomark.functions import labels
from orthomark.sources.readers import geojson_coordinates

# Attribution of map data and the columns of the label table.
ATTRIBUTION = "© OpenStreetMap contributors (ODbL)"
FILE_FOLDERS = 256  # single files are spread over so many folders
LABEL_COLUMNS = ("object_id", "label", "visual_class", "score", "address", "candidate_address", "match_status", "source")


def feature_json(df: DataFrame, geom: str | None = "geom", properties: Sequence[str] | None = None) -> Column:
    """One GeoJSON feature per row; NULL properties are kept."""
    names = list(properties or [c for c in df.columns if c != geom])
    values = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    if geom is None:
        shape = F.lit("null")
    else:
        shape = F.concat(F.lit('{"type":"'), F.col(f"{geom}.kind"), F.lit('","coordinates":'), geojson_coordinates(geom), F.lit("}"))
    return F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(shape, F.lit("null")), F.lit(',"properties":'), values, F.lit("}"))


def write_geojson(df: DataFrame, path: str, geom: str = "geom", attribution: str = ATTRIBUTION, metadata: dict | None = None,
                  mode: str = "errorifexists") -> None:
    """Every partition becomes one file that is a complete FeatureCollection, one feature per
    line; nothing is gathered in one place."""
    head = json.dumps({"type": "FeatureCollection", "attribution": attribution, **(metadata or {})}, ensure_ascii=False)[:-1] + ', "features": ['

    def collection(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [head]})
        before = ""
        for batch in batches:
            lines = batch["value"].tolist()
            if lines:
                yield pd.DataFrame({"value": [before + lines[0], *("," + line for line in lines[1:])]})
                before = ","
        yield pd.DataFrame({"value": ["]}"]})

    df.select(feature_json(df, geom).alias("value")).mapInPandas(collection, "value string").write.mode(mode).text(path)


def label_rows(df: DataFrame) -> DataFrame:
    """The eight text columns of the label table; missing values are empty."""
    columns = {c: F.col(c) for c in df.columns}

    def text(name):
        if name == "label":
            return labels.display_label(columns)
        if name not in columns:
            return F.lit("")
        value = F.col(name).cast("string")
        if df.schema[name].dataType.simpleString() == "double":
            value = F.regexp_replace(value, r"\.0$", "")
        return F.coalesce(value, F.lit(""))

    return df.select(*[text(c).alias(c) for c in LABEL_COLUMNS])


def write_labels_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    (label_rows(df).write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "")
     .csv(path))


def write_image_features(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Pixel-space features by run, one JSON row each, labelled with their coordinate space."""
    shape = F.struct(F.col("geom.kind").alias("type"), geojson_coordinates("geom").alias("coordinates"))
    rest = [c for c in df.columns if c not in ("geom", "run_id")]
    out = df.select("run_id", F.lit("image_pixels").alias("coordinate_space"), shape.alias("geometry"), F.struct(*rest).alias("properties"))
    out.write.partitionBy("run_id").mode(mode).option("ignoreNullFields", "false").json(path)


def write_run(df: DataFrame, path: str, run_id: str, fmt: str = "parquet") -> str:
    """Results of one run in a folder of their own; an existing run is never overwritten."""
    target = f"{path.rstrip('/')}/run_id={run_id}"
    df.drop("run_id").write.mode("errorifexists").format(fmt).save(target)
    return target


def write_files(df: DataFrame, path: str, name: str = "name", content: str = "content") -> int:
    """A file of its own for every row, by its name, in one of FILE_FOLDERS folders told by the name; returns their number.

    Spark's writers name files by task, so a named file would need a folder of its own, made, listed and moved one by one.
    Tasks write through Arrow's file systems (local or shared folders, HDFS, object stores). A repeated task writes
    the same files again."""
    target = re.sub(r"^(file:)?/+", "file:///", path.rstrip("/"))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(target)
        made: set[str] = set()
        for batch in batches:
            for own, data in zip(batch["name"], batch["content"]):
                folder = f"{base}/block={zlib.crc32(own.encode()) % FILE_FOLDERS}"
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{folder}/{own}") as out:
                    out.write(data)
            yield pd.DataFrame({"n": [len(batch)]})

    written = df.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInPandas(put, "n bigint")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_masks(mask_runs: DataFrame, scores: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Instance masks as run-length rows, and their scores, by run: the rows of a run lie side by side in one of FILE_FOLDERS
    folders (``block``) told by the run, so that neither folders nor files are made one by one."""
    block = F.pmod(F.crc32(F.col("run_id").cast("string").cast("binary")), F.lit(FILE_FOLDERS)).cast("int")
    for rows, name in ((mask_runs, "mask_runs"), (scores, "scores")):
        # Adaptive execution splits a folder of very many rows over tasks and gives small ones to one.
        placed = rows.withColumn("block", block).hint("rebalance", F.col("block")).sortWithinPartitions("block", "run_id")
        placed.write.partitionBy("block").mode(mode).parquet(f"{path.rstrip('/')}/{name}")


def run_metadata(features: DataFrame, constants: dict | None = None, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """One row per run: objects, score range, matched objects and objects with a candidate name, least
    coverage with its warning (each where ``features`` has the columns), and the given constants."""
    n = F.count(F.lit(1)).alias("objects")
    extra = [F.min("score").alias("min_score"), F.max("score").alias("max_score")] if "score" in features.columns else []
    if "match_status" in features.columns:
        extra.append(F.count_if(F.col("match_status") != labels.UNMATCHED).alias("matched"))
    if "candidate_name" in features.columns:
        extra.append(F.count_if(F.col("candidate_name").isNotNull()).alias("with_candidate_name"))
    if "coverage_fraction" in features.columns:
        share = F.min("coverage_fraction")
        extra += [share.alias("coverage_fraction"), labels.coverage_warning(share).alias("warning")]
    counted = features.groupBy(*keys).agg(n, *extra)
    for name, value in (constants or {}).items():
        counted = counted.withColumn(name, value if isinstance(value, Column) else F.lit(value))
    return counted


def write_run_metadata(features: DataFrame, path: str, constants: dict | None = None, mode: str = "errorifexists") -> None:
    run_metadata(features, constants).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_training_record(path: str, manifest: DataFrame, history: DataFrame, evaluation: DataFrame, split_counts: DataFrame,
                          config: dict, model=None) -> None:
    """Resolved manifest, history per epoch, configuration with split counts, evaluation and the
    fitted model of one training run; an existing record is never overwritten."""
    base = path.rstrip("/")
    manifest.select("path", "label", "split", F.col("grp").alias("group")).write.mode("errorifexists").option("header", True).csv(f"{base}/resolved_manifest")
    history.write.mode("errorifexists").json(f"{base}/history")
    counts = split_counts.groupBy().pivot("split", ["train", "val", "test"]).agg(F.sum("samples"))
    settings = F.struct(*[F.lit(v).alias(k) if not isinstance(v, (list, tuple)) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in config.items()])
    counts.select(settings.alias("config"), F.struct(*[F.coalesce(s, F.lit(0)).alias(s) for s in ("train", "val", "test")]).alias("split_counts")).write.mode(
        "errorifexists").json(f"{base}/training_config")
    evaluation.write.mode("errorifexists").json(f"{base}/evaluation")
    if model is not None:
        model.write().save(f"{base}/model")
