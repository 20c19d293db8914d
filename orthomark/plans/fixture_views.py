"""Derived input views over the driver's tables.

Each body parses in Spark SQL and in ANSI engines; table names are written in braces.
Coordinates are grid units inside a scene.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthomark.session import spread

VIEWS: dict[str, str] = {
    "detections": """
SELECT l_orderkey * 8 + l_linenumber AS object_id,
       CAST((l_orderkey - l_orderkey % 100) / 100 AS BIGINT) AS scene_id,
       CAST((min(l_partkey) * 7919 + l_orderkey * 131) % 600 AS BIGINT) AS x0,
       CAST((min(l_suppkey) * 6007 + l_orderkey * 977 + l_linenumber * 53) % 600 AS BIGINT) AS y0,
       CAST(10 + max(l_quantity) AS BIGINT) AS w,
       CAST(10 + (l_orderkey * 17 + l_linenumber * 5) % 40 AS BIGINT) AS h,
       round(max(l_discount) * 10, 2) AS score,
       CASE l_linenumber % 4 WHEN 0 THEN 'building' WHEN 1 THEN 'tree'
                             WHEN 2 THEN 'water' ELSE 'road' END AS concept
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "map_polygons": """
SELECT p_partkey AS osm_id, 'way' AS osm_type,
       CAST((p_partkey - p_partkey % 13) / 13 AS BIGINT) AS scene_id,
       CAST((p_partkey * 7919) % 600 AS BIGINT) AS x0,
       CAST((p_partkey * 6007) % 600 AS BIGINT) AS y0,
       CAST(20 + p_size AS BIGINT) AS w, CAST(20 + p_partkey % 40 AS BIGINT) AS h,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS name,
       CASE p_type WHEN 'PROMO' THEN 'amenity' WHEN 'ECONOMY' THEN 'building'
                   WHEN 'LARGE' THEN 'leisure' WHEN 'MEDIUM' THEN 'natural' ELSE 'shop' END AS tag_key,
       CASE p_type WHEN 'PROMO' THEN CASE WHEN p_size % 2 = 0 THEN 'hospital' ELSE 'school' END
                   WHEN 'LARGE' THEN 'park' WHEN 'MEDIUM' THEN 'water' ELSE 'yes' END AS tag_value
FROM {part}""",
    "map_points": """
SELECT c_custkey AS osm_id, 'node' AS osm_type,
       CAST((c_custkey - c_custkey % 10) / 10 AS BIGINT) AS scene_id,
       CAST((c_custkey * 7919 + 37) % 600 AS BIGINT) AS x,
       CAST((c_custkey * 6007 + 11) % 600 AS BIGINT) AS y,
       c_name AS name,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(c_custkey % 200 AS STRING) END AS housenumber,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE concat(c_mktsegment, ' Road') END AS street,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE n_name END AS city
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "geo_points": """
SELECT c_custkey AS point_id,
       CAST(-180 AS DOUBLE) + (c_custkey * 104729 % 360000) / CAST(1000 AS DOUBLE) AS lon,
       CAST(-80 AS DOUBLE) + (c_custkey * 7919 % 160000) / CAST(1000 AS DOUBLE) AS lat
FROM {customer}""",
    "view_requests": """
SELECT o_orderkey AS request_id,
       CAST(13.08 AS DOUBLE) + (o_orderkey * 37 % 700) / CAST(1000 AS DOUBLE) AS west,
       CAST(52.32 AS DOUBLE) + (o_orderkey * 53 % 380) / CAST(1000 AS DOUBLE) AS south,
       CAST(13.08 AS DOUBLE) + (o_orderkey * 37 % 700) / CAST(1000 AS DOUBLE) + (o_orderkey % 41 - 1) / CAST(1000 AS DOUBLE) AS east,
       CAST(52.32 AS DOUBLE) + (o_orderkey * 53 % 380) / CAST(1000 AS DOUBLE) + (1 + o_orderkey % 30) / CAST(1000 AS DOUBLE) AS north,
       CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0.6 ELSE 0.2 END AS DOUBLE) AS resolution_m
FROM {orders}""",
    "label_edits": """
SELECT event_id AS edit_id, event_id % 500 AS edit_object, ts AS edited_at, user_id AS reviewer,
       event_type AS reviewed_label, event_id % 7 = 0 AS rejected
FROM {events}""",
    "fetch_log": """
SELECT event_id AS request_id, ts AS requested_at,
       concat(CAST(user_id AS STRING), '|', event_type) AS request_text,
       CAST(1 + event_id * 7919 % 4096 AS BIGINT) AS size_kb
FROM {events}""",
    "query_log": """
SELECT event_id AS query_id,
       CASE event_id % 16
         WHEN 0 THEN concat('mark all hospitals in Town', CAST(event_id % 90 + 10 AS STRING), 'x')
         WHEN 1 THEN 'where are schools in this area?'
         WHEN 2 THEN concat('where is house number ', CAST(event_id % 90 AS STRING), ' Example Street')
         WHEN 3 THEN 'mark hiking routes'
         WHEN 4 THEN 'directions from Berlin to Potsdam'
         WHEN 5 THEN concat(CAST(event_id % 80 AS STRING), '.5,13.405')
         WHEN 6 THEN 'geohash: u33dc1'
         WHEN 7 THEN 'detect buildings and trees here'
         WHEN 8 THEN 'only show buildings without addresses'
         WHEN 9 THEN 'label these buildings with names and addresses'
         WHEN 10 THEN 'compare before and after'
         WHEN 11 THEN 'find amenity=pharmacy near Alexanderplatz'
         WHEN 12 THEN 'find hospitals using satellite imagery'
         WHEN 13 THEN 'show parks around Lake Merritt!'
         WHEN 14 THEN 'segment swimming pool in Berkeley'
         ELSE concat('Alexanderplatz ', event_type) END AS text
FROM {events}""",
    "manifest": """
SELECT doc_id AS sample_id, concat('tiles/', CAST(doc_id AS STRING), '.png') AS path, lang AS label,
       CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END AS split,
       concat('scene_', CAST((doc_id + CASE WHEN doc_id % 97 = 0 THEN 1 ELSE 0 END) % 50 AS STRING)) AS grp,
       text AS file_bytes
FROM {documents}""",
    "predictions": """
SELECT vec_id AS sample_id, label AS target,
       CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 10 ELSE label END AS predicted,
       CASE WHEN vec_id % 10 < 7 THEN 'train' WHEN vec_id % 10 < 9 THEN 'val' ELSE 'test' END AS split
FROM {embeddings}""",
    "epoch_log": """
SELECT o_custkey AS run_id, o_orderkey AS epoch,
       round(1 + (o_orderkey * 37 % 101) / CAST(100 AS DOUBLE), 2) AS val_loss, 8 + o_orderkey % 9 AS n_samples
FROM {orders}""",
    "mask_pixels": """
SELECT s_suppkey AS scene_id, r AS prow, c AS pcol,
       r >= s_suppkey % 10 AS valid,
       ((r - r % 8) + (c - c % 8) * 3 + s_suppkey * 8) % 40 = 0 AS before_hit,
       CASE WHEN s_suppkey % 3 = 0
            THEN ((r - r % 8) + (c + 1 - (c + 1) % 8) * 3 + s_suppkey * 8) % 40 = 0
            ELSE ((r - r % 8) + (c - c % 8) * 3 + s_suppkey * 8) % 40 = 0
                 OR ((r - r % 16) + (c - c % 16) + s_suppkey * 16) % 112 = 0
                 OR (r * 64 + c + s_suppkey) % 509 = 0 END AS after_hit
FROM {supplier} CROSS JOIN range(64) AS tr(r) CROSS JOIN range(64) AS tc(c)""",
    "band_pixels": """
SELECT s_suppkey AS scene_id, b + 1 AS band, r AS prow, c AS pcol,
       CASE WHEN (r * 32 + c + s_suppkey) % 29 = 0 THEN NULL
            ELSE ((r * 7 + c * 13 + s_suppkey * 31 + b * 50) % 256) * CAST(4 AS DOUBLE) END AS value
FROM {supplier} CROSS JOIN range(3) AS tb(b) CROSS JOIN range(32) AS tr(r) CROSS JOIN range(32) AS tc(c)""",
}

#: Grids made by one task.
GRIDS_A_TASK = 256

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view as a DataFrame; the grids are generated per supplier row, not joined."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    body = VIEWS[name]
    frames = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in body}
    if "CROSS JOIN" not in body:
        return spark.sql(body, **frames)
    select = body[:body.index("FROM {supplier}")]
    # A small file is one task's; the grids made from it are not, nor does a task's share of them grow with the file.
    suppliers = table(spark, sf_dir, "supplier")
    parts = -(-suppliers.count() // GRIDS_A_TASK)
    grid = spread(suppliers) if parts <= int(spark.conf.get("spark.sql.shuffle.partitions")) else suppliers.repartition(parts)
    if name == "band_pixels":
        grid = grid.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    side = {"mask_pixels": 63, "band_pixels": 31}[name]
    for axis in ("r", "c"):
        grid = grid.withColumn(axis, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(side).cast("long"))))
    return spark.sql(select + "FROM {grid}", grid=grid)


def ansi(name: str) -> str:
    """The view body with plain table names, for the comparison engine."""
    return VIEWS[name].format(**{t: t for t in TABLES})


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """``body`` preceded by the named views (space separated) as common table expressions.

    ``body`` may start with ``, extra AS (...)`` clauses of its own.
    """
    clauses = ", ".join(f"{n} AS ({ansi(n)})" for n in names.split() if n in VIEWS)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return f"{head}{clauses} {body}" if clauses else f"{head}{body.lstrip(', ')}" if recursive else body
