"""Set operations on map records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_records(*selections: DataFrame) -> DataFrame:
    """All records of several tag selections, each (osm_type, osm_id) once: of differing records the one
    whose columns, written as JSON, come first."""
    every = reduce(DataFrame.unionByName, selections)
    rest = [c for c in every.columns if c not in ("osm_type", "osm_id")]
    if not rest:
        return every.distinct()
    whole = F.struct(*rest)
    first = every.groupBy("osm_type", "osm_id").agg(F.min_by(whole, F.to_json(whole)).alias("_r"))
    return first.select("osm_type", "osm_id", *[F.col(f"_r.`{c}`").alias(c) for c in rest]).select(*every.columns)
