"""Table functions for SQL users, themselves SQL: they are planned into the query that calls them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from orthomark.functions.geo import GEOHASH_ALPHABET


def _offsets(length: str) -> str:
    """Window starts along one side: regular steps, and a last window that ends with the side."""
    return (f"CASE WHEN {length} <= size THEN array(0L) ELSE array_distinct(concat("
            f"sequence(0L, {length} - size, size - overlap), array({length} - size))) END")


WINDOWS = f"""
CREATE OR REPLACE TEMPORARY FUNCTION windows(width BIGINT, height BIGINT, size BIGINT, overlap BIGINT)
RETURNS TABLE(window_id BIGINT, x BIGINT, y BIGINT, w BIGINT, h BIGINT)
COMMENT 'the windows covering an image, numbered row by row'
RETURN SELECT i * cardinality(xs) + j, x, y, least(size, width - x), least(size, height - y)
  FROM (SELECT {_offsets('width')} AS xs, {_offsets('height')} AS ys) LATERAL VIEW posexplode(ys) AS i, y LATERAL VIEW posexplode(xs) AS j, x"""

_BIT = f"shiftright(instr('{GEOHASH_ALPHABET}', substr(t, CAST(k DIV 5 AS INT) + 1, 1)) - 1, 4 - CAST(k % 5 AS INT)) & 1"


def _halved(low: str, high: str) -> str:
    """The box with one axis cut to the half that the bit names."""
    part = {"w": "a.w", "s": "a.s", "e": "a.e", "n": "a.n"}
    middle = f"(a.{low} + a.{high}) / 2"
    box = lambda changed: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in {**part, changed: middle}.items()) + ")"
    return f"CASE WHEN {_BIT} = 1 THEN {box(low)} ELSE {box(high)} END"


GEOHASH_CELL = f"""
CREATE OR REPLACE TEMPORARY FUNCTION geohash_cell(code STRING)
RETURNS TABLE(west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE)
COMMENT 'the box of a geohash; no row for malformed text'
RETURN SELECT b.w, b.s, b.e, b.n FROM (
  SELECT aggregate(sequence(0, 5 * length(t) - 1), named_struct('w', -180D, 's', -90D, 'e', 180D, 'n', 90D),
    (a, k) -> CASE WHEN k % 2 = 0 THEN {_halved('w', 'e')} ELSE {_halved('s', 'n')} END) AS b
  FROM (SELECT lower(trim(code)) AS t) WHERE t RLIKE '^[{GEOHASH_ALPHABET}]{{1,12}}$')"""


def register_table_functions(spark: SparkSession) -> None:
    """Make ``windows`` and ``geohash_cell`` available to SQL (use with LATERAL)."""
    spark.sql(WINDOWS)
    spark.sql(GEOHASH_CELL)
