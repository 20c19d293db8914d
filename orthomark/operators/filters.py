"""Filters and predicates on records and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomark.functions import geometry
from orthomark.functions.labels import filled

# Fixed values: (key, value) conditions per category; a value of None accepts any.
CATEGORY_RULES: dict[str, tuple[tuple[str, str | None], ...]] = {
    "buildings": (("building", None),),
    "hospitals": (("amenity", "hospital"), ("healthcare", "hospital")),
    "schools": (("amenity", "school"),),
    "parks": (("leisure", "park"),),
    "water": (("natural", "water"), ("waterway", None)),
    "roads": (("highway", None),),
    "hiking": (("route", "hiking"), ("route", "foot")),
    "restaurants": (("amenity", "restaurant"),),
    "shops": (("shop", None),),
    "trees": (("natural", "tree"), ("natural", "wood"), ("landuse", "forest")),
    "all": tuple((key, None) for key in (
        "building", "amenity", "shop", "leisure", "natural", "waterway", "highway", "landuse",
        "railway", "tourism", "route", "addr:housenumber")),
}
TAG_PATTERN = r"^[A-Za-z0-9_:.-]+=[A-Za-z0-9_: .;-]+$"


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def in_category(tags, category: str) -> Column:
    """The rules are a small fixed table, so they are literals in one predicate."""
    if category not in CATEGORY_RULES:
        raise ValueError(f"unknown category {category!r}; choose one of {list(CATEGORY_RULES)}")
    t, found = _c(tags), F.lit(False)
    for key, value in CATEGORY_RULES[category]:
        found = found | (F.map_contains_key(t, key) if value is None else F.coalesce(t[key] == value, F.lit(False)))
    return found


def categories_of(tags) -> Column:
    """All categories a record belongs to."""
    return F.filter(F.array(*[F.when(in_category(tags, c), c) for c in CATEGORY_RULES]), lambda c: c.isNotNull())


def filter_category(records: DataFrame, category: str, tags: str = "tags") -> DataFrame:
    return records.filter(in_category(tags, category))


def tag_matches(tags, tag) -> Column:
    """``tag`` is ``key=value``; malformed text matches nothing (see ``tag_reason``)."""
    text = _c(tag) if isinstance(tag, Column) else F.lit(tag)
    key, value = F.substring_index(text, "=", 1), F.substr(text, F.instr(text, "=") + 1)
    return F.coalesce(text.rlike(TAG_PATTERN) & (F.try_element_at(_c(tags), key) == value), F.lit(False))


def tag_reason(tag) -> Column:
    return F.when(~_c(tag).rlike(TAG_PATTERN), "custom tag must be key=value")


def filter_tag(records: DataFrame, tag: str, tags: str = "tags") -> DataFrame:
    return records.filter(tag_matches(tags, tag))


def filter_bbox(records: DataFrame, xmin, ymin, xmax, ymax) -> DataFrame:
    """Records whose box touches the given one; plain comparisons reach the parquet scan."""
    return records.filter((F.col("x0") <= xmax) & (F.col("x1") >= xmin) & (F.col("y0") <= ymax) & (F.col("y1") >= ymin))


def has_address(address="address", candidate_address="candidate_address", evidence="map_evidence") -> Column:
    known = filled(address).isNotNull() | filled(candidate_address).isNotNull()
    if evidence is None:
        return known
    listed = F.exists(_c(evidence), lambda e: filled(e["address"]).isNotNull())
    return known | F.coalesce(listed, F.lit(False))


RESULT_MODES = ("rejected", "all", "has_address", "missing_address")


def result_condition(mode: str = "all", addressed: Column | None = None) -> Column:
    """What a result mode shows; all but ``rejected`` leave rejected rows out."""
    if mode not in RESULT_MODES:
        raise ValueError(f"choose one of {RESULT_MODES}")
    rejected = F.coalesce(F.col("rejected"), F.lit(False))
    if mode == "rejected":
        return rejected
    if mode == "all":
        return ~rejected
    addressed = has_address() if addressed is None else addressed
    return ~rejected & (addressed if mode == "has_address" else ~addressed)


def filter_results(df: DataFrame, mode: str = "all", addressed: Column | None = None) -> DataFrame:
    return df.filter(result_condition(mode, addressed))


def filter_score(df: DataFrame, threshold: float) -> DataFrame:
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must lie between zero and one")
    return df.filter(F.col("score") >= threshold)


def min_pixels(runs: DataFrame, minimum: int, keys: list[str]) -> DataFrame:
    """Runs of the masks with at least ``minimum`` pixels."""
    large = runs.groupBy(*keys).agg(F.sum(F.col("c1") - F.col("c0")).alias("_n")).filter(F.col("_n") >= minimum)
    return runs.hint("merge").join(large.select(*keys), keys, "left_semi")


def check_geometry(df: DataFrame, geom: str = "geom") -> DataFrame:
    """All rows with a reason column for empty or invalid geometry."""
    g = F.col(geom)
    empty = g.isNull() | (F.size(geometry.vertices(g)) == 0)
    return df.withColumn("reason", F.when(empty, "empty geometry").when(~geometry.is_valid_geometry(g), "invalid geometry"))


def run_limits(df: DataFrame, run: str = "run_id", limit: int | None = None) -> DataFrame:
    """Features per run, with a reason above a limit if there is one."""
    counted = df.groupBy(run).agg(F.count(F.lit(1)).alias("features"))
    return counted.withColumn("reason", F.when(F.col("features") > F.lit(limit).cast("long"), "too many features"))
