"""Free-text map requests as one expression per field: ordered rules, first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomark.functions import geo
from orthomark.functions.labels import stripped

# Patterns of the request grammar, matched on lower-cased text unless noted.
GEOHASH_PREFIX = r"^(?:geohash|hash)\s*[:= ]"
GEOHASH_STRIP = r"^\w+\s*[:= ]\s*"
COORDINATES = r"^\s*-?\d+(?:\.\d+)?\s*,\s*-?\d+(?:\.\d+)?\s*$"
MISSING_ADDRESS = r"\b(without|missing|no)\s+(?:a |an |mapped )?addresses?\b"
ENRICH_VERB = r"\b(label|enrich|attach|match)\b"
ENRICH_OBJECT = r"\b(addresses|names)\b"
COMPARE = r"\b(compare|change|changes|past|before|after|transition)\b"
ROUTE = r"\b(from .+ to|directions|navigate)\b"
VISUAL = r"\b(sam|segment|satellite|imagery|aerial|outline|detect)\b"
HOUSE_NUMBER = r"\b\d+[a-z]?\b"
TAG = r"\b([a-zA-Z_:]+=[a-zA-Z0-9_:;-]+)\b"
AREA = r"(?i)\b(?:in|near|around)\s+(.+?)[?.!]*$"
HERE = r"(?i)^(?:(?:this|the|current)\s+(?:area|map|view)|here)$"
HERE_VISUAL = r"(?i)^(?:(?:(?:this|the|current|selected)\s+)?(?:area|map|view|box)|here)$"
CONCEPT_VERB = r"(?i)^(?:please\s+)?(?:segment|detect|outline)\s+"
ADDRESS_VERB = r"(?i)^(?:ok[, ]+)?(?:where\s+is|find|locate|show(?:\s+me)?|mark)\s+"
ADDRESS_NUMBER = r"(?i)^(?:the\s+)?house\s+numbers?\s+"
CATEGORIES = {
    "hospitals": r"hospitals?|hospilarts|hospitals", "schools": r"schools?",
    "hiking": r"hiking|hike|walking routes?", "buildings": r"buildings?|buldings?",
    "parks": r"parks?", "water": r"water|rivers?|lakes?", "roads": r"roads?|streets?",
    "trees": r"trees?|forests?", "restaurants": r"restaurants?", "shops": r"shops?|stores?",
    "all": r"all (?:map )?(?:features|elements)",
}
CONCEPT_OF_CATEGORY = {"buildings": "building", "trees": "tree", "water": "water", "roads": "road"}
SITE_CATEGORIES = ("hospitals", "schools", "restaurants", "shops", "parks")
INTENTS = ("address", "features", "coordinates", "geohash", "compare", "route", "segment", "enrich", "filter")
SOURCES = ("auto", "maps", "imagery", "combined")
RESULT_FILTERS = ("all", "missing_address", "has_address")
MAX_QUERY, MAX_PROMPT, MIN_RADIUS, MAX_RADIUS = 1000, 200, 50, 2000

# Word characters, blanks and digits of any script; only a line feed ends a line.
FLAGS = "(?Ud)"

PLAN_TYPE = ("intent string, query string, category string, area string, tag string, explanation string, "
             "source string, prompt string, radius_m double, filter string")


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _extract(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, FLAGS + pattern, 1), F.lit(""))


def _mentions(lower: Column, pattern: str) -> Column:
    return lower.rlike(rf"{FLAGS}\b(?:{pattern})\b")


def category_of(text) -> Column:
    """The first category mentioned, in declaration order; known misspellings count."""
    return _category(F.lower(_c(text)))


def _category(lower: Column) -> Column:
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in CATEGORIES.items():
        found = found.when(_mentions(lower, pattern), name)
    return found


def area_of(text, visual: bool = False) -> Column:
    """The place after in/near/around; NULL for "this area", "here" and the like."""
    area = F.nullif(stripped(F.regexp_extract(_c(text), FLAGS + AREA, 1)), F.lit(""))
    return F.when(~area.rlike(FLAGS + (HERE_VISUAL if visual else HERE)), area)


def concept_of(text) -> Column:
    """Visual concepts: the known ones mentioned, else the text without verb and place."""
    query = _c(text)
    lower = F.lower(query)
    known = F.concat_ws(", ", *[F.when(_mentions(lower, CATEGORIES[c]), s) for c, s in CONCEPT_OF_CATEGORY.items()])
    concept = F.coalesce(F.nullif(known, F.lit("")), F.regexp_replace(query, FLAGS + CONCEPT_VERB, ""))
    for word in (" in ", " near ", " around "):
        concept = F.when(query.rlike(FLAGS + AREA), F.substring_index(concept, word, 1)).otherwise(concept)
    return concept


def address_of(text) -> Column:
    address = F.regexp_replace(F.regexp_replace(_c(text), FLAGS + ADDRESS_VERB, ""), FLAGS + ADDRESS_NUMBER, "")
    return F.regexp_replace(address, r"^[ ?!]+|[ ?!]+$", "")


def request_reason(text) -> Column:
    query = stripped(text)
    return F.when(query.isNull() | (query == ""), "empty query").when(F.length(query) > MAX_QUERY, "query too long")


def _rule(query: Column, lower: Column, category: Column, tag: Column) -> Column:
    """Which rule of the grammar applies: the first that matches."""
    visual = lower.rlike(FLAGS + VISUAL)
    site = F.coalesce(category.isin(*SITE_CATEGORIES), F.lit(False))
    mapped = (category.isNotNull() | tag.isNotNull()) & ~lower.rlike(FLAGS + HOUSE_NUMBER)
    return (F.when(lower.rlike(FLAGS + GEOHASH_PREFIX), "geohash").when(query.rlike(FLAGS + COORDINATES), "coordinates")
            .when(lower.rlike(FLAGS + MISSING_ADDRESS), "filter").when(lower.rlike(FLAGS + ENRICH_VERB) & lower.rlike(FLAGS + ENRICH_OBJECT), "enrich")
            .when(lower.rlike(FLAGS + COMPARE), "compare").when(lower.rlike(FLAGS + ROUTE), "route")
            .when(visual & site, "site").when(visual, "segment").when(mapped, "features").otherwise("address"))


def with_plan(df: DataFrame, text: str = "text", name: str = "plan") -> DataFrame:
    """``df`` with the plan struct of its requests; NULL only when the text is empty (``request_reason`` marks
    long ones). What several fields need is computed once, in steps that stay in generated code."""
    query = df.withColumn("_q", stripped(F.col(text))).withColumn("_l", F.lower("_q"))
    seen = query.withColumn("_c", _category(F.col("_l"))).withColumn("_t", _extract(F.col("_q"), TAG))
    ruled = seen.withColumn("_r", _rule(F.col("_q"), F.col("_l"), F.col("_c"), F.col("_t")))
    plan = F.when(F.col("_q") != "", _plan(*[F.col(c) for c in ("_r", "_q", "_c", "_t")]))
    return ruled.withColumn(name, plan).drop("_q", "_l", "_c", "_t", "_r")


def parse_request(text) -> Column:
    """The plan of ``with_plan`` as one expression."""
    def planned(s):
        category, tag = _category(F.lower(s["query"])), _extract(s["query"], TAG)
        rule = _rule(s["query"], F.lower(s["query"]), category, tag)
        return geo.let(F.struct(rule.alias("r"), s["query"].alias("q"), category.alias("c"), tag.alias("t")), lambda v: _plan(v["r"], v["q"], v["c"], v["t"]))

    query = stripped(_c(text))
    return F.when(query != "", geo.let(F.struct(query.alias("query")), planned))


def _plan(rule: Column, query: Column, category: Column, tag: Column) -> Column:
    null = F.lit(None).cast("string")
    text = (F.when(rule == "geohash", F.regexp_replace(F.lower(query), FLAGS + GEOHASH_STRIP, ""))
            .when(rule == "address", address_of(query)).otherwise(query))
    return F.struct(
        F.when(rule == "site", "features").otherwise(rule).alias("intent"), text.alias("query"),
        F.when(rule == "site", category).when(rule == "features", F.coalesce(category, F.lit("all"))).otherwise(null).alias("category"),
        F.when(rule.isin("site", "segment"), area_of(query, True)).when(rule == "features", area_of(query)).otherwise(null).alias("area"),
        F.when(rule == "features", tag).otherwise(null).alias("tag"),
        F.when(rule == "coordinates", "Input order is latitude, longitude.").otherwise("").alias("explanation"),
        F.when(rule == "site", "combined").when(rule == "segment", "imagery").otherwise("auto").alias("source"),
        F.when(rule == "site", "building").when(rule == "segment", concept_of(query)).otherwise(null).alias("prompt"),
        F.lit(None).cast("double").alias("radius_m"),
        F.when(rule == "filter", "missing_address").otherwise("all").alias("filter"))


def parse_coordinates(text) -> Column:
    """Struct lon, lat, geohash of "lat, lon"; NULL when the text is no usable pair."""
    parts = F.split(F.when(_c(text).rlike(FLAGS + COORDINATES), _c(text)), ",")
    lat, lon = parts[0].try_cast("double"), parts[1].try_cast("double")
    usable = geo.bounds_around(lon, lat).isNotNull()
    return F.when(usable, F.struct(lon.alias("lon"), lat.alias("lat"), geo.geohash_encode(lat, lon).alias("geohash")))


def route_request(plan, source_mode) -> Column:
    """The plan after the source override, with the kind of answer it leads to."""
    p, mode = _c(plan), _c(source_mode)
    return geo.let(F.struct(p.alias("p"), mode.alias("mode")), lambda s: geo.let(_routed(s["p"], s["mode"]), _with_kind))


def _lookup(key: Column, values: dict[str, str], default: str | None = None) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in values.items():
        out = out.when(key == k, v)
    return out.otherwise(default) if default else out


def _routed(p: Column, mode: Column) -> Column:
    source = F.when(mode != "auto", mode).otherwise(p["source"])
    to_features = (mode == "maps") & (p["intent"] == "segment")
    category = F.when(to_features, F.coalesce(p["category"], _lookup(
        p["prompt"], {s: c for c, s in CONCEPT_OF_CATEGORY.items()}, "buildings"))).otherwise(p["category"])
    intent = F.when(to_features, "features").otherwise(p["intent"])
    to_segment = (source.isin("imagery", "combined") & (intent == "features")
                  & F.coalesce(category.isin(*CONCEPT_OF_CATEGORY), F.lit(False)))
    return F.struct(F.when(to_segment, "segment").otherwise(intent).alias("intent"), p["query"].alias("query"), category.alias("category"),
                    p["area"].alias("area"), p["tag"].alias("tag"), source.alias("source"),
                    F.when(to_segment, F.coalesce(p["prompt"], _lookup(category, CONCEPT_OF_CATEGORY))).otherwise(p["prompt"]).alias("prompt"),
                    p["filter"].alias("filter"))


def _with_kind(p: Column) -> Column:
    intent, placed = p["intent"], p["area"].isNotNull()
    kind = (F.when(intent.isin("enrich", "filter", "compare", "route"), intent)
            .when(intent == "segment", F.when(placed, "segment_candidates").otherwise("segment"))
            .when(intent == "address", "candidates")
            .when(intent == "features", F.when(placed, "area_candidates").otherwise("features"))
            .otherwise("features"))
    names = ("intent", "query", "category", "area", "tag", "source", "prompt", "filter")
    return F.struct(*[p[n].alias(n) for n in names], kind.alias("kind"))


def plan_reason(plan) -> Column:
    """NULL for a structured plan that keeps to the enumerations and ranges."""
    p = _c(plan)
    source, result_filter = F.coalesce(p["source"], F.lit("auto")), F.coalesce(p["filter"], F.lit("all"))
    return (F.when(p.isNull() | p["intent"].isNull() | p["query"].isNull(), "unreadable plan")
            .when(~p["intent"].isin(*INTENTS), "unknown intent").when(F.length(p["query"]) > MAX_QUERY, "query too long")
            .when(~source.isin(*SOURCES), "unknown source").when(F.length(p["prompt"]) > MAX_PROMPT, "prompt too long")
            .when(~p["radius_m"].between(MIN_RADIUS, MAX_RADIUS), "radius out of range")
            .when(~result_filter.isin(*RESULT_FILTERS), "unknown filter"))


def validate_plans(df, json_column: str = "plan_json"):
    """Plans produced elsewhere, parsed and marked with a reason; split on ``reason IS NULL``."""
    parsed = df.withColumn("plan", F.from_json(json_column, PLAN_TYPE, {"mode": "PERMISSIVE"}))
    return parsed.withColumn("reason", plan_reason("plan"))
