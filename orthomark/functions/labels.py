"""Names, addresses and labels of features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts attached to results.
UNMATCHED = "unmatched"
CANDIDATES = "spatial candidates; identity unverified"
MAPPED = "mapped feature"
SEARCH_CANDIDATE = "search candidate; select to inspect"
CONTAINS_SELECTED = "contains selected address/place point"
OVERLAPPING = "overlapping polygon"
CONTAINED_POINT = "contained point; may be a tenant or entrance"
PARTIAL_COVERAGE = "Some selected pixels have no imagery; detections exclude those pixels."
CHANGE_NOTE = ("Candidate changes. Review image alignment, seasons and detection errors "
               "before assigning a cause.")
FALLBACK_LABEL = "Mapped feature"
# Address parts in order, of map tags and of geocoder records.
TAG_ADDRESS_PARTS = ("addr:housenumber", "addr:street", "addr:postcode", "addr:city", "addr:country")
PLACE_ADDRESS_PARTS = ("housenumber", "street", "postcode", "city", "state", "country")


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def filled(value) -> Column:
    """The text, with an empty one counted as missing."""
    return F.nullif(_c(value).cast("string"), F.lit(""))


def stripped(text) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def joined(parts) -> Column:
    return F.nullif(F.concat_ws(", ", *[filled(p) for p in parts]), F.lit(""))


def address_from_tags(tags) -> Column:
    t = _c(tags)
    return F.coalesce(filled(t["addr:full"]), joined([t[k] for k in TAG_ADDRESS_PARTS]))


def address_from_place(columns: dict[str, Column]) -> Column:
    """``columns`` maps part names to columns; parts the data lacks may be left out."""
    return joined([columns[p] for p in PLACE_ADDRESS_PARTS if p in columns])


def display_label(columns: dict[str, Column]) -> Column:
    """What a reviewer sees: the reviewed label first, candidates marked as such."""
    def part(name):
        return filled(columns[name]) if name in columns else F.lit(None).cast("string")

    return F.coalesce(
        part("reviewed_label"), part("name"), part("address"),
        F.concat(part("candidate_name"), F.lit(" (candidate)")),
        F.concat(part("candidate_address"), F.lit(" (candidate)")),
        part("label"), part("visual_class"), part("change"), F.lit(FALLBACK_LABEL))


def capitalised(text) -> Column:
    t = _c(text)
    return F.concat(F.upper(F.substr(t, F.lit(1), F.lit(1))), F.lower(F.substr(t, F.lit(2))))


def default_label(concept, number) -> Column:
    return F.concat(capitalised(concept), F.lit(" "), _c(number).cast("string"))


def request_key(url, params=None, data=None) -> Column:
    """SHA-256 of the canonical JSON of a request; maps are ordered by key."""
    def ordered(m):
        if m is None:
            return F.lit("null")
        entries = F.array_sort(F.map_entries(_c(m)))
        pairs = F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"])))
        return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))

    def quoted(text):
        escaped = F.replace(F.replace(_c(text), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.concat(F.lit('"'), escaped, F.lit('"'))

    return F.sha2(F.concat(F.lit("["), quoted(url), F.lit(", "), ordered(params), F.lit(", "), ordered(data), F.lit("]")), 256)


def concept_list(prompt) -> Column:
    """Trimmed, non-empty, distinct concepts in the order given."""
    parts = F.transform(F.split(_c(prompt), ","), lambda part: stripped(part))
    return F.array_distinct(F.filter(parts, lambda c: c != ""))


def concept_reason(prompt) -> Column:
    """NULL for one to four concepts within 200 characters."""
    concepts = concept_list(prompt)
    return (F.when(F.size(concepts) < 1, "no concept").when(F.size(concepts) > 4, "too many concepts")
            .when(F.length(_c(prompt)) > 200, "prompt too long"))


# Fixed value: goes with every matched detection.
LABEL_NOTE = "Names/addresses come from map evidence, not SAM; review spatial matches."


def match_status(evidence_count) -> Column:
    return F.when(_c(evidence_count) > 0, CANDIDATES).otherwise(UNMATCHED)


def coverage_warning(fraction) -> Column:
    return F.when(_c(fraction) < F.lit(1.0), PARTIAL_COVERAGE)
