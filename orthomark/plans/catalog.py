"""All registered queries."""

from orthomark.plans import queries_geo, queries_io, queries_joins, queries_ml, queries_raster, queries_text  # noqa: F401
from orthomark.plans.registry import ORACLES, QUERIES  # noqa: F401
