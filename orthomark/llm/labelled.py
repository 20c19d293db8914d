"""Labels beside whole texts without moving the texts, where the labels are few enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most label rows (an id and a mark, about 100 bytes each once broadcast) that are sent to every
#: executor; more labels meet the texts in a sort-merge join, which shuffles both.
MOST_BROADCAST = 1_000_000


def with_marks(rows: DataFrame, marks: DataFrame, key: str | list[str], most: int = MOST_BROADCAST) -> DataFrame:
    """``rows`` left-joined with ``marks`` (one row per key or keys)."""
    few = marks.limit(most + 1).count() <= most
    return rows.join(F.broadcast(marks) if few else marks.hint("merge"), key, "left")
