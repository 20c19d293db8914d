"""Columns of the caller that have the names of an operator's results."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASIDE = "_set_aside"


def set_aside(docs: DataFrame, names: Collection[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``docs`` as ``work`` leaves them: those that have one of ``names``, which the operator
    writes itself, wait in a struct and come back with their own values and types."""
    clashing = [c for c in docs.columns if c in names]
    quoted = lambda c: F.col(f"`{c}`")
    if not clashing:
        return work(docs).select(*[quoted(c) for c in docs.columns])
    waiting = docs.select(*[quoted(c) for c in docs.columns if c not in clashing], F.struct(*[quoted(c) for c in clashing]).alias(ASIDE))
    found = work(waiting)
    return found.select(*[F.col(ASIDE)[c].alias(c) if c in clashing else quoted(c) for c in docs.columns])
