"""Box-overlap join as an equi-join on grid cells.

Both sides are expanded to the cells their boxes touch and joined on (group, cell). A pair
that meets in several cells is kept only in the cell holding the larger of the two lower-left
corners, so no ``distinct`` is needed. Boxes much larger than a cell live on coarser levels;
every box also appears (in at most four cells) on the coarser levels, and a pair is formed on
the level of its larger member. Dense cells are split by AQE's skew handling or by ``salt``.

With ``anchored`` a left box goes to every other cell only, one for a box no longer than a cell, and a
right box to one more at its lower left; a pair is kept where the left cell is that of the corner or the
one before it. This moves a large left side once. Boxes that end before they begin meet nothing then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")
LEVEL_FACTOR = 8
OWN_SPAN = 4


def levels_needed(cell: float, *sides: DataFrame) -> int:
    """Grid levels for the largest box of the inputs: one single-row aggregate per side."""
    longest = 0.0
    for side in sides:
        row = side.agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).cast("double").alias("m")).first()
        longest = max(longest, row["m"] or 0.0)
    levels, reach = 1, OWN_SPAN * cell
    while longest > reach and levels < 12:
        levels, reach = levels + 1, reach * LEVEL_FACTOR
    return levels


def _cells(df: DataFrame, cell: float, levels: int, anchored: str | None = None) -> DataFrame:
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    if levels == 1:
        df = df.withColumn("_size", F.lit(float(cell)))
    else:
        own = F.lit(levels - 1)
        for level in range(levels - 2, -1, -1):
            own = F.when(side <= OWN_SPAN * cell * LEVEL_FACTOR**level, level).otherwise(own)
        df = (df.withColumn("_first", own)
              .withColumn("_level", F.explode(F.sequence(F.col("_first"), F.lit(levels - 1))))
              .withColumn("_own", F.col("_level") == F.col("_first")).drop("_first")
              .withColumn("_size", F.lit(float(cell)) * F.pow(F.lit(float(LEVEL_FACTOR)), F.col("_level").cast("double"))))

    def index(name):
        return F.floor(F.col(name) / F.col("_size")).cast("long")

    if anchored is None:
        return (df.withColumn("_cx", F.explode(F.sequence(index("x0"), index("x1"))))
                .withColumn("_cy", F.explode(F.sequence(index("y0"), index("y1")))))
    before, step = (0, 2) if anchored == "left" else (1, 1)
    over = lambda low, high: F.explode(F.sequence(index(low) - before, index(high), F.lit(step).cast("long")))
    return df.filter("x0 <= x1 AND y0 <= y1").withColumn("_cx", over("x0", "x1")).withColumn("_cy", over("y0", "y1"))


def overlapping_pairs(left: DataFrame, right: DataFrame, group: Sequence[str] = ("scene_id",), cell: float = 64,
                      levels: int | None = None, salt: int = 1, condition: Column | None = None, anchored: bool = False) -> DataFrame:
    """Pairs of boxes of one group that touch or overlap.

    Both sides need the group columns and x0, y0, x1, y1. The left side keeps its names; the
    right side's columns come out with the prefix ``r_``. ``condition`` (over those names) is
    applied inside the join. ``levels=None`` looks at the largest box first; any value gives
    the same rows, it only changes how many cells large boxes are expanded to, as does ``anchored``, for a
    left side of many or wide rows.
    """
    if levels is None:
        levels = levels_needed(cell, left, right)
    a = _cells(left, cell, levels, "left" if anchored else None)
    b = _cells(right, cell, levels, "right" if anchored else None)
    if salt > 1:
        a = a.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salt)).cast("int"))
        b = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    b = b.select(*[F.col(c).alias("r_" + c) for c in b.columns])
    keys = [*group, "_cx", "_cy"] + (["_level"] if levels > 1 else []) + (["_salt"] if salt > 1 else [])
    on = [F.col(k) == F.col("r_" + k) for k in keys]
    reach = 1 if anchored else 0
    meet = ((F.col("x0") <= F.col("r_x1")) & (F.col("r_x0") <= F.col("x1"))
            & (F.col("y0") <= F.col("r_y1")) & (F.col("r_y0") <= F.col("y1"))
            & (F.floor(F.greatest("x0", "r_x0") / F.col("_size")) - F.col("_cx")).between(0, reach)
            & (F.floor(F.greatest("y0", "r_y0") / F.col("_size")) - F.col("_cy")).between(0, reach))
    if levels > 1:
        meet = meet & (F.col("_own") | F.col("r__own"))
    if condition is not None:
        meet = meet & condition
    for clause in on:
        meet = clause & meet
    # Sizes before the expansion to cells mislead the planner into broadcasting a large side;
    # a sort-merge join spills and has its hot partitions split.
    joined = a.hint("merge").join(b, meet)
    return joined.drop(*[c for c in joined.columns if c.startswith(("_", "r__"))], *["r_" + g for g in group])


def box_overlap() -> Column:
    """Overlap area of the two boxes of a pair."""
    width = F.least("x1", "r_x1") - F.greatest("x0", "r_x0")
    height = F.least("y1", "r_y1") - F.greatest("y0", "r_y0")
    return (F.greatest(width, F.lit(0)) * F.greatest(height, F.lit(0))).cast("double")


def box_area(prefix: str = "") -> Column:
    c = lambda n: F.col(prefix + n)
    return ((c("x1") - c("x0")) * (c("y1") - c("y0"))).cast("double")


def box_iou() -> Column:
    shared = box_overlap()
    union = box_area() + box_area("r_") - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def overlap_over_smaller() -> Column:
    smaller = F.least(box_area(), box_area("r_"))
    return F.when(smaller > 0, box_overlap() / smaller).otherwise(F.lit(0.0))


def with_corners(df: DataFrame) -> DataFrame:
    """x0, y0, w, h -> x0, y0, x1, y1."""
    return (df.withColumn("x1", F.col("x0") + F.col("w")).withColumn("y1", F.col("y0") + F.col("h")).drop("w", "h"))
