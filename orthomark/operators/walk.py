"""Many small groups in one Python pass.

``applyInPandas`` pays a fixed price per group. Sorting a partition by the group keys and
walking over it handles thousands of small groups per batch, with no more in memory than a
batch and the group that continues into the next one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame

from orthomark.session import spread


def arranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Groups whole in partitions, side by side and in order."""
    return spread(df, *keys).sortWithinPartitions(*keys, *order)


def starts_of(frame: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """First position of every group in an arranged frame, and its length at the end."""
    changed = np.zeros(len(frame), bool)
    for key in keys:
        column = frame[key].to_numpy()
        changed[1:] |= column[1:] != column[:-1]
    changed[:1] = True
    return np.append(np.flatnonzero(changed), len(frame))


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of complete groups with their start positions."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        # Batches inside one long group are only collected, not scanned again.
        if held and len(starts_of(batch, keys)) == 2 and (held[-1][list(keys)].iloc[-1].tolist() == batch[list(keys)].iloc[0].tolist()):
            held.append(batch)
            continue
        frame = pd.concat([*held, batch], ignore_index=True) if held else batch.reset_index(drop=True)
        starts = starts_of(frame, keys)
        if len(starts) > 2:
            yield frame.iloc[:starts[-2]], starts[:-1]
        held = [frame.iloc[starts[-2]:].reset_index(drop=True)]
    if held:
        frame = pd.concat(held, ignore_index=True)
        yield frame, starts_of(frame, keys)
