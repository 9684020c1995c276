"""Texts of an Arrow batch a slice at a time: what a function makes of a batch may be many times its size."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa

#: Characters of a slice, of which one text may be more.
SLICE = 1 << 20


def slices(frame: pd.Series | pd.DataFrame, lengths: pd.Series, most: int = SLICE) -> Iterator[pd.Series | pd.DataFrame]:
    """``frame`` in parts, in order, whose ``lengths`` sum up to ``most`` and one text more at most."""
    place = (lengths.fillna(0).cumsum() // most).to_numpy()
    begin = 0
    for end in [*(k for k in range(1, len(place)) if place[k] != place[k - 1]), len(place)]:
        if end > begin or not len(place):
            yield frame.iloc[begin:end]
        begin = end


def freed() -> None:
    """A worker outlives its task: what the task has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)
