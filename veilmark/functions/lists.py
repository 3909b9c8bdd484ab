"""Arrow lists in slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: So many elements of a batch are worked on at once: memory beyond the batch itself does not grow with it.
WORDS = 500_000


def slices(lists: pa.ListArray, most: int = WORDS) -> Iterator[pa.ListArray]:
    """Consecutive slices of a list array with about ``most`` elements each; a longer list is a slice of its own."""
    ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy())
    a, before = 0, 0
    while a < len(lists):
        b = min(max(int(np.searchsorted(ends, before + most, side="right")), a + 1), len(lists))
        yield lists.slice(a, b - a)
        a, before = b, int(ends[b - 1])
