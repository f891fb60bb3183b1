"""Lines of a page whose extent depends on the line so far (L-08, W-08): one pass over the sorted blocks of many pages at once.

A page is a row with arrays; numpy takes the next block of every page of an Arrow batch together. The result
holds the place (from 0) of each line's first block, so that lines are slices of the page's array.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

PLACES = T.ArrayType(T.IntegerType())


def _numbers(arrays: pa.Array) -> np.ndarray:
    """Nulls become NaN, which is near nothing."""
    return arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _starts(first: pa.Array, columns: list[np.ndarray], joins: Callable, merged: Callable) -> pa.Array:
    """Place of each line's first block by page. ``joins(state, block)`` tells which blocks continue; ``merged(state, block, joined)`` is the next state."""
    size = pc.fill_null(pc.list_value_length(first), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    base = ends - size
    order = np.argsort(-size, kind="stable")  # longest first: pages that still have blocks come first
    falling = -size[order]
    begins = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    state = None
    for r in range(int(-falling[0]) if len(falling) else 0):
        live = int(np.searchsorted(falling, -r, "left"))
        at = base[order[:live]] + r
        block = [c[at] for c in columns]
        if state is None:
            joined = np.zeros(live, bool)
            state = merged(None, block, joined)
        else:
            state = [s[:live] for s in state]
            joined = joins(state, block)
            state = merged(state, block, joined)
        begins[at] = ~joined
    page = np.repeat(np.arange(len(size)), size)[begins]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(page, minlength=len(size)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array((np.flatnonzero(begins) - base[page]).astype(np.int32)))


def extent_starts(pages: pa.Array, cy: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> pa.Array:
    """A block joins the running line if it overlaps it by over 30 % of its height, or its centre is near the line's mean centre; ``pages`` are lists as long as the pages."""

    def joins(s, b):
        high = np.maximum(np.maximum(s[3] - s[2], b[2] - b[1]), 10.0)
        overlap = np.minimum(s[3], b[2]) - np.maximum(s[2], b[1])
        return (overlap > 0.3 * high) | (np.abs(b[0] - s[0] / s[1]) <= np.maximum(14.0, high * 0.65))

    def merged(s, b, j):
        if s is None:
            return [b[0].copy(), np.ones(len(j)), b[1], b[2]]
        return [np.where(j, s[0], 0.0) + b[0], np.where(j, s[1], 0.0) + 1, np.where(j, np.minimum(s[2], b[1]), b[1]), np.where(j, np.maximum(s[3], b[2]), b[2])]

    return _starts(pages, [cy, top, bottom], joins, merged)


@arrow_udf(PLACES)
def extent_lines(cy: pa.Array, top: pa.Array, bottom: pa.Array) -> pa.Array:
    return extent_starts(cy, *map(_numbers, (cy, top, bottom)))


@arrow_udf(PLACES)
def mean_lines(cy: pa.Array, height: pa.Array) -> pa.Array:
    """A block joins the running line while its centre is near the mean of the line's centres."""

    def joins(s, b):
        return np.abs(b[0] - s[0] / s[1]) <= np.fmax(8.0, b[1] * 0.6)

    def merged(s, b, j):
        if s is None:
            return [b[0].copy(), np.ones(len(j))]
        return [np.where(j, s[0], 0.0) + b[0], np.where(j, s[1], 0.0) + 1]

    return _starts(cy, [_numbers(c) for c in (cy, height)], joins, merged)


def segments(values: Column, starts: Column) -> Column:
    """The slices of an array that begin at the given places."""
    return F.transform(starts, lambda s, i: F.slice(values, s + 1, F.coalesce(F.get(starts, i + 1), F.size(values)) - s))
