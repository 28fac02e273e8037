"""Words of whole batches as 64-bit hashes, without strings.

A word is a run of letters or decimal digits, in the consistent form of `unify` and lower case."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .unify import SIZE, tables, to_points, unify_points

#: Code points that are worked on at once; one longer text is still processed whole.
SLICE_POINTS = 1_500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = np.atleast_1d(np.asarray(x).astype(np.uint64))  # arrays wrap around without a warning
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CHARS: list[np.ndarray] = []


def _char_hash() -> np.ndarray:
    if not _CHARS:
        _CHARS.append(mix(np.arange(1, SIZE + 1).astype(np.uint64) * _ODD))
    return _CHARS[0]


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(6364136223846793005)
        out = np.cumprod(out, dtype=np.uint64)
    return out


def _spans(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of runs of code points that are given one after the other."""
    within = np.arange(len(values)) - np.repeat(first, size)
    return mix(np.add.reduceat(_char_hash()[values] * _powers(int(size.max()))[within], first) + size.astype(np.uint64))


def word_hashes(points: np.ndarray, offsets: np.ndarray, blanks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and the number of each row's first word (rows + 1). With
    `blanks` a word is a run of anything but white space."""
    t = tables()
    points, offsets, _ = unify_points(points, offsets)
    low = np.minimum(points, SIZE - 1)
    is_word = ~t.space[low] if blanks else t.word[low]
    edge = np.zeros(len(points) + 1, bool)
    edge[offsets] = True
    start = is_word.copy()
    start[1:] &= ~is_word[:-1] | edge[1:-1]
    at = np.flatnonzero(is_word)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = np.flatnonzero(start[at])
    hashes = _spans(t.lower[low[at]], first, np.diff(np.append(first, len(at)))).view(np.int64)
    return hashes, np.searchsorted(at[first], offsets)


def value_hashes(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One hash for each row as it is, without folding or splitting; 0 for an empty one."""
    size = np.diff(offsets)
    full = size > 0
    out = np.zeros(len(size), np.int64)
    if full.any():
        out[full] = _spans(np.minimum(points, SIZE - 1), offsets[:-1][full], size[full]).view(np.int64)
    return out


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE_POINTS bytes of text."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    part = np.cumsum(sizes) // SLICE_POINTS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def hashes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(*to_points(texts))
