"""Word hashes of whole Arrow text columns with numpy: no Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_ROOT = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_ROOT), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD1342543DE82EF95))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
#: White space that ends a word: blank and the control characters 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the hash's base and of its inverse, kept per process."""
    if len(_powers[0]) <= n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((_ROOT, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, one after the other, and the offsets of the texts in them. Nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and the offsets of the texts in the list of words."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~SPACE[raw]
    step = np.diff(inside)
    starts, ends = step[:-1] == 1, step[1:] == -1
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    starts[edges] |= inside[1:-1][edges] == 1
    ends[edges - 1] |= inside[1:-1][edges - 1] == 1
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word; with ``lower``, A-Z count as a-z."""
    up, down = powers(len(raw))
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER if lower else _BYTES)[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def windows(words: np.ndarray, edges: np.ndarray, n: int, short: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside one text, and the text of each run.

    ``words`` are word hashes, ``edges`` the offsets of the texts in them. With ``short`` a text of fewer words, but not none,
    has one run of all its words.
    """
    counts = np.diff(edges)
    up, down = powers(len(words))
    sums = np.empty(len(words) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(mix(words + U(seed)) * up[: len(words)], out=sums[1:])
    runs = np.maximum(counts - n + 1, 0)
    lengths = np.full(len(counts), n)
    if short:
        few = (counts > 0) & (counts < n)
        runs[few] = 1
        lengths[few] = counts[few]
    owner = np.repeat(np.arange(len(counts)), runs)
    first = np.repeat(edges[:-1] - (np.cumsum(runs) - runs), runs) + np.arange(len(owner))
    return mix((sums[first + lengths[owner]] - sums[first]) * down[first] + lengths[owner].astype(np.uint64)), owner
