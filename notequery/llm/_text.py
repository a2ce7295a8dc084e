"""Vectorised helpers that operator tasks share: words, hashes and minimisers.

Everything here works on one Arrow batch inside a Spark task.  A batch is cut
into slices of about ``SLICE`` bytes (a longer text is one slice of its own), so
that the numpy temporaries of a task stay bounded whatever the batch holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

#: Bytes that belong to a word.  SPACED: all but space and \t \n \v \f \r.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: ALNUM: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n at least."""
    if len(_powers[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2**64 over bytes or 64-bit values."""
    n = len(values)
    out = np.zeros(n + 1, dtype=np.uint64)
    terms = _BYTE[values] if values.dtype == np.uint8 else mix(values)
    terms *= _power(n)[0][:n]
    np.cumsum(terms, out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) whose prefix sums are given."""
    x = sums[end] - sums[start]
    x *= _power(len(sums))[1][start]
    return mix(x)


def grams(sums: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive values."""
    n = len(sums) - 1
    if n < k:
        return np.empty(0, dtype=np.uint64)
    x = sums[k:] - sums[:-k]
    x *= _power(len(sums))[1][: n - k + 1]
    return mix(x)


def slices(column, limit: int = SLICE):
    """Yield (first row, last row + 1, bytes, offsets) of runs of rows of text or bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("", column.type))
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of words before it (one more than rows)."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1 : n + 1] = table[data]
    begins = inside[1 : n + 1] & ~inside[:n]
    finishes = inside[: n + 1] & ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    begins[cuts] = inside[cuts + 1]
    finishes[cuts] = inside[cuts]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes)
    return starts, ends, np.searchsorted(starts, offsets)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    n = len(values)
    if n < width:
        return np.empty(0, dtype=values.dtype)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of range(start, start + count)."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - first, counts)


def chunks(sums: np.ndarray, bounds: np.ndarray, length: int, k: int, seed: int = 0):
    """Cut the windows of `length` units of each row into runs by the place of the least hash of their k-grams.

    Each seed orders the k-grams anew.

    `bounds` holds the first unit of each row (one more than rows).  Of ties the last place counts, so that equal
    windows, wherever they stand and however often within one row, have equal least hashes at different places
    and fall into different runs with the same key.  Returns the row, key, content hash, first window within the
    row and number of windows of each run.
    """
    own = grams(sums, k)
    if seed:
        own = mix(own ^ np.uint64(seed * _BASE & (2**64 - 1)))
    low = np.uint64((1 << max(1, len(own).bit_length())) - 1)
    ranked = (own & ~low) | (low - np.arange(len(own), dtype=np.uint64))
    least = sliding_min(ranked, length - k + 1)
    counts = np.maximum(np.diff(bounds) - length + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    if not len(rows):
        e = np.empty(0, dtype=np.int64)
        return e, e.astype(np.uint64), e.astype(np.uint64), e, e
    at = ranges(bounds[:-1], counts)
    place = low - (least[at] & low)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    start = at[first]
    return rows[first], own[place[first]], span(sums, start, start + n + length - 1), start - bounds[rows[first]], n


def spans(column, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of all spans of an Arrow column of lists of (start, end); null counts as none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten()
    return np.repeat(np.arange(rows), counts), *(pc.struct_field(values, i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))


def covered(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of `size` units the spans [start, end) cover."""
    steps = np.bincount(start, minlength=size + 1) - np.bincount(end, minlength=size + 1)
    return np.cumsum(steps[:size]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of set flags."""
    edges = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
