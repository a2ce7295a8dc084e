"""Suffix-array dedup.

Candidate text is dealt to bins in which equal windows meet (see ``_repeats``).  Within a bin it lies in plain
shards of ``SHARD`` bytes, each with a suffix array by Larsson-Sadakane refinement in numpy: suffixes are sorted by
their first bytes and groups that still tie are refined by the ranks of the suffixes further on, until ties are
longer than a window.  Kasai's rule gives the common prefixes of neighbours, walked in many lanes at once.  Shards
are merged by binary search of each one's windows in the suffix arrays of the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notequery.llm import _repeats
from notequery.llm import _text as t

#: Bytes of a bin, of a shard within it, and of the k-grams that choose a window's bin.
BIN, SHARD, K = 1 << 20, 1 << 18, 24
_LANES = 4096


def heads(data: np.ndarray, pad: int) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; zeros beyond the end."""
    padded = np.zeros(len(data) + pad + 8, dtype=np.uint8)
    padded[: len(data)] = data
    n = len(data) + pad
    out = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        out |= padded[j : j + n].astype(np.uint64) << np.uint64(56 - 8 * j)
    return out


def suffix_array(data: np.ndarray, depth: int, eight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order of `depth` bytes at least, and for each neighbour pair the bytes known to be equal or, if tied, `depth`.

    Refinement: ranks by 8 bytes, then groups of ties sort by the ranks of the suffixes h and 2h further on
    (h only, where three ranks don't fit in 63 bits), so that h grows threefold.  Returns order, the common prefix
    that the rounds prove for each suffix and the one before it, and whether they tie to the end.
    """
    n = len(data)
    bits = n.bit_length() + 1
    fold = 3 if 3 * bits <= 63 else 2
    order = np.argsort(eight[:n]).astype(np.int64)
    head = eight[order]
    new = np.ones(n, dtype=bool)
    new[1:] = head[1:] != head[:-1]
    known = np.zeros(n, dtype=np.int32)
    rank = np.zeros(n + 2 * 9 * depth, dtype=np.int64)
    first = np.flatnonzero(new)
    rank[order] = np.repeat(first, np.diff(np.append(first, n))) + 1
    h = 8
    while h < depth:
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        at = order[slots]
        value = rank[at]
        for j in range(1, fold):
            value = (value << bits) | rank[at + j * h]
        sort = np.argsort(value)
        at, value = at[sort], value[sort]
        order[slots] = at
        fresh = np.ones(len(slots), dtype=bool)
        fresh[1:] = value[1:] != value[:-1]
        known[slots[fresh & ~new[slots]]] = h
        new[slots] = fresh
        begin = np.flatnonzero(fresh)
        rank[at] = np.repeat(slots[begin], np.diff(np.append(begin, len(slots)))) + 1
        h *= fold
    return order, known, ~new


def common_prefixes(order: np.ndarray, known: np.ndarray, tied: np.ndarray, eight: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, up to `depth`, by Kasai's rule.

    Going through the text from left to right, the prefix shared at a place is at least the one shared at the
    place before it, less one.  Places that the sort left open are cut into lanes that advance together.
    """
    out = np.where(tied, depth, np.minimum(known, depth - 1)).astype(np.int32)
    open_ = np.flatnonzero(~tied & (known * 3 >= depth))
    if not len(open_):
        return out
    place = order[open_]
    by_place = np.argsort(place)
    place, before, least = place[by_place], order[open_ - 1][by_place], known[open_][by_place]
    shared = np.zeros(len(place), dtype=np.int64)
    lanes = min(_LANES, len(place))
    cut = np.linspace(0, len(place), lanes + 1).astype(np.int64)
    at, size = cut[:-1].copy(), np.diff(cut)
    h, last = np.zeros(lanes, dtype=np.int64), np.full(lanes, -2, dtype=np.int64)
    for step in range(int(size.max())):
        lane = np.flatnonzero(size > step)
        k = at[lane] + step
        i, j = place[k], before[k]
        x = np.where(i == last[lane] + 1, np.maximum(h[lane] - 1, least[k]), least[k])
        todo = np.arange(len(lane))
        while len(todo):
            differ = eight[i[todo] + x[todo]] ^ eight[j[todo] + x[todo]]
            same = differ == 0
            ends = todo[~same]
            # The leading zero bytes of what differs are still shared.
            for bit in range(56, 0, -8):
                x[ends] += differ[~same] < np.uint64(1 << bit)
            todo = todo[same]
            x[todo] += 8
            todo = todo[x[todo] < depth]
        h[lane], last[lane] = np.minimum(x, depth), i
        shared[k] = h[lane]
    out[open_[by_place]] = shared
    return out


class _Shard:
    """Some variants of a bin with their suffix array."""

    def __init__(self, bodies: list[bytes], copies: np.ndarray, windows: np.ndarray, length: int):
        data = np.frombuffer(b"".join(bodies), dtype=np.uint8)
        size = np.array([len(b) for b in bodies])
        self.first, self.length = np.cumsum(size) - size, length
        self.weight = np.zeros(len(data), dtype=np.int64)
        self.weight[t.ranges(self.first, windows)] = np.repeat(copies, windows)
        self.eight = heads(data, 2 * length + 16)
        self.order, known, tied = suffix_array(data, length, self.eight)
        shared = common_prefixes(self.order, known, tied, self.eight, length)
        begin = np.flatnonzero(shared < length)  # suffixes that share a window's length stand together
        self.group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(data))))
        self.recurs = np.add.reduceat(self.weight[self.order], begin) > 1
        at = np.flatnonzero(self.weight[self.order] > 0)
        at = at[np.concatenate(([True], self.group[at[1:]] != self.group[at[:-1]]))] if len(at) else at
        #: One window of each group that has any, in order, the group, and the window's first bytes.
        self.places, self.groups = self.order[at], self.group[at]
        self.heads = self.eight[self.places] & self._mask(0)

    def _mask(self, j: int) -> np.uint64:
        """What counts of the eight bytes from place j of a window on."""
        return np.uint64((~0 << 8 * max(0, j + 8 - self.length)) & (2**64 - 1))

    def less(self, mine: np.ndarray, other: _Shard, its: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether windows of this shard sort before those of another, and whether they are equal."""
        below, equal = np.zeros(len(mine), dtype=bool), np.ones(len(mine), dtype=bool)
        todo = np.arange(len(mine))
        for j in range(0, self.length, 8):
            keep = self._mask(j)
            a, b = self.eight[mine[todo] + j] & keep, other.eight[its[todo] + j] & keep
            below[todo[a < b]] = True
            equal[todo[a != b]] = False
            todo = todo[a == b]
            if not len(todo):
                break
        return below, equal

    def merge(self, other: _Shard) -> None:
        """Find the other's windows in this shard's by binary search, first of their heads; what both hold recurs."""
        low, high = (np.searchsorted(self.heads, other.heads, side) for side in ("left", "right"))
        some = np.flatnonzero(low < high)
        low, high, last = low[some], high[some], high[some]
        while (go := np.flatnonzero(low < high)).size:
            middle = (low[go] + high[go]) // 2
            below, _ = self.less(self.places[middle], other, other.places[some[go]])
            low[go[below]] = middle[below] + 1
            high[go[~below]] = middle[~below]
        inside = np.flatnonzero(low < last)
        _, equal = self.less(self.places[low[inside]], other, other.places[some[inside]])
        hit = inside[equal]
        self.recurs[self.groups[low[hit]]] = True
        other.recurs[other.groups[some[hit]]] = True

    def spans(self) -> list[list[tuple[int, int]]]:
        flags = np.zeros(len(self.weight), dtype=bool)
        flags[self.order] = self.recurs[self.group]
        begin, end = t.runs(flags & (self.weight > 0))
        row = np.searchsorted(self.first, begin, side="right") - 1
        out: list[list[tuple[int, int]]] = [[] for _ in self.first]
        for r, a, b in zip(row.tolist(), (begin - self.first[row]).tolist(), (end - self.first[row] + self.length - 1).tolist(), strict=True):
            if out[r] and out[r][-1][1] >= a:
                a = out[r].pop()[0]
            out[r].append((a, b))
        return out


def judge(length: int, shard: int = SHARD):
    """Spans of bytes that recurring windows of `length` bytes cover, for the variants of one bin."""

    def run(bodies: list[bytes], copies: np.ndarray, windows: np.ndarray) -> list[list[tuple[int, int]]]:
        shards, low, size = [], 0, 0
        for i, body in enumerate([*bodies, b""]):
            if size and (size + len(body) > shard or i == len(bodies)):
                shards.append(_Shard(bodies[low:i], copies[low:i], windows[low:i], length))
                low, size = i, 0
            size += len(body)
        for i, one in enumerate(shards):
            for other in shards[:i]:
                one.merge(other)
        return [x for s in shards for x in s.spans()]

    return run


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """All rows with ``_spans``, the (first byte, last byte + 1) in UTF-8 that strings of `length` bytes cover which also start elsewhere.

    Strings are judged on the input and never cross rows; overlaps count.  Null, empty and shorter texts have no
    spans; a repeated row makes all its strings recur; a text of any length is taken whole; an empty table stays
    empty.  A column ``_spans`` of the input is replaced.
    """
    return _repeats.find(docs, key, text, False, length, K, BIN, judge(length))


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): the bytes that no recurring string covers; they may cut a character."""

    def run(batches):
        for batch in batches:
            row, start, end = t.spans(batch.column(2), batch.num_rows)
            sizes, n_removed, n_spans, kept = [], [], [], []
            for low, high, data, offsets in t.slices(batch.column(1)):
                a, b = np.searchsorted(row, low), np.searchsorted(row, high)
                raw, has = data.tobytes(), np.diff(np.searchsorted(row[a:b], np.arange(low, high + 1)))
                for i, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    gone = None
                    if has[i]:
                        own = slice(*np.searchsorted(row, (low + i, low + i + 1)))
                        gone = t.covered(y - x, start[own], end[own])
                    sizes.append(y - x)
                    n_removed.append(int(gone.sum()) if has[i] else 0)
                    n_spans.append(len(t.runs(gone)[0]) if has[i] else 0)
                    kept.append(data[x:y][~gone].tobytes() if has[i] else raw[x:y])
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, n_removed, n_spans)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_bytes", "n_removed", "n_spans", "kept"])

    found = occurrences(docs.select(key, text), key, text, length)
    kind = docs.schema[key].dataType.simpleString()
    return found.select(key, F.col(text), "_spans").mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
