"""Substring dedup by repeated-phrase automata.

Passages that recur are confirmed shard by shard (see ``_repeats``): a window of words counts as recurring if it
starts at two places at least, and maximal stretches of recurring windows form passages, each window in the passage
of the first text that holds it.  Each shard compiles its passages into one Aho-Corasick automaton, as pieces of
half a window, and streams every stretch of every document that can hold them through it.  Every window holds a
whole piece of its passage, so each occurrence, in whatever text, shows as a hit; hits are extended both ways as far
as text and passage agree, and stretches of at least a window are covered.  Equal stretches are streamed once.
"""

from __future__ import annotations

from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notequery.llm import _repeats
from notequery.llm import _text as t

#: Words of a shard, words of the k-grams that choose a window's shard.
SHARD_WORDS, K = 150_000, 6
#: Words become characters from here on, beyond the surrogates.
_FIRST = 0x10000


def _passages(coded: list[str], copies: np.ndarray, windows: np.ndarray, length: int) -> list[str]:
    """Stretches of recurring windows; each distinct window that recurs stands in one of them."""
    counts: Counter[str] = Counter()
    for code, n, many in zip(coded, windows.tolist(), copies.tolist(), strict=True):
        for i in range(n):
            counts[code[i : i + length]] += many
    out = []
    for code, n in zip(coded, windows.tolist(), strict=True):
        flags = np.fromiter((counts[code[i : i + length]] > 1 for i in range(n)), dtype=bool, count=n)
        for a, b in zip(*t.runs(flags), strict=True):
            out.append(code[a : b + length - 1])
            for i in range(a, b):
                counts[code[i : i + length]] = 0  # it has its passage
    return out


def _agree(a: str, i: int, b: str, j: int) -> int:
    """How far two texts agree from two places on."""
    n, most = 0, min(len(a) - i, len(b) - j)
    while n + 32 <= most and a[i + n : i + n + 32] == b[j + n : j + n + 32]:
        n += 32
    while n < most and a[i + n] == b[j + n]:
        n += 1
    return n


def judge(length: int):
    """Spans of words that recurring windows of `length` words cover, for the variants of one shard."""
    piece = (length + 1) // 2

    def run(bodies: list[bytes], copies: np.ndarray, windows: np.ndarray) -> list[list[tuple[int, int]]]:
        ids: dict[bytes, int] = {}
        coded = ["".join(map(chr, (ids.setdefault(w, len(ids) + _FIRST) for w in body.split()))) for body in bodies]
        passages = _passages(coded, copies, windows, length)
        places: dict[str, list[tuple[int, int]]] = {}
        for no, passage in enumerate(passages):
            for at in range(0, len(passage) - piece + 1, piece):
                places.setdefault(passage[at : at + piece], []).append((no, at))
        if not places:
            return [[] for _ in bodies]
        automaton = ahocorasick.Automaton()
        for text, found in places.items():
            automaton.add_word(text, found)
        automaton.make_automaton()
        out = []
        for code in coded:
            spans: list[tuple[int, int]] = []
            reached: dict[tuple[int, int], int] = {}
            for last, found in automaton.iter(code):
                for no, place in found:
                    start, passage = last - piece + 1, passages[no]
                    if reached.get((no, start - place), 0) > last:
                        continue
                    end = last + 1 + _agree(code, last + 1, passage, place + piece)
                    reached[no, start - place] = end
                    while start and place and code[start - 1] == passage[place - 1]:
                        start, place = start - 1, place - 1
                    if end - start >= length:
                        spans.append((start, end))
            joined: list[tuple[int, int]] = []
            for start, end in sorted(spans):
                if joined and joined[-1][1] >= start:
                    start, end = joined[-1][0], max(joined.pop()[1], end)
                joined.append((start, end))
            out.append(joined)
        return out

    return run


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 35) -> DataFrame:
    """All rows with ``_spans``, the (first word, last word + 1) that windows of `length` words cover which also start elsewhere.

    Words are what space and \\t \\n \\v \\f \\r separate, unchanged.  Windows are judged on the input.  Null and
    empty texts and texts of fewer words have no spans; a repeated row makes all its windows recur; a text of any
    length is streamed as a whole; an empty table stays empty.  A column ``_spans`` of the input is replaced.
    """
    return _repeats.find(docs, key, text, True, length, K, SHARD_WORDS, judge(length))


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 35) -> DataFrame:
    """(key, n_words, n_removed, kept): the words that no recurring window covers, joined by one space."""

    def run(batches):
        for batch in batches:
            row, start, end = t.spans(batch.column(2), batch.num_rows)
            n_words, n_removed, kept = [], [], []
            for low, high, data, offsets in t.slices(batch.column(1)):
                raw = data.tobytes()
                found = [raw[a:b].split() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                sizes = np.array([len(x) for x in found])
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                a, b = np.searchsorted(row, low), np.searchsorted(row, high)
                gone = t.covered(bounds[-1], bounds[row[a:b] - low] + start[a:b], bounds[row[a:b] - low] + end[a:b])
                lost = np.concatenate(([0], np.cumsum(gone)))
                lost = lost[bounds[1:]] - lost[bounds[:-1]]
                for i, own in enumerate(found):
                    if lost[i]:
                        own = [w for w, x in zip(own, gone[bounds[i] : bounds[i + 1]].tolist(), strict=True) if not x]
                    kept.append(b" ".join(own).decode())
                n_words += sizes.tolist()
                n_removed += lost.tolist()
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_words", "n_removed", "kept"])

    found = occurrences(docs.select(key, text), key, text, length)
    kind = docs.schema[key].dataType.simpleString()
    return found.select(key, F.col(text), "_spans").mapInArrow(run, f"`{key}` {kind}, n_words long, n_removed long, kept string")
