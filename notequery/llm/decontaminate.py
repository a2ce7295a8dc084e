"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against windows of training words.

The windows of all benchmark items are hashed into a sorted set that is broadcast.  Tasks hash every window of words
of whole documents, look the hashes up, and verify each hit word by word, without a shuffle; memory is a slice of
text and the set.  Of a benchmark beyond ``MOST_WINDOWS`` windows only the hashes are broadcast, 8 bytes each and
``MOST_HASHES`` at a time, so that 6 million windows take one pass over the documents: what they hit is kept as a table
with its words and joined to the windows by hash, length and words, which verifies it.  Hits, which are few, are then
joined to the documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notequery.llm import _store
from notequery.llm import _text as t

#: Windows that are broadcast with their words (about 200 bytes each), and hashes of windows beyond that.
MOST_WINDOWS, MOST_HASHES = 250_000, 6_000_000
_FOLD = np.where(t.ALNUM, t.LOWER, 0x20).astype(np.uint8).tobytes()
_HITS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("item", pa.string())]))
HITS = "array<struct<start: int, length: int, item: string>>"


def normalise(text: str | None) -> list[bytes]:
    """Words: A-Z lower-cased, cut at every ASCII character that is no letter or digit."""
    return (text or "").encode().translate(_FOLD).split()


def windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(length, words, item) of the windows of every item: n words each, or the whole of a shorter item."""

    def cut(batches):
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = normalise(text)
                size = min(n, len(found))
                out += [(size, b" ".join(found[i : i + size]), item) for i in range(len(found) - size + 1) if size]
            length, joined, items = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(length, pa.int32()), pa.array(joined, pa.binary()), pa.array(items, pa.string())], names=["length", "words", "item"])

    return benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(cut, "length int, words binary, item string").distinct()


def _hashes(texts: list[bytes], length: int) -> np.ndarray:
    """The hash of each window of so many words, as ``t.grams`` has it in a document."""
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    starts, ends, _ = t.words(data, np.array([0, len(data)]), t.ALNUM)
    return t.grams(t.prefix(t.span(t.prefix(data), starts, ends)), length)[::length]


class _Part:
    """The set, as tasks use it: by length, sorted hashes with their words and items."""

    def __init__(self, rows: pa.Table | None):
        self.by_length: dict[int, tuple] = {}
        grouped: dict[int, dict[bytes, list]] = {}
        for length, words, item in zip(*(rows[c].to_pylist() for c in ("length", "words", "item")), strict=True) if rows else ():
            grouped.setdefault(length, {}).setdefault(words, []).append(item)
        for length, texts in grouped.items():
            found = list(texts)
            hashes = _hashes(found, length)
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << 16, dtype=bool)
            seen[hashes >> np.uint64(48)] = True
            self.by_length[length] = (hashes[order], [found[i] for i in order], [texts[found[i]] for i in order], seen)


def _scan(part):
    """The first column with the number of words and the verified hits of the set; the text is the last column."""

    def run(batches):
        lookup = part.value.by_length
        for batch in batches:
            counts, hits = np.zeros(batch.num_rows, dtype=np.int64), [[] for _ in range(batch.num_rows)]
            for low, high, raw, offsets in t.slices(batch.column(batch.num_columns - 1)):
                data = t.LOWER[raw]
                starts, ends, bounds = t.words(data, offsets, t.ALNUM)
                counts[low:high] = np.diff(bounds)
                sums = t.prefix(t.span(t.prefix(data), starts, ends))
                for length, (hashes, texts, items, seen) in lookup.items():
                    own = t.grams(sums, length)
                    maybe = np.flatnonzero(seen[own >> np.uint64(48)])
                    where = np.minimum(np.searchsorted(hashes, own[maybe]), len(hashes) - 1)
                    same = hashes[where] == own[maybe]
                    for i, k in zip(maybe[same], where[same], strict=True):
                        row = int(np.searchsorted(bounds, i, side="right")) - 1
                        if i + length > bounds[row + 1]:
                            continue
                        found = b" ".join(data[starts[j] : ends[j]].tobytes() for j in range(i, i + length))
                        while k < len(hashes) and hashes[k] == own[i]:
                            if texts[k] == found:
                                hits[low + row] += [{"start": int(i - bounds[row]), "length": length, "item": item} for item in items[k]]
                            k += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array([h or None for h in hits], _HITS)], names=[batch.schema.names[0], "_words", "_hits"])

    return run


def _hashed(batches):
    """Windows with their hashes."""
    for batch in batches:
        lengths = batch.column(0).to_numpy()
        out = np.zeros(len(lengths), dtype=np.uint64)
        for length in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == length)
            out[own] = _hashes([batch.column(1)[i].as_py() for i in own.tolist()], length)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], names=[*batch.schema.names, "hash"])


def _seek(part):
    """(_a, _b, start, length, hash, words) of the words of documents (_a, _b, text) whose hash is one of the sorted ones of their length."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            found: list[tuple] = []
            for low, _, raw, offsets in t.slices(batch.column(2)):
                data = t.LOWER[raw]
                starts, ends, bounds = t.words(data, offsets, t.ALNUM)
                sums = t.prefix(t.span(t.prefix(data), starts, ends))
                for length, hashes in part.value.items():
                    own = t.grams(sums, length)
                    same = np.flatnonzero(hashes[np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)] == own)
                    rows = np.searchsorted(bounds, same, side="right") - 1
                    for i, row in zip(same.tolist(), rows.tolist(), strict=True):
                        if i + length <= bounds[row + 1]:
                            words = b" ".join(data[starts[j] : ends[j]].tobytes() for j in range(i, i + length))
                            found.append((a[low + row].as_py(), b[low + row].as_py(), i - int(bounds[row]), length, int(own[i].view(np.int64)), words))
            columns = zip(*found, strict=True) if found else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_a", "_b", "start", "length", "hash", "words"])

    return run


def _found(docs: DataFrame, benchmark: DataFrame, n: int, text: str, most: int, hashes: int) -> DataFrame:
    """(_row, _words, _hits) of all rows of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    grams = _store.table(windows(benchmark, n), "windows")
    count = grams.count()
    schema = _store.extended(rows.select("_row"), f"_words long, _hits {HITS}")
    if count <= most:
        return rows.mapInArrow(_scan(spark.sparkContext.broadcast(_Part(grams.toArrow() if count else None))), schema)
    grams = _store.table(grams.mapInArrow(_hashed, "length int, words binary, item string, hash long"), "hashed-windows")
    each = _store.table(grams.select("length", "hash").distinct(), "window-hashes")
    parts = -(-each.count() // hashes)
    ids = [F.xxhash64(F.lit(k), "_row") for k in range(2)]
    known = rows.select(ids[0].alias("_a"), ids[1].alias("_b"), "_text")
    every = None
    for i in range(parts):
        found = each.filter(F.pmod(F.xxhash64("length", "hash"), F.lit(parts)) == i).toArrow()
        lengths, codes = found["length"].to_numpy(), found["hash"].to_numpy().view(np.uint64)
        part = spark.sparkContext.broadcast({length: np.sort(codes[lengths == length]) for length in np.unique(lengths).tolist()})
        hits = _store.table(known.mapInArrow(_seek(part), "_a long, _b long, start int, length int, hash long, words binary"), "hits")
        part.unpersist()
        every = hits if every is None else every.unionByName(hits)
    # Equal rows bring their hits once each, the same ones.
    one = F.struct("start", "length", "item")
    hits = every.join(grams, ["length", "hash", "words"]).select("_a", "_b", one.alias("h")).distinct().groupBy("_a", "_b").agg(F.collect_list("h").alias("_found"))
    out = rows.mapInArrow(_scan(spark.sparkContext.broadcast(_Part(None))), schema).withColumns({"_x": ids[0], "_y": ids[1]})
    return out.join(_store.table(hits, "hits-by-row"), (F.col("_x") == F.col("_a")) & (F.col("_y") == F.col("_b")), "left").select("_row", "_words", F.col("_found").alias("_hits"))


def find(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", most: int = MOST_WINDOWS, hashes: int = MOST_HASHES) -> DataFrame:
    """All rows and columns of docs, with ``_hits``: (first word, words, item) of every occurrence of an item's window.

    Null and empty texts have no hits; items without words match nothing; items of fewer than n words match
    whole.  A null item_id gives hits whose item is null.  An empty benchmark gives no hits, an empty table stays
    empty, repeated rows have the same hits each, and a text of any length is scanned whole.  A column ``_hits`` of
    the input is replaced; all others keep their values.
    """
    own = [c for c in docs.columns if c != "_hits"]
    out = _found(docs.select(*[F.col(f"`{c}`") for c in own]), benchmark, n, text, most, hashes)
    return out.select(*[F.col(f"_row.`{c}`") for c in own], "_hits")


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", most: int = MOST_WINDOWS, hashes: int = MOST_HASHES) -> DataFrame:
    """All columns of docs with n_words, n_hit, n_items, items_sha256 and contaminated, as ``find`` has the hits.

    Null and empty texts have no words; odd items, repeated rows, long texts and empty tables are as in ``find``;
    columns of the input with these names are replaced.
    """
    added = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    own = [c for c in docs.columns if c not in added]

    def digest(batches):
        for batch in batches:
            n_hit, n_items, sha = [], [], []
            for hits in batch.column(2).to_pylist():
                covered: set[int] = set()
                for h in hits or ():
                    covered.update(range(h["start"], h["start"] + h["length"]))
                items = sorted({h["item"] for h in hits or () if h["item"] is not None})
                n_hit.append(len(covered))
                n_items.append(len(items))
                sha.append(hashlib.sha256(",".join(items).encode()).hexdigest())
            new = [batch.column(1), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], names=["_row", *added])

    found = _found(docs.select(*[F.col(f"`{c}`") for c in own]), benchmark, n, text, most, hashes)
    schema = _store.extended(found.select("_row"), "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    return found.mapInArrow(digest, schema).select(*[F.col(f"_row.`{c}`") for c in own], *added)
