"""The dataflow that finds windows of text which recur anywhere in a corpus.

Windows of a document are cut into runs that share the least hash of their k-grams, the run's key.  Equal
windows have equal keys, so only keys that occur twice can hold repeats:

1. every document emits (key, content hash, place) of its runs, about one for 15 words or 90 bytes;
2. keys are counted (a partial aggregation) and runs whose key occurs once are dropped by a join;
3. runs with equal content become one variant with its number of copies, and the text of one copy of each
   variant is cut out of its document and sent to the shard of its key;
4. each shard settles which windows of its variants recur, by the method that the operator names;
5. the verdicts are joined to all places of each variant and gathered by document.

A key whose variants hold more than a shard, as of a short phrase in very many contexts, is dealt again: its
variants pass through the same steps as documents with their copies as weights, and another order of the k-grams
gives them other keys.  What still exceeds a shard after ``ORDERS`` orders, text of very few different k-grams, goes
to shards by content: every window is hashed to 128 bits, hashes are counted (a partial aggregation) and joined back.

Shards hold about the same amount of text whatever the corpus holds.  Joins that touch all runs join two tables, so
that Spark splits their hot keys; rows and variants are known by 128 bits.  Runs, places and verdicts are kept as
tables, so that lost executors cost one step.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notequery.llm import _store
from notequery.llm import _text as t

#: Orders of the k-grams by which keys are dealt before windows are hashed one by one.
ORDERS = 2
_RUN = "_rid long, _sid long, key long, content long, start int, n int, many long"
_VARIANT = "key long, content long, copies long, n int, hot boolean, body binary"
VERDICT = "key long, content long, spans array<struct<start: int, end: int>>"
#: A shard's verdicts, and the windows of variants that are dealt by content: ``at``, two hashes and the copies.
_SETTLED = f"{VERDICT}, at int, a long, b long, copies long"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _units(data, offsets, by_words: bool):
    """Prefix sums of the units' hashes, the first unit of each row, and starts and ends of units in bytes."""
    sums = t.prefix(data)
    if not by_words:
        return sums, offsets, None, None
    starts, ends, bounds = t.words(data, offsets, t.SPACED)
    return t.prefix(t.span(sums, starts, ends)), bounds, starts, ends


def _emit(by_words: bool, length: int, k: int, seed: int):
    def run(batches):
        for batch in batches:
            rid, sid, many = (batch.column(i).to_numpy() for i in (0, 1, 3))
            for low, _, data, offsets in t.slices(batch.column(2)):
                sums, bounds, _, _ = _units(data, offsets, by_words)
                row, key, content, start, n = t.chunks(sums, bounds, length, k, seed)
                row += low
                columns = [rid[row], sid[row], key.view(np.int64), content.view(np.int64), start.astype(np.int32), n.astype(np.int32), many[row]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_rid", "_sid", "key", "content", "start", "n", "many"])

    return run


def _cut(by_words: bool, length: int):
    """The text of each variant that a document was chosen for."""

    def run(batches):
        last = None
        for batch in batches:
            rid = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            lists = batch.column(3)
            counts = np.diff(lists.offsets.to_numpy())
            values = lists.flatten()
            first = np.cumsum(counts) - counts
            key, content, copies, start, n = (values.field(c).to_numpy() for c in ("key", "content", "copies", "start", "n"))
            hot = values.field("hot")
            for low, high, data, offsets in t.slices(batch.column(2)):
                begins, finishes, bounds = t.words(data, offsets, t.SPACED) if by_words else (None, None, offsets)
                raw, bodies, at = data.tobytes(), [], []
                for i in range(low, high):
                    if rid[i] == last:
                        continue
                    last = rid[i]
                    for j in range(first[i], first[i] + counts[i]):
                        a = bounds[i - low] + start[j]
                        b = a + n[j] + length - 1
                        bodies.append(raw[begins[a] : finishes[b - 1]] if by_words else raw[a:b])
                        at.append(j)
                if at:
                    columns = [pa.array(key[at]), pa.array(content[at]), pa.array(copies[at]), pa.array(n[at]), hot.take(pa.array(at)), pa.array(bodies, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "content", "copies", "n", "hot", "body"])

    return run


def _windows(bodies: list[bytes], windows: np.ndarray, by_words: bool, length: int):
    """The variant and place of every window, and two independent 64-bit hashes of it."""
    data = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in bodies])))
    starts, ends, bounds = t.words(data, offsets, t.SPACED) if by_words else (None, None, offsets)
    row = np.repeat(np.arange(len(bodies)), windows)
    at = t.ranges(np.zeros(len(bodies), dtype=np.int64), windows)
    first, hashes = bounds[row] + at, []
    for units in (data, data.astype(np.uint64) + np.uint64(1)):
        sums = t.prefix(units)
        if by_words:
            sums = t.prefix(t.span(sums, starts, ends))
        hashes.append(t.span(sums, first, first + length).view(np.int64))
    return row, at, *hashes


def _settle(judge: Callable, by_words: bool, length: int):
    """Call judge(bodies, copies, windows) -> spans of each body, on the distinct variants of a shard; hash those that are dealt by content."""

    def run(shard: pa.Table) -> pa.Table:
        seen: dict[tuple[int, int], int] = {}
        key, content = shard.column("key").to_pylist(), shard.column("content").to_pylist()
        for i, pair in enumerate(zip(key, content, strict=True)):
            seen.setdefault(pair, i)
        shard = shard.take(pa.array(list(seen.values())))
        bodies, copies, n = shard.column("body").to_pylist(), shard.column("copies").to_numpy(), shard.column("n").to_numpy()
        if shard.column("hot")[0].as_py():
            row, at, a, b = _windows(bodies, n, by_words, length)
            spans, rest = pa.nulls(len(row), _SPANS), [pa.array(at.astype(np.int32)), pa.array(a), pa.array(b), pa.array(copies[row])]
        else:
            found = judge(bodies, copies, n)
            row = np.array([i for i, x in enumerate(found) if x], dtype=np.int64)
            spans = pa.array([[{"start": a, "end": b} for a, b in found[i]] for i in row], _SPANS)
            rest = [pa.nulls(len(row), kind) for kind in (pa.int32(), pa.int64(), pa.int64(), pa.int64())]
        columns = [shard.column("key").take(pa.array(row)), shard.column("content").take(pa.array(row)), spans, *rest]
        return pa.Table.from_arrays(columns, names=["key", "content", "spans", "at", "a", "b", "copies"])

    return run


def _joined(length: int):
    """The spans that the recurring windows of each variant cover."""

    def run(batches):
        for batch in batches:
            out = []
            for places in batch.column(2).to_pylist():
                at = np.unique(places)
                cut = np.flatnonzero(np.diff(at) > length)
                first, last = at[np.concatenate(([0], cut + 1))], at[np.append(cut, len(at) - 1)] + length
                out.append([{"start": a, "end": b} for a, b in zip(first.tolist(), last.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, _SPANS)], names=["key", "content", "spans"])

    return run


def _spans(texts: DataFrame, by_words: bool, length: int, k: int, shard_units: int, judge: Callable, seed: int = 0) -> DataFrame:
    """(_rid, _sid, _spans) of the rows (_rid, _sid, _text, _many) that recurring windows cover in part."""
    ids = ["_rid", "_sid"]
    emitted = _store.table(texts.mapInArrow(_emit(by_words, length, k, seed), _RUN), "runs")
    recurring = _store.table(emitted.groupBy("key").agg(F.sum("many").alias("n")).filter("n > 1").select("key"), "recurring")
    places = _store.table(emitted.join(recurring, "key").select(*ids, "key", "content", "start", "n", "many"), "places")
    # Of a variant any copy will do; the values of one row stay together.
    variants = places.groupBy("key", "content").agg(F.sum("many").alias("copies"), *[F.first(c).alias(c) for c in (*ids, "start", "n")])
    variants = _store.table(variants, "variants")
    units = variants.groupBy("key").agg(F.sum(F.col("n") + length - 1).alias("units"))
    large = _store.table(units.filter(F.col("units") > shard_units).select(F.col("key").alias("_k")), "large-keys")
    shards = max(1, -(-(variants.agg(F.sum(F.col("n") + length - 1)).first()[0] or 0) // shard_units))
    variants = variants.join(large, F.col("key") == F.col("_k"), "left").withColumn("hot", F.col("_k").isNotNull())
    chosen = variants.groupBy(*ids).agg(F.collect_list(F.struct("key", "content", "copies", "start", "n", "hot")).alias("_variants"))
    bodies = texts.join(chosen, ids).select(*ids, "_text", "_variants").mapInArrow(_cut(by_words, length), _VARIANT)
    again = seed + 1 < ORDERS and bool(large.limit(1).count())
    if again:
        bodies = _store.table(bodies, "bodies")
        hot = bodies.filter("hot").select(F.col("key").alias("_rid"), F.col("content").alias("_sid"), F.col("body").alias("_text"), F.col("copies").alias("_many"))
        dealt = _spans(hot.dropDuplicates(ids), by_words, length, k, shard_units, judge, seed + 1)
        bodies = bodies.filter("not hot")
    shard = F.when(F.col("hot"), -1 - F.pmod("content", F.lit(shards))).otherwise(F.pmod("key", F.lit(shards))).alias("shard")
    settled = _store.table(bodies.groupBy(shard).applyInArrow(_settle(judge, by_words, length), _SETTLED), "verdicts")
    verdicts = settled.filter("spans is not null").select("key", "content", "spans")
    if again:
        verdicts = verdicts.unionByName(dealt.select(F.col("_rid").alias("key"), F.col("_sid").alias("content"), F.col("_spans").alias("spans")))
    elif large.limit(1).count():
        windows = settled.filter("at is not null").select("key", "content", "at", "a", "b", "copies")
        seen = windows.groupBy("key", "a", "b").agg(F.sum("copies").alias("copies")).filter("copies > 1").select("key", "a", "b")
        found = windows.drop("copies").join(_store.table(seen, "recurring-windows"), ["key", "a", "b"]).groupBy("key", "content").agg(F.collect_list("at").alias("at"))
        verdicts = verdicts.unionByName(_store.table(found.mapInArrow(_joined(length), VERDICT), "dealt-verdicts"))
    spans = places.join(verdicts, ["key", "content"]).select(*ids, "start", F.explode("spans").alias("s"))
    spans = spans.groupBy(*ids).agg(
        F.collect_list(F.struct((F.col("start") + F.col("s.start")).alias("start"), (F.col("start") + F.col("s.end")).alias("end"))).alias("_spans")
    )
    return _store.table(spans, "spans")


def find(docs: DataFrame, key: str, text: str, by_words: bool, length: int, k: int, shard_units: int, judge: Callable) -> DataFrame:
    """(own columns, ``_spans``): the units of each row's text that recurring windows cover, as a list of (start, end).

    A null text has no windows; equal rows find each other; a text of any length is cut as a whole; an empty table
    stays empty.  Columns of the input that start with an underscore keep their values but for ``_spans``.
    """
    own = [c for c in docs.columns if c != "_spans"]
    names = [F.col(f"`{key}`"), F.col(f"`{text}`")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), names[1].alias("_text"), F.xxhash64(*names).alias("_rid"), F.xxhash64(F.lit(1), *names).alias("_sid"))
    texts = rows.select("_rid", "_sid", "_text", F.lit(1).cast("long").alias("_many"))
    spans = _spans(texts, by_words, length, k, shard_units, judge)
    return rows.drop("_text").join(spans, ["_rid", "_sid"], "left").select("_row.*", "_spans")
