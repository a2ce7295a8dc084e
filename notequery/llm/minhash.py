"""Near-duplicates by circulant MinHash.

A document is its set of shingles.  One permutation scatters the shingles; a second one, shifted round by k, ranks
them for coordinate k of the signature, so two permutations serve all coordinates.  Rows of coordinates form
bands; documents that agree on a band are candidates, and links are confirmed on the full sets:

1. documents with equal sets are one node from the start, however many there are;
2. in each band's bucket every node is compared with the bucket's least node, a number of pairs that grows with
   the nodes and not with their square, and links make components;
3. what is left is a pair of nodes of different components in one bucket, of which neither is the least.  Linked
   sets share one of their rarest shingles (of a set of n, the n - ceil(percent * n) + 1 that come first in an order
   by counts), so only nodes that such shingles connect go, with the full sets, into blocks of bounded size, in
   which every node outside the largest component is compared with all others.  Phrases that many documents
   share are not rare and connect nothing.  A group beyond one block is dealt over pairs of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notequery.llm import _store
from notequery.llm import _text as t
from notequery.llm.components import components

#: Coordinates in a band, nodes and shingles in a block, and the chance that a pair at the threshold shares no band.
ROWS, BLOCK, BLOCK_SHINGLES, MISS = 4, 1500, 4_000_000, 1e-7
#: Shingles are counted in so many bins, for their order from rare to common.
BINS = 1 << 18
WORD = r"[^\x20\x09-\x0D]"
_U = np.uint32
_SHIFT, _A, _B = _U(0x9E3779B1), _U(0x85EBCA6B), _U(0xC2B2AE35)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of `size` words, A-Z in lower case; of all words if fewer."""
    starts, ends, bounds = t.words(data, offsets, t.SPACED)
    sums = t.prefix(t.span(t.prefix(t.LOWER[data]), starts, ends))
    full = t.grams(sums, size)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(full[a : b - size + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        else:
            out.append(t.span(sums, np.array([a]), np.array([b])) if b > a else np.empty(0, dtype=np.uint64))
    return out


def band_count(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands that a pair of the least similarity misses with chance ``miss`` at most."""
    same = (percent / 100) ** rows
    return 1 if same >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - same)))


def bands(sets: list[np.ndarray], rows: int, n: int) -> np.ndarray:
    """Hashes of the bands of each set's signature (sets by bands); sets must not be empty."""
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1].astype(np.int64)
    scattered = (t.mix(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)  # the first permutation
    out = np.empty((len(sets), n), dtype=np.uint64)
    for band in range(n):
        code = np.full(len(sets), band + 1, dtype=np.uint64)
        for row in range(rows):
            ranked = (scattered + _U((band * rows + row) * int(_SHIFT) & 0xFFFFFFFF)) * _A  # the second, shifted round
            ranked ^= ranked >> _U(15)
            ranked *= _B
            ranked ^= ranked >> _U(13)
            code = t.mix(code * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(ranked, bounds))
        out[:, band] = code
    return out


def sketch(rows: DataFrame, size: int, n: int, rows_: int = ROWS) -> DataFrame:
    """``rows`` with node, n_shingles and bands in place of ``_text``; equal sets have equal nodes, an empty set has none."""
    own = [c for c in rows.columns if c != "_text"]

    def run(batches):
        for batch in batches:
            out_node, out_size, out_codes = [], [], []
            for _, _, data, offsets in t.slices(batch.column(batch.schema.get_field_index("_text"))):
                sets = shingles(data, offsets, size)
                some = [i for i, s in enumerate(sets) if len(s)]
                node: list = [None] * len(sets)
                codes: list = [None] * len(sets)
                if some:
                    found = bands([sets[i] for i in some], rows_, n).view(np.int64)
                    for k, i in enumerate(some):
                        node[i] = int(t.mix(np.array([t.mix(sets[i]).sum(dtype=np.uint64) + np.uint64(len(sets[i]))])).view(np.int64)[0])
                        codes[i] = found[k]
                out_node += node
                out_size += [len(s) for s in sets]
                out_codes += codes
            columns = [*(batch.column(batch.schema.get_field_index(c)) for c in own), pa.array(out_node, pa.int64()), pa.array(out_size, pa.int64()), pa.array(out_codes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*own, "node", "n_shingles", "bands"])

    return rows.mapInArrow(run, _store.extended(rows.drop("_text"), "node long, n_shingles long, bands array<long>"))


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = np.concatenate((a, b))
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (small + large - same)


def _verify(percent: int):
    """Pairs (a, b) of sets with ``linked``."""

    def run(batches):
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            linked = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


def _compare(percent: int):
    """Links between components within a block pair: each node outside the largest component against all nodes."""

    def run(block: pa.Table) -> pa.Table:
        # A node of a block paired with itself comes once, of two blocks from either.
        node, own = block.column("node").to_numpy(), block.column("component").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in block.column("set").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        shingle, place = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(shingle)
        shingle, place = shingle[order], place[order]
        names, counts = np.unique(own, return_counts=True)
        a, b = [], []
        for i in np.flatnonzero(own != names[np.argmax(counts)]).tolist():
            low, high = (np.searchsorted(shingle, sets[i], side=s) for s in ("left", "right"))
            same = np.bincount(place[t.ranges(low, high - low)], minlength=len(sets))
            linked = np.flatnonzero((100 * same >= percent * (sizes + sizes[i] - same)) & (own != own[i]))
            _, first = np.unique(own[linked], return_index=True)
            a += [int(node[i])] * len(first)
            b += node[linked[first]].tolist()
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall into each bin; ``BINS`` numbers, whatever the data."""

    def run(batches):
        total = np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.bincount((np.frombuffer(x, np.uint64) >> np.uint64(46)).astype(np.int64), minlength=BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bin", "n"])

    found = sets.select("set").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BINS, dtype=np.int64)
    out[found["bin"].to_numpy()] = found["n"].to_numpy()
    return out


def _rarest(counts, percent: int):
    """(node, shingle) of the shingles of each set that come first from rare to common and of which linked sets share one."""

    def run(batches):
        order = counts.value
        for batch in batches:
            nodes, out = [], []
            for node, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(x, np.uint64)
                first = len(own) + percent * len(own) // -100 + 1
                rare = own[np.lexsort((own, order[(own >> np.uint64(46)).astype(np.int64)]))[:first]]
                out.append(rare)
                nodes.append(np.full(len(rare), node, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(out).view(np.int64))], names=["node", "shingle"])

    return run


def _residual(members: DataFrame, open_: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) between nodes of different components in the buckets of ``open_`` pairs (node, head)."""
    mixed = members.filter("n > 2").join(open_, ["node", "head"]).select("key").distinct()
    inside = members.join(_store.table(mixed, "mixed-buckets"), "key", "left_semi").select("node").distinct()
    inside = inside.join(labels.select(F.col("node").alias("_l"), "component"), F.col("node") == F.col("_l"), "left")
    inside = _store.table(inside.select("node", F.coalesce("component", "node").alias("component")), "unsettled")
    own = _store.table(sets.join(inside, "node").select("node", "component", "set"), "unsettled-sets")
    counts = members.sparkSession.sparkContext.broadcast(_counts(own))
    rare = _store.table(own.select("node", "set").mapInArrow(_rarest(counts, percent), "node long, shingle long"), "rare-shingles")
    heads = rare.groupBy("shingle").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1").select("shingle", "head")
    tied = rare.join(_store.table(heads, "rare-heads"), "shingle").select(F.col("node").alias("a"), F.col("head").alias("b"))
    groups = components(tied)
    nodes = own.join(groups.select(F.col("node").alias("_g"), F.col("component").alias("_group")), F.col("node") == F.col("_g"), "left")
    nodes = nodes.withColumn("group", F.coalesce("_group", "node"))
    sizes = nodes.groupBy("group").agg(
        F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.octet_length("set") / 8) / BLOCK_SHINGLES)).cast("int").alias("blocks"),
        F.min("component").alias("low"), F.max("component").alias("high"),
    )
    nodes = nodes.join(_store.table(sizes.filter("low <> high").select("group", "blocks"), "groups"), "group")
    nodes = nodes.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = nodes.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component", "set")
    return pairs.groupBy("group", "i", "j").applyInArrow(_compare(percent), "a long, b long")


def _classes(rows: DataFrame, size: int, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (with ``_rid``, ``_text`` and others) less its text, with ``n_shingles`` and ``_class``; and the table (_rid, _text)."""
    texts = rows.select("_rid", "_text")
    sketches = _store.table(sketch(rows, size, band_count(percent)), "sketches")
    nodes = sketches.filter("node is not null").groupBy("node").agg(F.min("_rid").alias("_rid"), F.first("bands").alias("bands"))
    keys = _store.table(nodes.select("node", "_rid", F.explode("bands").alias("key")), "band-keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("head")).filter("n > 1")
    members = _store.table(keys.join(_store.table(shared, "shared-keys"), "key").select("key", "node", "_rid", "head", "n"), "buckets")
    pairs = _store.table(members.filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), "pairs")
    wanted = _store.table(members.select("_rid", "node").distinct(), "wanted")

    def full(batches):
        for batch in batches:
            out = []
            for _, _, data, offsets in t.slices(batch.column(1)):
                out += [s.tobytes() for s in shingles(data, offsets, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "set"])

    # Texts are dealt by a merge at every size, since what is wanted grows with the data; equal rows bring one set.
    once = texts.join(wanted.hint("merge"), "_rid").select("node", "_text").mapInArrow(full, "node long, set binary")
    sets = _store.table(once.dropDuplicates(["node"]), "sets")
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    compared = _store.table(joined.select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent), "a long, b long, linked boolean"), "compared")
    labels = components(compared.filter("linked"))
    left, right = (labels.select(F.col("node").alias(f"_{c}"), F.col("component").alias(f"_c{c}")) for c in "ab")
    apart = compared.filter("not linked").join(left, F.col("a") == F.col("_a"), "left").join(right, F.col("b") == F.col("_b"), "left")
    apart = apart.filter(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).select(F.col("a").alias("node"), F.col("b").alias("head"))
    open_ = _store.table(apart, "open-pairs")
    if open_.limit(1).count():
        more = _store.table(_residual(members.select("key", "node", "head", "n"), open_, labels, sets, percent, block), "more-links")
        if more.limit(1).count():
            labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    placed = sketches.drop("bands").join(labels.select(F.col("node").alias("_node"), "component"), F.col("node") == F.col("_node"), "left")
    placed = placed.withColumn("_class", F.coalesce("component", "node")).drop("node", "_node", "component")
    return _store.table(placed, "classes"), texts


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """All rows and columns but the text, with ``n_shingles``, ``component_id`` and ``kept``.

    Rows are linked if 100 * common shingles >= percent * all shingles of both.  ``component_id`` is the least key
    that a chain of links reaches, the row's own included; ``kept`` marks the rows whose key that is.  A null key is
    never the least unless there is no other; null and empty texts are linked with nothing.  A repeated row is in
    one component with its copies; a text of any length is one set; an empty table stays empty; columns of the
    input with the added names are replaced.  Rows and sets are known by 64-bit hashes.
    """
    own = [c for c in docs.columns if c not in ("n_shingles", "component_id", "kept", text)]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col(f"`{key}`").alias("_key"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("_rid"), F.col(f"`{text}`").alias("_text")
    )
    placed, _ = _classes(rows, size, percent, block)
    least = placed.filter("_class is not null").groupBy("_class").agg(F.min("_key").alias("_least")).withColumnRenamed("_class", "_c")
    out = placed.join(_store.table(least, "least-keys"), F.col("_class") == F.col("_c"), "left")
    found = F.when(F.col("_class").isNull(), F.col("_key")).otherwise(F.col("_least"))
    return out.select("_row.*", "n_shingles", found.alias("component_id"), F.col("_key").eqNullSafe(found).alias("kept"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """One row of each class of linked rows, that of the least key, and all rows whose text has no shingle.

    Rows of different classes stay whatever their keys; of rows with the least key but different texts the one of
    the least hash stays, of equal rows any.  An empty table stays empty, and all columns are kept.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("_rid"))
    placed, _ = _classes(rows.select("_rid", "_text", F.col(f"_row.`{key}`").alias("_key")), size, percent, block)
    alike = placed.filter("_class is not null").groupBy("_rid", "_class").agg(F.min("_key").alias("_key"), F.count("*").alias("_n"))
    first = F.min(F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_rid").alias("rid"), F.col("_n").alias("n")))
    least = _store.table(alike.groupBy("_class").agg(first.alias("_least")).select(F.col("_least.rid").alias("_first"), F.col("_least.n").alias("_n")), "least-rows")
    worded = F.coalesce(F.regexp_like("_text", F.lit(WORD)), F.lit(False))
    one = rows.filter(worded).join(least.hint("merge"), F.col("_rid") == F.col("_first"))
    if least.filter("_n > 1").limit(1).count():
        one = one.filter("_n = 1").unionByName(one.filter("_n > 1").dropDuplicates(["_rid"]))
    return one.select("_row.*").unionByName(rows.filter(~worded).select("_row.*"))
