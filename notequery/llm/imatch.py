"""Document fingerprints by I-Match with randomised lexicons.

The lexicon is the terms whose document frequency lies within a band.  A document keeps its distinct lexicon
terms; each of several random subsets of the lexicon, from half of it down to one term in 512, gives a hash of
the sorted terms it keeps (a sum of their hashes, which no order changes).  Documents are alike as far as subsets of
the most telling size agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from notequery.llm import _store
from notequery.llm import _text as t

#: Band of document frequencies, as shares of all documents.
LOW, HIGH = 0.0005, 0.05
#: A subset of scale i keeps a term with chance 2 ** -(2 * i + 1); each scale has so many subsets.
SCALES, SUBSETS = 5, 24
#: Documents with fewer lexicon terms are told by all their terms; scales with fewer non-empty subsets don't tell.
FEWEST, TELLING = 5, 4
#: Buckets into which rows are dealt by key, to find each row's successor.
BUCKETS, BUCKET_ROWS, STEP = 4096, 2000, 64


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct terms of each row, in order; a term is a run of letters and digits, A-Z in lower case."""
    starts, ends, bounds = t.words(data, offsets, t.ALNUM)
    hashes = t.span(t.prefix(t.LOWER[data]), starts, ends)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms that stand in at least two documents and in ``low`` to ``high`` of all.

    Frequencies cover all documents, and texts of any length are taken whole.  At most (mean distinct terms of a document) / ``low`` terms reach the lower
    end, at 8 bytes each, however many documents there are: 300,000 where documents have 150 distinct terms.
    Null and empty texts have no terms but count as documents; an empty table makes an empty lexicon.
    """

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in t.slices(batch.column(0)):
                found, n = np.unique(_terms(data, offsets)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["term", "n"])

    n = docs.count()
    counts = docs.select(F.col(text).alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = counts.filter((F.col("n") >= max(2, low * n)) & (F.col("n") <= max(2, high * n)))
    return np.sort(counts.select("term").toArrow()["term"].to_numpy().view(np.uint64))


def fingerprints(data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> np.ndarray:
    """24-bit hashes (rows by subsets); 0 where a subset keeps none of a row's terms."""
    n = len(offsets) - 1
    rows, terms = _terms(data, offsets)
    if len(known):
        inside = known[np.minimum(np.searchsorted(known, terms), len(known) - 1)] == terms
    else:
        inside = np.zeros(len(terms), dtype=bool)
    few = np.bincount(rows[inside], minlength=n) < FEWEST
    inside |= few[rows]
    rows, terms = rows[inside], terms[inside]
    out = np.zeros((n, SCALES * SUBSETS), dtype=np.uint32)
    if not len(rows):
        return out
    bounds = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    for j in range(SUBSETS):
        lot = t.mix(terms + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        value = t.mix(lot)
        for i in range(SCALES):
            keep = lot < np.uint64(1 << (63 - 2 * i))
            sums = np.add.reduceat(np.where(keep, value, np.uint64(0)), bounds)
            some = np.logical_or.reduceat(keep, bounds)
            out[rows[bounds], i * SUBSETS + j] = np.where(some, (t.mix(sums) >> np.uint64(40)) | np.uint64(1), 0).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of rows: the best share of equal subsets among scales that tell; 1 for equal fingerprints."""
    some = ((a > 0) | (b > 0)).reshape(len(a), SCALES, SUBSETS)
    same = ((a == b) & (a > 0)).reshape(len(a), SCALES, SUBSETS).sum(axis=2)
    count = some.sum(axis=2)
    best = np.where(count >= TELLING, same / np.maximum(count, 1), 0.0).max(axis=1)
    return np.where((a == b).all(axis=1), 1.0, best)


def encode(prints: np.ndarray) -> list[str]:
    """Fingerprints as text, six hexadecimal digits a subset."""
    raw = np.ascontiguousarray(prints.astype(">u4")).view(np.uint8).reshape(len(prints), -1, 4)[:, :, 1:]
    return [x.tobytes().hex() for x in np.ascontiguousarray(raw)]


def add_fingerprints(docs: DataFrame, known: np.ndarray, text: str = "text") -> DataFrame:
    """All rows with ``fingerprint``.

    Equal texts have equal fingerprints; null and empty ones that of no terms; a text of any length is taken whole; an
    empty table stays empty; a column ``fingerprint`` of the input is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            out: list[str] = []
            for _, _, data, offsets in t.slices(batch.column(batch.num_columns - 1)):
                out += encode(fingerprints(data, offsets, shared.value))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], names=[*batch.schema.names[:-1], "fingerprint"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "fingerprint"]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run, _store.extended(rows.select("_row"), "fingerprint string")).select("_row.*", "fingerprint")


def _of(texts: list[str], known: np.ndarray) -> np.ndarray:
    parts = [fingerprints(data, offsets, known) for _, _, data, offsets in t.slices(pa.array(texts, pa.large_string()))]
    return np.concatenate(parts)


def _bucket(cuts: list[int], place: str):
    """How many cuts are at most a place; ``STEP`` by ``STEP``, so that a row is compared with few of them."""
    if not cuts:
        return F.lit(0)
    groups = [cuts[i : i + STEP] for i in range(0, len(cuts), STEP)]
    upto = lambda a: F.size(F.filter(a, lambda c: c <= F.col(place)))
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    group = upto(longs([g[0] for g in groups]))
    return F.when(group == 0, 0).otherwise((group - 1) * STEP + upto(F.element_at(F.array(*[longs(g) for g in groups]), F.greatest(group, F.lit(1)))))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, _text, _last) dealt into key ranges that are sorted, each ended by a copy (_last) of the row that follows it.

    The key is an integer.  After the greatest key comes the least.  Ranges are cut at quantiles of the keys, so that
    none is large; rows with one key are in order of a hash of their text, and where they exceed a range they are
    cut by that hash; null keys come first.
    """
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} is no integer column")
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_place", F.coalesce(F.col("_key").cast("long"), F.lit(-(2**63)))).withColumn("_hash", F.xxhash64("_text"))
    n = min(BUCKETS, -(-rows.count() // BUCKET_ROWS))
    cuts = sorted({int(c) for c in rows.approxQuantile("_place", [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else []
    rows = rows.withColumn("_bucket", _bucket(cuts, "_place"))
    sizes = rows.groupBy("_bucket").agg(F.min("_place").alias("low"), F.max("_place").alias("high"), F.count("*").alias("n")).collect()
    hot = {r["_bucket"]: -(-r["n"] // BUCKET_ROWS) for r in sizes if r["low"] == r["high"] and r["n"] > 4 * BUCKET_ROWS}
    part = F.lit(0)
    for bucket, pieces in hot.items():
        part = F.when(F.col("_bucket") == bucket, F.floor((F.col("_hash") / float(2**64) + 0.5) * min(pieces, BUCKETS)).cast("int")).otherwise(part)
    rows = rows.withColumn("_part", part)
    first = sorted(tuple(r) for r in rows.groupBy("_bucket", "_part").agg(F.min(F.struct("_place", "_hash")).alias("f")).select("_bucket", "_part", "f._place", "f._hash").collect())
    follow = [(*first[i][:2], *first[(i + 1) % len(first)][2:]) for i in range(len(first))]
    ends = spark.createDataFrame(follow, "_into int, _into_part int, _from long, _from_hash long")
    lasts = rows.join(F.broadcast(ends), (F.col("_place") == F.col("_from")) & (F.col("_hash") == F.col("_from_hash")))
    lasts = lasts.groupBy("_into", "_into_part").agg(F.first(F.struct("_key", "_text", "_place", "_hash")).alias("r"))
    lasts = lasts.select("r.*", F.col("_into").alias("_bucket"), F.col("_into_part").alias("_part"), F.lit(True).alias("_last"))
    every = rows.withColumn("_last", F.lit(False)).unionByName(lasts)
    return every.repartition("_bucket", "_part").sortWithinPartitions("_bucket", "_part", "_last", "_place", "_hash").select("_key", "_text", "_last")


def against_edits(docs: DataFrame, known: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text is the text whose last floor(n_chars / 2) code points give way to as many of the next row's
    first ones, or all it has.  A null text counts as empty; a lone row is its own next; of rows with one key the next
    is the one of the next hash; equal texts have equal fingerprints wherever they stand; an empty table stays empty;
    a text of any length is taken whole.  Only the key is kept of the other columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            keys, texts, last = (batch.column(i).to_pylist() for i in range(3))
            for low in range(0, len(texts), 256):
                part = slice(low, low + 256)
                k, x, e = keys[part], texts[part], last[part]
                if held:
                    k, x, e = [held[0], *k], [held[1], *x], [held[2], *e]
                held = (k[-1], x[-1], e[-1])
                if len(x) < 2:
                    continue
                half = [len(s) // 2 for s in x[:-1]]
                edited = [s[: len(s) - h] + after[:h] for s, after, h in zip(x[:-1], x[1:], half, strict=True)]
                prints, changed = _of(x, shared.value), _of(edited, shared.value)
                keep = np.flatnonzero(~np.array(e[:-1]))
                near_edited, near_next = likeness(prints[:-1], changed), likeness(prints[:-1], prints[1:])
                columns = [
                    pa.array([k[i] for i in keep], batch.column(0).type),
                    pa.array([len(x[i]) for i in keep], pa.int64()),
                    pa.array([edited[i] for i in keep], pa.string()),
                    pa.array(encode(prints[keep]), pa.string()),
                    pa.array(encode(changed[keep]), pa.string()),
                    pa.array(near_edited[keep]),
                    pa.array(near_next[keep]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, key, text).mapInArrow(run, schema)
