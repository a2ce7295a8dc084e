"""Near-duplicates by SimHash with anchor points.

A fingerprint has a bit set where more than half of a text's shingle hashes have it set.  Fingerprints that differ in
few bits are found without comparing all: the words of a covering code are anchors, every fingerprint goes to all
anchors near it, and only fingerprints that meet at an anchor are compared.

The code holds the 64-bit words whose set bits, as numbers 0 to 63, come to 0 by exclusive or.  Its covering radius is
1: any word enters it by turning the one bit whose number its own exclusive or is.  Of two fingerprints that differ in
two bits, one that lies between them differs from either in one, and that one's anchor lies within 1 of it.  So it is
enough that each is replicated to all anchors within the covering radius plus its own half of the threshold, which are
33 anchors at most; the whole threshold from one side would take over 600.  An anchor has no more than 2,081 words
within two bits, so no bucket grows with the data, however many near copies there are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notequery.llm import _store
from notequery.llm.components import _forest, components

SEED, BITS = 42, 64
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_U = np.uint64
#: For each of the six digits of a bit's number, the bits whose number has it.
_CHECKS = [_U(sum(1 << i for i in range(BITS) if i >> d & 1)) for d in range(6)]


def hashes(text: str | None, size: int):
    """Arrays of the XXH64 of every run of ``size`` words of a text, A-Z in lower case; of all its words if they are fewer."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    at, held, some = 0, [], False
    while at < len(data):
        cut = _SPACE.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        words = held + data[at:end].split()
        at = end
        if len(words) >= size:
            whole = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
            starts = np.concatenate(([0], ends + 1))[: len(words) - size + 1].tolist()
            spans = zip(starts, ends[size - 1 :].tolist(), strict=True)
            yield np.fromiter((xxhash.xxh64_intdigest(whole[a:b], SEED) for a, b in spans), dtype=np.uint64, count=len(starts))
            words, some = words[len(words) - size + 1 :], True
        held = words
    if held and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], dtype=np.uint64)


def fingerprint(text: str | None, size: int) -> int:
    """The 64-bit fingerprint of a text, 0 if it has no words."""
    total, ones = 0, np.zeros(BITS, dtype=np.int64)
    for found in hashes(text, size):
        ones += np.unpackbits(found.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(found)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``words`` and the anchors within two bits of each."""
    off = np.zeros(len(words), dtype=np.uint64)
    for d, check in enumerate(_CHECKS):
        off |= (np.bitwise_count(words & check).astype(np.uint64) & _U(1)) << _U(d)
    inside, outside = np.flatnonzero(off == 0), np.flatnonzero(off)
    at, out = [inside, inside, outside], [words[inside], words[inside] ^ _U(1), words[outside] ^ (_U(1) << off[outside])]
    for i in range(BITS):  # two turned bits enter the code if their numbers come to what the word is off by
        j = off[outside] ^ _U(i)
        pair = j > i
        at.append(outside[pair])
        out.append(words[outside[pair]] ^ _U(1 << i) ^ (_U(1) << j[pair]))
    return np.concatenate(at), np.concatenate(out)


def sketch(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with the long ``fp``, a fingerprint as signed, in place of ``_text``."""
    own = [c for c in rows.columns if c != "_text"]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_text"))
            found = np.fromiter((fingerprint(x.as_py(), size) for x in texts), dtype=np.uint64, count=len(texts))
            columns = [*(batch.column(batch.schema.get_field_index(c)) for c in own), pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*own, "fp"])

    return rows.mapInArrow(run, _store.extended(rows.drop("_text"), "fp long"))


def _replicate(batches):
    for batch in batches:
        words = batch.column(0).to_numpy().view(np.uint64)
        at, found = anchors(words)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(words[at].view(np.int64))], names=["anchor", "fp"])


def _compare(differ: int):
    """Links between the fingerprints that meet at each anchor, each with the least that it is connected with there."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for met in batch.column(0):
                words = met.values.to_numpy().view(np.uint64)
                i, j = np.nonzero(np.triu(np.bitwise_count(words[:, None] ^ words[None, :]) <= differ, 1))
                if len(i):
                    own = words.view(np.int64)
                    nodes, root, _ = _forest(own[i], own[j])
                    child = np.flatnonzero(root != np.arange(len(nodes)))
                    a.append(nodes[child])
                    b.append(nodes[root[child]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def links(fingerprints: DataFrame, differ: int = 2) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` that differ in ``differ`` bits at most, 0 to 2."""
    if differ not in (0, 1, 2):
        raise ValueError(f"anchors are within two bits, so differ is 0, 1 or 2, not {differ}")
    met = fingerprints.select("fp").mapInArrow(_replicate, "anchor long, fp long").groupBy("anchor").agg(F.collect_list("fp").alias("met"))
    return met.filter(F.size("met") > 1).select("met").mapInArrow(_compare(differ), "a long, b long")


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, differ: int = 2) -> DataFrame:
    """All rows and columns but the text, with ``fingerprint`` (16 hexadecimal digits) and ``component_id``.

    ``component_id`` is the least key that a chain of links reaches, the row's own included.  Null and empty texts have
    the fingerprint 0, which is linked like any other.  A null key is never the least unless there is no other; repeated
    rows are in one component; a text of any length is hashed whole, piece by piece; an empty table stays empty;
    columns of the input with the added names are replaced.
    """
    own = [c for c in docs.columns if c not in ("fingerprint", "component_id", text)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    sketches = _store.table(sketch(rows, size), "simhashes")
    found = _store.table(sketches.groupBy("fp").agg(F.min("_key").alias("_least")), "fingerprints")
    labels = components(links(found, differ))
    classes = found.join(labels, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "fp").alias("_class"), "_least")
    classes = _store.table(classes, "fingerprint-classes")
    least = classes.groupBy("_class").agg(F.min("_least").alias("component_id")).withColumnRenamed("_class", "_c")
    named = _store.table(classes.join(least, F.col("_class") == F.col("_c")).select("_fp", "component_id"), "fingerprint-components")
    out = sketches.join(named, F.col("fp") == F.col("_fp"))
    return out.select("_row.*", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
