"""WARC: seekable Zstandard bundles.

Each writing task turns its rows into WARC records and groups them into independent Zstandard frames; a bundle
ends in a seek table (a skippable frame) with the sizes of its frames.  The index maps a record's identifier to
its bundle, its frame and its place within the frame, so that one record costs one seek and one frame.  Bundles
lie in a folder that all executors share and carry a name of their own for each attempt; the index, written as
a table, names only those of the attempts that counted.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from urllib.parse import unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notequery.llm import _store

#: Bytes of records after which a frame is closed, and of frames after which a bundle is.
FRAME, BUNDLE = 1 << 18, 1 << 28
#: Fixed values of the seekable format: magic numbers of a skippable frame and of the seek table.
_SKIPPABLE, _SEEK_TABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "record_id string, bundle string, frame long, frame_start long, frame_size long, start long, size long"
_CONTROL = re.compile("[\x00-\x1f\x7f-\x9f\u2028\u2029\\ud800-\\udfff]|^ | $")
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _escaped(value: str) -> str:
    """A value with each control character and percent sign as %XX."""
    return re.sub(f"{_CONTROL.pattern}|%", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), value)


def record(record_id: str, kind: str, uri: str, refers_to: str | None, digest: str, size: int, payload: bytes) -> bytes:
    """One WARC/1.1 record; a revisit has no block.

    An identifier or target with characters that would end or change its header is escaped, and a header says so.
    """
    block = b"" if kind == "revisit" else payload
    odd = any(_CONTROL.search(x or "") for x in (record_id, uri, refers_to))
    own = _escaped if odd else str
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{own(record_id)}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": own(uri),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": str(size),
    }
    if odd:
        head["X-Escaped"] = "1"
    if kind == "revisit":
        head |= {"WARC-Refers-To": f"<{own(refers_to or '')}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head["Content-Length"] = str(len(block))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The header and block of the record at a place, and the place after it."""
    end = data.index(b"\r\n\r\n", at)
    head = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:])
    start = end + 4
    stop = start + int(head["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {at} does not end where its header says")
    return head, data[start:stop], stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle: (compressed, plain) size of each frame and a footer."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, _SEEK_TABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(start, compressed, plain) of each frame of an open bundle."""
    size = file.size()
    file.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != _SEEK_TABLE:
        raise ValueError("no seek table at the end of the bundle")
    file.seek(size - 9 - 8 * n)
    sizes, at, out = struct.unpack(f"<{2 * n}I", file.read(8 * n)), 0, []
    for packed, plain in zip(sizes[::2], sizes[1::2], strict=True):
        out.append((at, packed, plain))
        at += packed
    return out


class _Bundle:
    """A bundle being written; rows of its index are known once their frame is closed."""

    def __init__(self, folder: str, level: int):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        store, at = fs.FileSystem.from_uri(self.path)
        store.create_dir(at.rpartition("/")[0], recursive=True)
        self.file, self.frames, self.at = store.open_output_stream(at, compression=None), [], 0
        self.parts, self.size, self.waiting = [], 0, []
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)

    def add(self, record_id: str, data: bytes) -> list[tuple]:
        self.waiting.append((record_id, self.size, len(data)))
        self.parts.append(data)
        self.size += len(data)
        return self.flush() if self.size >= FRAME else []

    def flush(self) -> list[tuple]:
        if not self.parts:
            return []
        packed = self.packer.compress(b"".join(self.parts))
        self.file.write(packed)
        rows = [(i, self.path, len(self.frames), self.at, len(packed), start, size) for i, start, size in self.waiting]
        self.frames.append((len(packed), self.size))
        self.at += len(packed)
        self.parts, self.size, self.waiting = [], 0, []
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        self.file.write(seek_table(self.frames))
        self.file.close()
        return rows


def _index(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 7
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 5]
    names = ["record_id", "bundle", "frame", "frame_start", "frame_size", "start", "size"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def write(rows: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Write (record_id, record_type, target_uri, refers_to, payload_digest, payload_bytes, payload) as bundles.

    Returns the index, which is kept as a table beside them.  A null payload or target counts as empty; a target of
    any characters, line ends included, is read back as it was; an empty frame of rows makes an empty index.
    """
    names = [x.split(" ")[0] for x in RECORD.split(", ")]

    def run(batches):
        bundle = None
        for batch in batches:
            out: list[tuple] = []
            kept = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
            for i in range(batch.num_rows):
                bundle = bundle or _Bundle(folder, level)
                row = {c: v[i].as_py() for c, v in kept.items()}
                data = record(row["record_id"], row["record_type"], row["target_uri"] or "", row["refers_to"], row["payload_digest"], row["payload_bytes"], row["payload"] or b"")
                out += bundle.add(row["record_id"], data)
                if bundle.at >= BUNDLE:
                    out, bundle = out + bundle.close(), None
            yield _index(out)
        if bundle:
            yield _index(bundle.close())

    return _store.table(rows.select(*names).mapInArrow(run, INDEX), "warc-index")


def _rows(found: list[tuple[dict, bytes]]) -> pa.RecordBatch:
    own = lambda h, x: unquote(x, errors="surrogatepass") if "X-Escaped" in h else x
    bare = lambda h, k: own(h, h[k][1:-1]) if k in h else None
    columns = [
        pa.array([bare(h, "WARC-Record-ID") for h, _ in found], pa.string()),
        pa.array([h["WARC-Type"] for h, _ in found], pa.string()),
        pa.array([own(h, h["WARC-Target-URI"]) for h, _ in found], pa.string()),
        pa.array([bare(h, "WARC-Refers-To") for h, _ in found], pa.string()),
        pa.array([h["WARC-Payload-Digest"].partition(":")[2] for h, _ in found], pa.string()),
        pa.array([int(h["X-Payload-Length"]) for h, _ in found], pa.int64()),
        pa.array([b for _, b in found], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split(" ")[0] for x in RECORD.split(", ")])


def _checked(head: dict, block: bytes) -> tuple[dict, bytes]:
    if head["WARC-Type"] != "revisit" and f"sha1:{hashlib.sha1(block).hexdigest()}" != head["WARC-Payload-Digest"]:
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not have its digest")
    return head, block


def read(spark: SparkSession, index: DataFrame) -> DataFrame:
    """Every record of the bundles that an index names, frame by frame; the digest of each response is checked.

    Each bundle is a task of its own, as far as their names' hashes part them.
    """

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as file:
                    for start, packed, plain in read_seek_table(file):
                        file.seek(start)
                        data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)
                        found, place = [], 0
                        while place < len(data):
                            head, block, place = parse(data, place)
                            found.append(_checked(head, block))
                        yield _rows(found)

    bundles = _store.table(index.select("bundle").distinct(), "bundles")
    return bundles.repartition(max(1, bundles.count()), "bundle").mapInArrow(run, RECORD)


def fetch(index: DataFrame) -> DataFrame:
    """The records that the rows of an index name, each by one seek to its frame."""

    def run(batches):
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                store, at = fs.FileSystem.from_uri(row["bundle"])
                with store.open_input_file(at) as file:
                    file.seek(row["frame_start"])
                    reader = zstandard.ZstdDecompressor().decompressobj()
                    data = reader.decompress(file.read(row["frame_size"]))
                head, block, _ = parse(data[row["start"] : row["start"] + row["size"]], 0)
                found.append(_checked(head, block))
            yield _rows(found)

    return index.select(*[x.split(" ")[0] for x in INDEX.split(", ")]).mapInArrow(run, RECORD)


def records(pages: DataFrame, key: Column, uri: Column, text: Column, least: int = 1000) -> DataFrame:
    """The record of every row: payload the text in UTF-8, null as empty.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest key is the response and the
    others revisit it; rows that share that key too are all responses.  A null key never is the largest unless
    all are null.  Payloads are settled by digest in a partial aggregation and joined back from a table, so that
    Spark splits hot ones; a revisit carries no payload.  A payload of any length is one record, repeated rows are
    records of their own, other columns are left out, and an empty table makes no records.
    """
    payload = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    rows = pages.select(key.alias("_key"), uri.alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    same = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("_key").alias("_last"), F.count("*").alias("_n"))
    same = _store.table(same.filter("_n > 1").select("payload_digest", "_last"), "payload-keys")
    rows = rows.join(same, "payload_digest", "left")
    revisit = F.coalesce((F.col("payload_bytes") >= least) & F.col("_last").isNotNull() & ~F.col("_key").eqNullSafe(F.col("_last")), F.lit(False))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    return rows.select(
        name(F.col("_key")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(revisit, name(F.col("_last"))).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
