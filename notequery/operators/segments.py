"""The stored index: immutable segments, tombstones and a snapshot that says which of them count.

A segment holds the tables of some notes and the paths that it replaces or deletes in older segments.  Nothing that is
stored is ever changed: an update writes one more segment, of the size of the change, and then a snapshot, a small file
with the next number that names all segments.  Readers take the last snapshot there is and read what it names, so they
see one version however long they take; a job that fails leaves a folder that no snapshot names.  Two writers that
start from one snapshot can't both write the next, and the second raises ``Conflict``.

Small segments are merged as they pile up, so that there are few, and rows are rewritten seldom.  A deleted note's rows
go at the next merge that takes in their segment, and no reader sees them from the snapshot of the delete on.

Postings lie with their notes, so that no posting is ever moved, and in each file by term and path; terms lie in ranges.
Readers that look for some words or prefixes skip the files, row groups and pages that hold none of them, and a frequent
word's rows spread over all files.
"""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notequery.operators.index import TABLES, Index, doc_stats, documents, parse_notes, postings
from notequery.operators.passages import read, spread
from notequery.sources import tables

#: So many segments, none of them FACTOR times as large as all newer ones together, are merged.
MANY, FACTOR = 4, 4
#: Share of the notes that tombstones may come to before all segments are merged.
DEAD = 0.5
#: Bytes of stored passages in a part whose postings are sorted, and the least there are where tasks are free.
PART, SMALL = 3 << 20, 1 << 18
_STORED = (*TABLES, "terms", "tombstones")


class Conflict(RuntimeError):
    """Someone else wrote the snapshot that was to be written."""


def _snapshots(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(name.removesuffix(".json")) for name in tables.names(spark, f"{folder}/snapshots") if name.endswith(".json") and name[0] != ".")


def snapshot(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """What a version consists of, by default the last one."""
    number = version if version is not None else max(_snapshots(spark, folder), default=0)
    return json.loads(tables.read_text(spark, f"{folder}/snapshots/{number}.json")) if number else {"version": 0, "segments": [], "stemming": False}


def history(spark: SparkSession, folder: str) -> DataFrame:
    """(version, kind, at, segments, done, skipped) of the snapshots there are: full rebuilds, updates and merges."""
    found = [snapshot(spark, folder, v) for v in _snapshots(spark, folder)]
    rows = [(s["version"], s["kind"], s["at"], len(s["segments"]), s["done"], s["skipped"]) for s in found if s["version"]]
    return spark.createDataFrame(rows, "version long, kind string, at string, segments int, done long, skipped long").withColumn("at", F.to_timestamp("at"))


def _publish(spark: SparkSession, folder: str, before: dict, segments: list[dict], kind: str, stemming: bool, done: int, skipped: int = 0) -> dict:
    new = {"version": before["version"] + 1, "segments": segments, "stemming": stemming, "kind": kind, "at": datetime.datetime.now(datetime.timezone.utc).isoformat(), "done": done, "skipped": skipped}
    if not tables.write_new(spark, f"{folder}/snapshots/{new['version']}.json", json.dumps(new)):
        raise Conflict(f"version {new['version']} of {folder} is there already")
    return new


def _parts(rows: DataFrame) -> int:
    """In how many parts stored notes are cut into words, so that a part's postings are sorted in memory."""
    size = tables.size(rows)
    return max(-(-size // PART), min(rows.sparkSession.sparkContext.defaultParallelism, -(-size // SMALL)), 1)


def _write(spark: SparkSession, folder: str, number: int, held: dict[str, DataFrame], stemming: bool) -> dict:
    """A segment of given tables; those that are missing are made from the ones before them, each of which is written once."""
    name = f"{number}-{uuid.uuid4().hex}"
    at = f"{folder}/segments/{name}"

    def put(table: str, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("seg", F.lit(number).cast("long"))
        rows.write.option("compression", "zstd").parquet(f"{at}/{table}")
        return spark.read.schema(rows.schema).parquet(f"{at}/{table}").drop("seg")

    notes = put("notes", held["notes"])
    if "postings" in held:
        put("passages", held["passages"])
        posted = put("postings", held["postings"])  # sorted runs stay sorted
        put("doc_stats", held["doc_stats"])
    else:
        rows = tables.stored(read(notes.select("path", "title", "body")), "read-notes")
        put("passages", spread(rows))
        docs = documents(rows.repartition(_parts(rows), "path"), stemming)
        posted = put("postings", postings(docs).sortWithinPartitions("term", "path"))
        put("doc_stats", doc_stats(posted))
        tables.remove(rows)
    put("terms", posted.groupBy("term").agg(F.count("*").alias("n")).repartitionByRange("term").sortWithinPartitions("term"))
    gone = put("tombstones", held["tombstones"] if "tombstones" in held else notes.select("path").limit(0))
    return {"id": name, "number": number, "notes": notes.count(), "tombstones": gone.count()}


def rebuild(raw: DataFrame, folder: str, stemming: bool = False, skipped: DataFrame | None = None) -> Index:
    """Index (path, content, modified) rows as a version without older segments; counts of notes done and files skipped are recorded."""
    spark = raw.sparkSession
    before = snapshot(spark, folder)
    one = _write(spark, folder, before["version"] + 1, {"notes": parse_notes(raw)}, stemming)
    _publish(spark, folder, before, [one], "rebuild", stemming, one["notes"], skipped.count() if skipped is not None else 0)
    return load(spark, folder)


def write(index: Index, folder: str) -> None:
    """Store an index as a version without older segments."""
    spark = index.notes.sparkSession
    before = snapshot(spark, folder)
    one = _write(spark, folder, before["version"] + 1, {t: getattr(index, t) for t in TABLES}, index.stemming)
    _publish(spark, folder, before, [one], "rebuild", index.stemming, one["notes"])


def _live(spark: SparkSession, folder: str, segments: list[dict], table: str) -> DataFrame:
    """A table's rows whose path no newer one of the segments replaces."""
    at = lambda t: [f"{folder}/segments/{s['id']}/{t}" for s in segments]
    rows = spark.read.parquet(*at(table))
    if table == "terms" or not any(s["tombstones"] for s in segments[1:]):
        return rows.drop("seg")
    dead = spark.read.parquet(*at("tombstones")).groupBy(F.col("path").alias("_p")).agg(F.max("seg").alias("_dead"))
    return rows.join(dead, (F.col("path") == F.col("_p")) & (F.col("seg") < F.col("_dead")), "left_anti").drop("seg")


def load(spark: SparkSession, folder: str, version: int | None = None) -> Index:
    """A version of a stored index, by default the last one; frames of it stay readable while it is updated."""
    found = snapshot(spark, folder, version)
    if not found["segments"]:
        raise ValueError(f"no index in {folder}")
    return Index(*[_live(spark, folder, found["segments"], t) for t in TABLES], found["stemming"], _live(spark, folder, found["segments"], "terms"))


def update(spark: SparkSession, folder: str, gone: DataFrame, notes: DataFrame) -> int:
    """Take paths out of a stored index and put parsed notes in, in place of what it held of their paths; returns the version.

    What is written is one segment with these notes and paths, and what a merge that is due writes.  A repeated update
    has the same result.
    """
    before = snapshot(spark, folder)
    notes = tables.stored(notes, "new-notes")
    paths = tables.stored(gone.select("path").unionByName(notes.select("path")).distinct(), "tombstones")
    if not paths.limit(1).count():
        return before["version"]
    one = _write(spark, folder, before["version"] + 1, {"notes": notes, "tombstones": paths}, before["stemming"])
    now = _publish(spark, folder, before, [*before["segments"], one], "update", before["stemming"], one["notes"])
    tables.remove(notes)
    tables.remove(paths)
    run = due(now["segments"])
    return merge(spark, folder, run)["version"] if run else now["version"]


def due(segments: list[dict]) -> int:
    """How many of the newest segments are to be merged now, 0 for none."""
    if len(segments) > 1 and sum(s["tombstones"] for s in segments[1:]) > DEAD * sum(s["notes"] for s in segments):
        return len(segments)
    size, run = 0, 0
    for s in reversed(segments):
        own = s["notes"] + s["tombstones"]
        if run and own > FACTOR * size:
            break
        size, run = size + own, run + 1
    return run if run >= MANY else 0


def merge(spark: SparkSession, folder: str, run: int | None = None) -> dict:
    """Write the newest ``run`` segments, by default all, as one without dead rows; its tombstones go if it is the oldest."""
    before = snapshot(spark, folder)
    kept, taken = (before["segments"][:-run], before["segments"][-run:]) if run else ([], before["segments"])
    held = {t: _live(spark, folder, taken, t) for t in TABLES}
    if kept:
        held["tombstones"] = _live(spark, folder, taken, "tombstones")
    one = _write(spark, folder, before["version"] + 1, held, before["stemming"])
    return _publish(spark, folder, before, [*kept, one], "merge", before["stemming"], one["notes"])


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Delete all but the last ``keep`` snapshots and the segments that only those name; returns how many segments went."""
    numbers = _snapshots(spark, folder)
    old, new = ([snapshot(spark, folder, v) for v in part] for part in (numbers[:-keep], numbers[-keep:]))
    wanted = {s["id"] for found in new for s in found["segments"]}
    going = {s["id"] for found in old for s in found["segments"]} - wanted
    for v in numbers[:-keep]:
        tables.delete(spark, f"{folder}/snapshots/{v}.json")
    for name in going:
        tables.delete(spark, f"{folder}/segments/{name}")
    return len(going)
