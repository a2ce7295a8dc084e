"""Sets of changes in time order: several changes of one path, and changes that follow a note to where it was moved.

What a change does depends on those before it of the same paths only.  Paths that moves tie together make a group; the
keys of its changes, not the notes, are folded in order, which tells where each note ends up, whose text it has and
which changes are refused.  Texts are joined to that afterwards.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notequery.functions.notes import folder, normal_path
from notequery.sources.tables import stored

_OUT = "kind string, id long, path string, origin string, text_of long, modified long, reason string"
_SECOND = 1_000_000


def groups(edges: DataFrame) -> DataFrame:
    """(node, group): of every node of (a, b) the least node that edges connect it with."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("group")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("group").alias("low"))
        new = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("group", "low").alias("next"), "group")
        up = labels.select(F.col("node").alias("_n"), F.col("group").alias("_g"))  # and on to the label of the label
        new = stored(new.join(up, F.col("next") == F.col("_n"), "left").select("node", F.least("next", "_g").alias("next"), "group"), "labels")
        if not new.filter("next <> group").limit(1).count():
            return labels
        labels = new.select("node", F.col("next").alias("group"))


def fold(rows: Iterable[tuple]) -> Iterator[tuple]:
    """What the changes of each group leave, one after the other: (kind, id, path, origin, text_of, modified, reason).

    Rows are (group, id, path, action, target, expected, at, modified) by group, first the notes there are, without an
    action, then the changes in order; times are microseconds.
    """
    held: dict[str, tuple] = {}  # path: where the note was, the change that gave its text, its time
    last = None
    for group, id_, path, action, target, expected, at, modified in rows:
        if group != last:
            yield from (("note", None, p, *v, None) for p, v in held.items())
            held, last = {}, group
        there, reason = held.get(path), None
        if action is None:
            held[path] = (path, None, modified)
        elif action == "create":
            if there:
                reason = "taken"
            else:
                held[path] = (None, id_, at)
        elif not there:
            reason = "absent"
        elif action == "save":
            if expected is not None and (there[2] is None or expected // _SECOND != there[2] // _SECOND):
                reason = "conflict"
            else:
                held[path] = (there[0], id_, at)
        elif action == "move":
            if target != path and target in held:
                reason = "taken"
            else:
                held[target] = held.pop(path)
        elif action == "delete":
            del held[path]
        else:
            reason = "unknown"
        if reason:
            yield "refused", id_, path, None, None, None, reason
    yield from (("note", None, p, *v, None) for p, v in held.items())


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = [x.split(" ")[0] for x in _OUT.split(", ")]
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    found = fold(rows)
    while out := list(islice(found, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def apply(notes: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes after changes (id, path, action, new_path, body, expected, at) in order of at and id, and the changes refused (id, path, action, reason).

    Actions: create (refused if the path is taken), save (absent, or conflict if the note's time is not the expected
    one; a null one asks for nothing), move (absent, or taken by another note), delete (absent); others are unknown.  A
    path is what it is when its change comes, so changes of a moved note name its new path.  Ids are distinct; changes
    without an action say nothing.  A group's changes pass through one task row by row, their keys alone.
    """
    rows = changes.withColumns({"path": normal_path(F.col("path")), "target": F.when(F.col("action") == "move", normal_path(F.col("new_path")))})
    rows = stored(rows.select("id", "path", "action", "target", "body", "expected", "at"), "changes")
    tied = stored(groups(rows.select(F.col("path").alias("a"), F.coalesce("target", "path").alias("b"))), "groups")
    group = lambda df: df.join(tied, F.col("path") == F.col("node"))
    known = group(notes.select("path", F.unix_micros("modified").alias("modified"))).select("group", "path", "modified")
    none = lambda kind: F.lit(None).cast(kind)
    each = group(rows).select("group", "id", "path", "action", "target", F.unix_micros("expected").alias("expected"), F.unix_micros("at").alias("at"), none("long").alias("modified"))
    each = each.filter("action is not null").unionByName(known.select("group", none("long").alias("id"), "path", none("string").alias("action"), none("string").alias("target"), none("long").alias("expected"), none("long").alias("at"), "modified"))
    lined_up = each.repartition("group").sortWithinPartitions("group", F.col("action").isNotNull(), "at", "id")
    left = stored(lined_up.mapInArrow(_folded, _OUT).withColumn("modified", F.timestamp_micros("modified")), "folded")
    refused = left.filter("kind = 'refused'").select("id", "reason").join(rows.select("id", "path", "action"), "id").select("id", "path", "action", "reason")
    found = left.filter("kind = 'note'").select(F.col("path").alias("_path"), "origin", "text_of", F.col("modified").alias("_modified"))
    found = found.join(rows.select(F.col("id").alias("_id"), F.col("body").alias("_body")), F.col("text_of") == F.col("_id"), "left")
    joined = found.join(notes, F.col("origin") == F.col("path"), "left")
    value: dict[str, Column] = {"path": F.col("_path"), "folder": folder(F.col("_path")), "body": F.when(F.col("text_of").isNotNull(), F.col("_body")).otherwise(F.col("body")), "modified": F.col("_modified")}
    moved = joined.select(*[value.get(c, F.col(c)).alias(c) for c in notes.columns])
    return notes.join(tied.select(F.col("node").alias("path")), "path", "left_anti").select(notes.columns).unionByName(moved), refused
