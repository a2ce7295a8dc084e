"""Keeping notes and their index current: reconciling, upserts, deletes and sets of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notequery.functions.notes import folder, normal_path
from notequery.operators.index import Index, index_notes
from notequery.sources.tables import stored


def reconcile(known: DataFrame, found: DataFrame, mode: str = "time") -> DataFrame:
    """(path, state): new, changed, unchanged or removed.

    Mode 'time' compares modified (in seconds) and size_bytes, so that no content is read; 'hash' compares
    content_hash.
    """
    same = (
        F.col("s.content_hash") == F.col("f.content_hash")
        if mode == "hash"
        else (F.unix_timestamp("s.modified") == F.unix_timestamp("f.modified")) & (F.col("s.size_bytes") == F.col("f.size_bytes"))
    )
    joined = known.alias("s").join(found.alias("f"), F.col("s.path") == F.col("f.path"), "full_outer")
    state = F.when(F.col("s.path").isNull(), "new").when(F.col("f.path").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return joined.select(F.coalesce("s.path", "f.path").alias("path"), state.alias("state"))


def remove(index: Index, paths: DataFrame) -> Index:
    """The index without some paths: notes, passages, postings and sizes."""
    drop = paths.select("path").distinct()
    return Index(*[t.join(drop, "path", "left_anti") for t in (index.notes, index.passages, index.postings, index.doc_stats)], index.stemming)


def upsert(index: Index, notes: DataFrame) -> Index:
    """The index with parsed notes in place of what it held of their paths."""
    rest, new = remove(index, notes), index_notes(notes, index.stemming)
    pairs = zip((rest.notes, rest.passages, rest.postings, rest.doc_stats), (new.notes, new.passages, new.postings, new.doc_stats), strict=True)
    return Index(*[a.unionByName(b) for a, b in pairs], index.stemming)


def rename(index: Index, moves: DataFrame, notes: DataFrame) -> Index:
    """The index after moves (path, new_path); ``notes`` are the parsed notes at their new paths, indexed before or not."""
    return upsert(remove(index, moves.select("path")), notes)


def apply_changes(notes: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes after changes (path, action, new_path, body, expected, at), at most one a path, and the changes refused.

    Actions: create (refused if the path is taken), save (refused if absent, or if the stored time is not the
    expected one), move (refused if absent or if the new path is taken or claimed twice), delete (refused if absent).
    Refused rows say why.  Only changes that name a target meet by it.
    """
    target = F.when(F.col("action") == "move", normal_path(F.col("new_path"))).when(F.col("action") == "create", F.col("path"))
    notes = stored(notes, "notes")
    rows = changes.withColumn("path", normal_path(F.col("path"))).withColumn("target", target)
    own = notes.select(F.col("path").alias("_p"), F.col("modified").alias("_m"))
    rows = rows.join(own, F.col("path") == F.col("_p"), "left")
    aimed = rows.filter("target is not null").join(notes.select(F.col("path").alias("_t")), F.col("target") == F.col("_t"), "left")
    aimed = aimed.withColumn("_claims", F.count("*").over(Window.partitionBy("target")))
    rows = rows.filter("target is null").withColumn("_t", F.lit(None).cast("string")).withColumn("_claims", F.lit(0)).unionByName(aimed)
    claim = F.col("_claims")
    reason = (
        F.when((F.col("action") != "create") & F.col("_p").isNull(), "absent")
        .when(F.col("target").isNotNull() & F.col("_t").isNotNull(), "taken")
        .when(F.col("target").isNotNull() & (claim > 1), "claimed twice")
        .when((F.col("action") == "save") & (F.unix_timestamp("_m") != F.unix_timestamp("expected")), "conflict")
    )
    rows = rows.withColumn("reason", reason)
    refused = rows.filter("reason is not null").select("path", "action", "reason")
    taken = rows.filter("reason is null").select(F.col("path").alias("_c"), "action", "target", F.col("body").alias("_body"), "at")
    joined = notes.join(taken.filter("action <> 'create'"), F.col("path") == F.col("_c"), "left").filter("action is null or action <> 'delete'")
    moved = F.coalesce(F.when(F.col("action") == "move", F.col("target")), F.col("path"))
    kept = joined.select(
        *[
            moved.alias("path") if c == "path"
            else F.when(F.col("action") == "save", F.col("_body")).otherwise(F.col("body")).alias("body") if c == "body"
            else F.when(F.col("action") == "save", F.col("at")).otherwise(F.col("modified")).alias("modified") if c == "modified"
            else folder(moved).alias("folder") if c == "folder"
            else F.col(c)
            for c in notes.columns
        ]
    )
    new = taken.filter("action = 'create'").select(
        F.col("target").alias("path"), folder(F.col("target")).alias("folder"), F.col("_body").alias("body"), F.col("at").alias("modified")
    )
    return kept.unionByName(new, allowMissingColumns=True), refused


def trash(notes: DataFrame, chosen: Column, at: Column) -> tuple[DataFrame, DataFrame]:
    """Notes without the chosen ones, and those with ``trashed_path``, a name in .trash that carries the time."""
    name = F.concat(F.lit(".trash/"), F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("/"), F.col("path"))
    return notes.filter(~chosen), notes.filter(chosen).withColumn("trashed_path", name)


def under(prefix: str) -> Column:
    """Whether a note lies in a folder or below it."""
    return (F.col("folder") == prefix) | F.startswith("folder", F.lit(prefix + "/"))
