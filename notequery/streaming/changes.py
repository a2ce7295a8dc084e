"""Change feeds: from file events to an index that is current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notequery.functions.notes import normal_path
from notequery.operators import maintain, segments
from notequery.operators.index import Index

QUIET, OWN = "500 milliseconds", "2 seconds"


def watchable(path: Column) -> Column:
    """Whether an event's relative path is a note: Markdown, no step that starts with a dot, no temporary file."""
    plain = normal_path(path)
    return F.regexp_like(plain, F.lit(r"(?i)\.(?:md|markdown)$")) & ~F.regexp_like(plain, F.lit(r"(?:^|/)\.|^/|(?:^|/)\.\.(?:/|$)"))


def debounce(events: DataFrame, late: str = "10 seconds", quiet: str = QUIET) -> DataFrame:
    """(path, removed, ts): the last of the events (path, removed, ts) of a path that no pause divides.

    Streams and tables alike; a stream gives a change once its watermark has passed the pause.
    """
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", quiet).alias("_w"), "path")
        .agg(F.max_by("removed", "ts").alias("removed"), F.max("ts").alias("last"))
        .select("path", "removed", F.col("last").alias("ts"))
    )


def foreign(events: DataFrame, writes: DataFrame, late: str = "10 seconds", window: str = OWN) -> DataFrame:
    """Events but for those less than ``window`` after a write (path, ts) of our own to the path."""
    e = events.withWatermark("ts", late)
    w = writes.select(normal_path(F.col("path")).alias("_p"), F.col("ts").alias("_t")).withWatermark("_t", late)
    near = (normal_path(F.col("path")) == F.col("_p")) & (F.col("ts") >= F.col("_t")) & (F.col("ts") < F.col("_t") + F.expr(f"interval {window}"))
    if events.isStreaming:
        return e.join(w, near, "left_outer").filter("_p is null").drop("_p", "_t")
    return events.join(w, near, "left_anti")


def apply(index: Index, changes: DataFrame, notes: DataFrame) -> Index:
    """The index after changes (path, removed): removed paths go, the others are indexed from parsed notes."""
    last = changes.groupBy("path").agg(F.max_by("removed", "ts").alias("removed"))
    gone = maintain.remove(index, last.filter("removed"))
    return maintain.upsert(gone, notes.join(last.filter("not removed").select("path"), "path", "left_semi"))


def follow(changes: DataFrame, folder: str, notes: Callable[[], DataFrame], checkpoint: str):
    """A streaming query that applies every batch of changes (path, removed, ts) to a stored index.

    A batch writes one segment of its notes and paths; one that fails is applied again, with the same result.
    """

    def batch(rows: DataFrame, _: int) -> None:
        last = rows.groupBy("path").agg(F.max_by("removed", "ts").alias("removed"))
        written = notes().join(last.filter("not removed").select("path"), "path", "left_semi")
        segments.update(rows.sparkSession, folder, last.filter("removed"), written)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
