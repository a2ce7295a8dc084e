"""Reports: folders, usage, latencies, histories, term counts and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def listing(notes: DataFrame, folder: str | None = None) -> DataFrame:
    """Notes newest first, of all folders or of one."""
    rows = notes if folder is None else notes.filter(F.col("folder") == folder)
    return rows.orderBy(F.desc("modified"), "path")


def folder_counts(notes: DataFrame, folders: DataFrame | None = None, root: str = "Notes") -> DataFrame:
    """(path, parent, name, depth, note_count, total_count) of every folder and each above it; empty ones too.

    The root has the empty path and the given name.
    """
    own = notes.select("folder", F.lit(1).alias("n"))
    if folders is not None:
        own = own.unionByName(folders.select("folder", F.lit(0).alias("n")))
    own = own.unionByName(notes.sparkSession.range(1).select(F.lit("").alias("folder"), F.lit(0).alias("n")))
    steps = F.filter(F.split("folder", "/"), lambda s: s != "")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    rows = own.select("folder", "n", F.explode(above).alias("path"))
    out = rows.groupBy("path").agg(F.sum(F.when(F.col("path") == F.col("folder"), F.col("n")).otherwise(0)).alias("note_count"), F.sum("n").alias("total_count"))
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    name = F.when(F.col("path") == "", F.lit(root)).otherwise(F.regexp_extract("path", r"([^/]*)$", 1))
    parent = F.when(F.col("path") != "", F.regexp_extract("path", r"^(.*)/", 1))
    return out.select("path", parent.alias("parent"), name.alias("name"), depth.alias("depth"), "note_count", "total_count")


def day_groups(notes: DataFrame) -> DataFrame:
    """(day, label, n): notes by day; labels read 'Jan 5', and days of different years stay apart."""
    return notes.groupBy(F.to_date("modified").alias("day")).agg(F.count("*").alias("n")).withColumn("label", F.date_format("day", "MMM d"))


def recent(events: DataFrame, text: str, at: str, by: list[str] | None = None, most: int = 20) -> DataFrame:
    """(by, text, last): the newest distinct texts, trimmed, each at its last time."""
    keys = by or []
    last = events.withColumn(text, F.trim(text)).filter(F.col(text) != "").groupBy(*keys, text).agg(F.max(at).alias("last"))
    if not keys:
        return last.orderBy(F.desc("last"), text).limit(most)
    order = Window.partitionBy(*keys).orderBy(F.desc("last"), text)
    return last.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def usage(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Requests, tokens and failures (any outcome but ok; those without results counted apart)."""
    return records.groupBy(*(by or [])).agg(
        F.count("*").alias("requests"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.count_if(F.col("outcome") != "ok").alias("failures"),
        F.count_if(F.col("outcome") == "no-results").alias("without_results"),
    )


def latency(records: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Nearest-rank median and 95th percentile, greatest and mean."""
    return records.groupBy(*(by or [])).agg(
        F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("median"),
        F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"),
        F.max(value).alias("max"),
        F.round(F.avg(value), 6).alias("mean"),
    )


def term_counts(tokens: DataFrame, document: str = "path") -> DataFrame:
    """(term, n_notes): in how many notes each term stands; distinct pairs first, so that a common term is no one task's."""
    return tokens.select(document, "term").distinct().groupBy("term").agg(F.count("*").alias("n_notes"))


def tally(redacted: DataFrame, key: str) -> DataFrame:
    """(key, rule, n) of redactions, from ``counts``."""
    each = redacted.select(key, F.explode("counts").alias("c"))
    return each.groupBy(key, "c.rule").agg(F.sum("c.n").alias("n"))


def false_positives(found: DataFrame, width: int = 60) -> DataFrame:
    """(rule, preview, n): matches by rule and by what they begin with."""
    return found.groupBy("rule", F.substring("match", 1, width).alias("preview")).agg(F.count("*").alias("n"))


def outcome(status: Column, connected: Column) -> tuple[Column, Column]:
    """The class of a request's outcome by HTTP status, and whether trying again may help."""
    kind = (
        F.when(~connected, "unreachable")
        .when(status.between(200, 299), "ok")
        .when(status == 401, "unauthorised")
        .when(status == 403, "forbidden")
        .when(status == 404, "not-found")
        .when(status == 429, "rate-limited")
        .otherwise("server-error")
    )
    return kind, ~connected | (status >= 500)
