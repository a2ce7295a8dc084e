"""The graph of links between notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notequery.functions.notes import stem


def links(notes: DataFrame) -> DataFrame:
    """(src, target): every [[name]] and every relative link of a note, once; links to the web don't count."""
    wiki = F.transform(F.regexp_extract_all("body", F.lit(r"\[\[([^\]|#]+)"), 1), lambda t: F.trim(t))
    plain = F.regexp_extract_all("body", F.lit(r"\[[^\]\[]*\]\(([^)\s]+)\)"), 1)
    inner = F.filter(plain, lambda t: ~F.regexp_like(t, F.lit(r"(?i)^(?:[a-z][a-z0-9+.-]*:|#)")))
    return notes.select(F.col("path").alias("src"), F.explode(F.array_distinct(F.concat(wiki, inner))).alias("target")).filter("target <> ''")


def resolve(found: DataFrame, notes: DataFrame) -> DataFrame:
    """(src, target, dst): the note a link means, by exact path, else by path or name without .md, else by title.

    Case does not matter; of several notes the newest counts; dst is null if there is none.
    """
    names = F.array(
        F.struct(F.lit(1).alias("way"), F.lower("path").alias("name")),
        F.struct(F.lit(2).alias("way"), F.lower(F.regexp_replace("path", r"\.(?:md|markdown)$", "")).alias("name")),
        F.struct(F.lit(2).alias("way"), F.lower(stem(F.col("path"))).alias("name")),
        F.struct(F.lit(2).alias("way"), F.lower(F.regexp_extract("path", r"([^/]*)$", 1)).alias("name")),
        F.struct(F.lit(3).alias("way"), F.lower("title").alias("name")),
    )
    known = notes.select("path", "modified", F.explode(names).alias("n")).select("path", "modified", "n.way", "n.name")
    best = F.row_number().over(Window.partitionBy("name").orderBy("way", F.desc("modified"), "path"))
    known = known.withColumn("_r", best).filter("_r = 1").select("name", F.col("path").alias("dst"))
    return found.join(known, F.lower("target") == F.col("name"), "left").select("src", "target", "dst")
